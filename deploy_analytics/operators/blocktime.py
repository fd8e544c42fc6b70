"""Block numbers to times and back by checkpoints, and block windows.

An as-of lookup is a join on (chain, coarse slot) with segments between
checkpoints laid over all slots that they touch. The segments are few (a
checkpoint a day) and are broadcast only below a checked number of rows; beyond
it the same equi-join shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GNOSIS = 100
MERGE_BLOCK = 15_537_393  #: first mainnet block with 12-second slots
BROADCAST_ROWS = 200_000


def fallback_ms(chain: str = "chain_id", block: str = "block_number") -> str:
    return f"case when {chain} = {GNOSIS} then 5000L when {block} >= {MERGE_BLOCK} then 12000L else 14000L end"


def blocks_per_day(chain: str = "chain_id", block: str = "block_number"):
    """Whole blocks of a day at the ideal slot time: SQL."""
    return F.expr(f"86400L * 1000 div ({fallback_ms(chain, block)})")


def latest_checkpoints(observed: DataFrame) -> DataFrame:
    """One time per (chain, block): the one observed last; of equal ones the later time."""
    best = F.max(F.struct("observed_at", "block_timestamp")).alias("best")
    return observed.groupBy("chain_id", "block_number").agg(best).select("chain_id", "block_number", "best.block_timestamp")


def segments(checkpoints: DataFrame) -> DataFrame:
    """Spans between neighbouring checkpoints, and one without end after the last; rate_ms is that of the last full span."""
    w = Window.partitionBy("chain_id").orderBy("block_number")
    rows = checkpoints.select("chain_id", F.col("block_number").alias("b0"), F.col("block_timestamp").alias("t0"))
    w = Window.partitionBy("chain_id").orderBy("b0")
    rows = rows.withColumns({"b1": F.lead("b0").over(w), "t1": F.lead("t0").over(w), "bp": F.lag("b0").over(w), "tp": F.lag("t0").over(w)})
    rate = F.expr("if(b1 is null and b0 > bp and t0 > tp, (t0 - tp) * 1000 div (b0 - bp), null)")
    return rows.withColumn("rate_ms", rate).withColumn("is_first", F.col("bp").isNull()).drop("bp", "tp")


def _as_of(rows: DataFrame, spans: DataFrame, value: str, low: str, high: str, slot: int) -> DataFrame:
    """rows with the span in which value lies; values before the first span get the first, those after the last the last."""
    ends = spans.groupBy("chain_id").agg(F.min(low).alias("_min"), F.max(low).alias("_max"))
    laid = spans.withColumn("_slot", F.explode(F.sequence(F.expr(f"{low} div {slot}"), F.expr(f"coalesce({high} - 1, {low}) div {slot}"))))
    small = laid.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda df: df)
    placed = rows.join(hint(ends), "chain_id", "left").withColumn("_at", F.least(F.greatest(value, "_min"), "_max"))
    placed = placed.withColumn("_slot", F.expr(f"if({value} >= _max, _max, _at) div {slot}"))
    met = placed.join(hint(laid), ["chain_id", "_slot"], "left").filter(F.expr(f"{low} is null or (_at >= {low} and ({high} is null or _at < {high}))"))
    return met.drop("_min", "_max", "_at", "_slot")


def block_times(rows: DataFrame, checkpoints: DataFrame, block: str = "block_number", out: str = "block_time", slot: int = 10_000) -> DataFrame:
    """rows with the epoch second of a block: exact at checkpoints, linear between, the first's time before, by rate after; 0 without checkpoints."""
    met = _as_of(rows, segments(checkpoints), block, "b0", "b1", slot)
    after = f"t0 + ({block} - b0) * coalesce(rate_ms, {fallback_ms('chain_id', block)}) div 1000"
    inside = f"t0 + ({block} - b0) * (t1 - t0) div (b1 - b0)"
    time = F.expr(f"case when b0 is null then 0L when {block} <= b0 then t0 when b1 is null then {after} else {inside} end")
    return met.withColumn(out, time).select(*rows.columns, out)


def time_blocks(rows: DataFrame, checkpoints: DataFrame, time: str = "time", out: str = "block_number", slot: int = 86_400) -> DataFrame:
    """rows with the block at an epoch second, the inverse of block_times; 0 without checkpoints."""
    met = _as_of(rows, segments(checkpoints), time, "t0", "t1", slot)
    after = f"b0 + greatest(({time} - t0) * 1000 div coalesce(rate_ms, {fallback_ms('chain_id', 'b0')}), 0L)"
    inside = f"b0 + ({time} - t0) * (b1 - b0) div (t1 - t0)"
    at = F.expr(f"case when b0 is null then 0L when {time} <= t0 then b0 when b1 is null then {after} else {inside} end")
    return met.withColumn(out, at).select(*rows.columns, out)


NAMED = {"hour": ("greatest(1L, d div 24)", "greatest(1L, w div 12)"), "day": ("d", "greatest(1L, d div 24)"), "week": ("7 * d", "d"), "month": ("30 * d", "d"), "year": ("365 * d", "30 * d")}


def windows(specs: DataFrame) -> DataFrame:
    """specs (chain_id, anchor_block, range, bucket, start_block, end_block) with bucket_blocks, range_start, range_end.

    Starts and ends given as times are turned into blocks by time_blocks first. No
    start and no known range name mean the full history: both ends are null.
    """
    pick = lambda i: "case range " + " ".join(f"when '{k}' then {v[i]}" for k, v in NAMED.items()) + " end"
    raw = "try_cast(bucket as bigint)"
    named = f"case bucket when 'hour' then d div 24 when 'day' then d when 'week' then 7 * d when 'month' then 30 * d when 'year' then 365 * d else coalesce({raw}, d) end"
    rows = specs.withColumn("d", blocks_per_day("chain_id", "anchor_block"))
    rows = rows.withColumn("end_", F.expr("least(coalesce(end_block, anchor_block), anchor_block)")).withColumn("start_", F.expr("if(start_block is null, null, least(start_block, end_))"))
    rows = rows.withColumn("w", F.expr(pick(0))).withColumn("width", F.expr(pick(1)))
    rows = rows.withColumn(
        "bucket_blocks",
        F.expr(f"""case when start_ is not null then coalesce(if(bucket is null, null, {named}), greatest(1L, (end_ - start_ + 1) div 96))
                   when w is not null then greatest(1L, coalesce(if(bucket is null, null, {named}), width)) else {named} end"""),
    )
    rows = rows.withColumn("range_start", F.expr("case when start_ is not null then start_ when w is not null then greatest(0L, end_ - (w - 1)) end"))
    rows = rows.withColumn("range_end", F.expr("if(start_ is not null or w is not null, end_, null)"))
    return rows.drop("d", "end_", "start_", "w", "width")


def sample_blocks(ranges: DataFrame, interval: int = 100_000) -> DataFrame:
    """(chain_id, block_number): first and last block of each (chain_id, first_block, last_block), and the multiples between."""
    between = F.expr(f"filter(sequence(first_block div {interval}, last_block div {interval}), i -> i * {interval} > first_block and i * {interval} < last_block)")
    blocks = F.concat(F.array("first_block"), F.transform(between, lambda i: i * interval), F.array("last_block"))
    return ranges.select("chain_id", F.explode(F.array_distinct(blocks)).alias("block_number"))


def missing_checkpoints(ranges: DataFrame, known: DataFrame, interval: int = 100_000) -> DataFrame:
    return sample_blocks(ranges, interval).join(known.select("chain_id", "block_number"), ["chain_id", "block_number"], "left_anti")


def due_checkpoints(heads: DataFrame, known: DataFrame) -> DataFrame:
    """(chain_id, head, due): whether the head is a day's blocks past the latest checkpoint, or there is none."""
    latest = known.groupBy("chain_id").agg(F.max("block_number").alias("latest"))
    rows = heads.join(latest, "chain_id", "left").withColumn("d", blocks_per_day("chain_id", "head"))
    return rows.select("chain_id", "head", F.expr("latest is null or head >= latest + d").alias("due"))
