"""Links between texts from banded signatures without emitting all pairs of a large bucket (DataFrame functions only).

Pairs of small buckets are all compared. In a large one leaders are compared with
all others first. What is left are pairs between components, and for these there are
two exact ways that don't depend on the buckets.

Narrow signatures are themselves sets of (place, value), of which a pair must share a number. Put in
one common order, rare ones first, two of them then have one in common among their first ones. Where
the first one in common is held by few members, all pairs of these are compared, and no text
is read for it. Else all that they have in common are frequent, which leaves only members
with that many frequent ones to the second way.

This looks at whole sets: of two sets whose Jaccard similarity reaches t, put
in one common order of tokens (rare ones first), the longer one's first n - ceil(t n) + 1
tokens and the shorter one's first n - ceil(2 t n / (1 + t)) + 1 have one in common, and the
first one in common stands early enough in both that the rest can still make up the overlap.
So texts that only share a passage, however many they are, don't meet: their own
tokens are rarer and come first.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import graph, store

FEW = 64  #: members that hold a rare place of a narrow signature, whose pairs are all compared
LEADERS = 3  #: members of a large bucket that are compared with all others
WORDS = 1 << 19  #: words of 64 bits in the bitmap of the members whose signatures are looked up
NARROW = 12  #: places of a signature that travels with the members of buckets
BITS, PLACES = 10, 6  #: of a place there, and places of a 64-bit number: unequal places seem equal with probability 2 ** -10


def _agreeing(pairs: DataFrame, sk: DataFrame, agree: int) -> DataFrame:
    """(a, b) of pairs whose signatures agree in so many places at least."""
    one, two = sk.select(F.col("rep").alias("a"), F.col("sketches").alias("x")), sk.select(F.col("rep").alias("b"), F.col("sketches").alias("y"))
    same = F.size(F.filter(F.zip_with("x", "y", lambda p, q: p == q), lambda p: p))
    return pairs.join(one, "a").join(two, "b").filter(same >= agree).select("a", "b")


def _ordered(one: str, two: str) -> list:
    return [F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]


def _packed(length: int) -> list:
    """p and q: the low bits of a narrow signature's places; both 0 for others."""
    place = lambda i: F.shiftleft(F.element_at("sketches", i + 1).cast("long").bitwiseAND(F.lit((1 << BITS) - 1)), i % PLACES * BITS)
    halves = [range(PLACES), range(PLACES, length)] if length <= NARROW else [(), ()]
    return [reduce(lambda x, y: x.bitwiseOR(y), map(place, half), F.lit(0).cast("long")).alias(name) for half, name in zip(halves, "pq", strict=True)]


def _may_agree(one: str, two: str, length: int, agree: int):
    """Whether packed signatures one.p, one.q and two.p, two.q agree in so many places at least; wide ones always may."""
    if length > NARROW:
        return F.lit(True)
    apart = lambda i: F.col(f"{one}.{'pq'[i // PLACES]}").bitwiseXOR(F.col(f"{two}.{'pq'[i // PLACES]}"))
    same = [(F.shiftright(apart(i), i % PLACES * BITS).bitwiseAND(F.lit((1 << BITS) - 1)) == 0).cast("int") for i in range(length)]
    return reduce(add, same) >= agree


def _small_pairs(small: DataFrame, length: int, agree: int) -> DataFrame:
    """All pairs inside small buckets whose packed signatures may agree."""
    met = small.alias("x").join(small.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.rep") < F.col("y.rep")) & _may_agree("x", "y", length, agree))
    return met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def _leader_pairs(active: DataFrame, length: int, agree: int) -> DataFrame:
    """Some members of each bucket with all others: the one in most buckets, and others by a hash that is the same in all buckets."""
    central = active.groupBy("rep").agg(F.count("*").alias("central"))
    own = F.struct("rep", "p", "q").alias("own")
    orders = [F.struct("central", "rep", own), *(F.struct(F.xxhash64("rep", F.lit(i)), "rep", own) for i in range(1, LEADERS))]
    lead = active.join(central, "rep").groupBy("bucket").agg(*(F.max(o)["own"].alias(f"l{i}") for i, o in enumerate(orders)))
    lead = lead.select("bucket", F.explode(F.array_distinct(F.array(*(f"l{i}" for i in range(LEADERS))))).alias("y")).select("bucket", "y.*")
    met = active.alias("x").join(lead.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.rep") != F.col("y.rep")) & _may_agree("x", "y", length, agree))
    return met.select(*_ordered("x.rep", "y.rep")).distinct()


def _open_members(active: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, c, p, q) of the members, with their components, of buckets that links leave in several components."""
    inside = active.select("rep").distinct()
    for end in ("a", "b"):
        links = links.join(inside.select(F.col("rep").alias(end)), end, "left_semi")
    of = graph.components(links.select("a", "b"))
    known = active.join(of, active["rep"] == of["node"], "left").select("bucket", "rep", "p", "q", F.coalesce("component", "rep").alias("c"))
    several = known.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high")
    return store.materialize(known.join(several.select("bucket"), "bucket").select("rep", "c", "p", "q").distinct(), "open-members")


def _ranked_places(members: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, c, p, q, places: [(n, place)]) of the members (rep, c, p, q): the hashed places of their signatures that n > 1 members hold, rare ones first."""
    signed = store.maybe_in(reps, members, "rep", WORDS).join(members.select("rep"), "rep")
    places = signed.select("rep", F.posexplode("sketches").alias("i", "value")).select("rep", F.hash("i", "value").alias("place"))
    held = places.select("rep", F.count("*").over(Window.partitionBy("place")).alias("n"), "place").filter("n > 1")
    ranked = held.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "place"))).alias("places"))
    return store.materialize(members.join(ranked, "rep"), "ranked-places")


def _rare_pairs(ranked: DataFrame, length: int, agree: int) -> DataFrame:
    """Pairs of different components that hold a rare place in common among their first ones and whose packed signatures may agree.

    Of the places in which two signatures agree, agree at least, the first in the common
    order is not among the last agree - 1 of either.
    """
    many = F.greatest(F.size("places") - (agree - 1), F.lit(0))
    first = ranked.select("rep", "c", "p", "q", F.explode(F.slice("places", F.lit(1), many)).alias("held"))
    rare = first.filter(F.col("held.n") <= FEW).select("rep", "c", "p", "q", "held.place")
    apart = (F.col("x.place") == F.col("y.place")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.c") != F.col("y.c"))
    met = rare.alias("x").join(rare.alias("y"), apart & _may_agree("x", "y", length, agree))
    return met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def _frequent_members(ranked: DataFrame, agree: int) -> DataFrame:
    """(rep, c, p, q) of the members that hold as many frequent places as a pair must share; these come last in order."""
    return ranked.filter(F.try_element_at("places", F.lit(-agree))["n"] > FEW).select("rep", "c", "p", "q")


def _that_may_agree(pairs: DataFrame, members: DataFrame, length: int, agree: int) -> DataFrame:
    """The pairs (a, b) of members (rep, p, q) whose packed signatures may agree."""
    for end in "ab":
        pairs = pairs.join(members.select(F.col("rep").alias(end), F.struct("p", "q").alias(f"of_{end}")), end)
    return pairs.filter(_may_agree("of_a", "of_b", length, agree)).select("a", "b")


def _early_pairs(tokens: DataFrame, least: float, length: int = NARROW + 1, agree: int = 0) -> DataFrame:
    """Pairs of different components that can reach the similarity least by their first tokens (rep, c, n, token, at) and whose packed signatures may agree.

    Narrow signatures of a given length come with the tokens, as p and q.
    """
    part, own = 2 * least / (1 + least), ["p", "q"] if length <= NARROW else []
    # the last condition leaves of the shorter one its first tokens only; not filtered before, both sides are shuffled as one
    long = tokens.select("token", F.col("rep").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), F.col("at").alias("i"), *own)
    short = tokens.select("token", F.col("rep").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"), F.col("at").alias("j"), *own)
    needed = F.ceil(part / 2 * (F.col("na") + F.col("nb")) - 1e-9)
    fits = (F.col("nb") < F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))
    fits = fits & (F.col("nb") >= least * F.col("na") - 1e-9) & (F.least(F.col("na") - F.col("i"), F.col("nb") - F.col("j")) + 1 >= needed)
    met = long.alias("x").join(short.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("ca") != F.col("cb")) & fits & _may_agree("x", "y", length, agree))
    return met.select(*_ordered("a", "b")).distinct()


def early(at: str, n: str, least: float):
    """Whether a token at that place (from 1) of n counts among the first ones."""
    return F.col(at) <= F.col(n) - F.ceil(least * F.col(n) - 1e-9) + 1


def links(
    reps: DataFrame, length: int, rows: int, agree: int, least: float, verify: Callable[[DataFrame], DataFrame], first_tokens: Callable[[DataFrame], DataFrame], small_bucket: int = 16
) -> DataFrame:
    """Verified links of reps (rep, sketches: array of that length) that share a band of rows places and agree in enough.

    verify turns pairs (a < b) into the rows (a, b, ...) of those that are links.
    first_tokens gives (rep, c, n, token, at) for a table of reps (rep, c): how many tokens each has,
    and its first ones in an order that is the same for all; of narrow signatures only members
    with many frequent places are asked for. Links within one component
    may be left out; components are those of all candidate pairs. Narrow signatures are
    compared while pairs are formed, so of those that don't agree no rows
    are made, and after first tokens; unequal places that seem equal let a few more pairs be verified.
    """
    band = lambda i: F.xxhash64(i, *(F.element_at("sketches", i * rows + r + 1) for r in range(rows)))
    bands = reps.select("rep", F.explode(F.transform(F.sequence(F.lit(0), F.lit(length // rows - 1)), band)).alias("bucket"))
    members = bands.withColumn("size", F.count("*").over(Window.partitionBy("bucket"))).filter("size > 1")
    if length <= NARROW:
        members = members.join(reps.select("rep", *_packed(length)), "rep")
    else:
        members = members.select("*", *_packed(length))
    buckets = store.materialize(members, "buckets")
    small = buckets.filter(F.col("size") <= small_bucket)
    pairs = _small_pairs(small, length, agree)
    active = buckets.filter(F.col("size") > small_bucket).select("bucket", "rep", "p", "q")
    large = not active.isEmpty()
    met = pairs.unionByName(_leader_pairs(active, length, agree)).distinct() if large else pairs

    def compared(p: DataFrame, *sources: DataFrame) -> DataFrame:
        # pairs of narrow signatures were compared as they were formed
        agreeing = store.materialize(p if length <= NARROW else _agreeing(p, reps, agree), "pairs")
        store.discard(*sources)
        linked = verify(agreeing)
        store.discard(agreeing)
        return linked

    found = compared(met)
    members = _open_members(active, found) if large else None
    store.discard(buckets)
    if members is None or members.isEmpty():
        return found
    ranked = _ranked_places(members, reps) if length <= NARROW else None
    asked = members if ranked is None else _frequent_members(ranked, agree)
    tokens = store.materialize(first_tokens(asked.select("rep", "c")), "early-tokens")
    rest = _early_pairs(tokens, least)
    if ranked is not None:
        # many tokens lead to a pair, so signatures are compared after them
        rest = _that_may_agree(rest, asked, length, agree).unionByName(_rare_pairs(ranked, length, agree)).distinct()
    rest = compared(rest, tokens, *([] if ranked is None else [ranked]))
    return store.materialize(found.unionByName(rest).dropDuplicates(["a", "b"]), "all-links")
