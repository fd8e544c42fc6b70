"""What runtime bytecode tells: opcodes, interfaces, proxies, and the compiler's metadata trailer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Function selectors of the standards, the storage slot and the minimal-proxy code.
ERC20 = ("18160DDD", "A9059CBB", "DD62ED3E")
ERC721 = ("6352211E", "42842E0E")
ERC1155 = ("4E1273F4", "2EB2C2D6")
EIP1967_SLOT = "360894A13BA1A3210667C828492DB98DCA3E2076CC3735A920A3CA505D382BBC"
EIP1167_PREFIX, EIP1167_SUFFIX = "363D3D373D3D3D363D73", "5AF43D82803E903D91602B57FD5BF3"


def opcode_pattern() -> str:
    """One opcode with its immediate bytes, of which a truncated tail has fewer."""
    pushes = "|".join(f"{0x5F + n:02X}[0-9A-F]{{0,{2 * n}}}" for n in range(1, 33))
    return f"({pushes}|[0-9A-F]{{2}})"


def opcodes(code):
    """Opcodes of a binary column as hex with their immediates: matches go left to right, as a walk does."""
    return F.regexp_extract_all(F.hex(code), F.lit(opcode_pattern()), F.lit(1))


def with_opcode_flags(df: DataFrame, code: str = "code") -> DataFrame:
    """df with uses_push0, is_erc20, is_erc721, is_erc1155, is_proxy_eip1967, is_proxy_minimal.

    Standards exclude one another: 1155 before 721 before 20, each with all its selectors.
    """
    telling = ["5F", *("63" + s for s in ERC20 + ERC721 + ERC1155), "7F" + EIP1967_SLOT]
    out = df.withColumn("_ops", F.array_intersect(opcodes(F.col(code)), F.array(*map(F.lit, telling))))
    has = lambda selectors: F.forall(F.array(*(F.lit("63" + s) for s in selectors)), lambda s: F.array_contains("_ops", s))
    out = out.withColumns({"_20": has(ERC20), "_721": has(ERC721), "_1155": has(ERC1155), "_hex": F.hex(code)})
    minimal = (F.octet_length(code) == 45) & (F.substring("_hex", 1, 20) == EIP1167_PREFIX) & (F.substring("_hex", 61, 30) == EIP1167_SUFFIX)
    return out.withColumns({
        "uses_push0": F.array_contains("_ops", "5F"),
        "is_erc1155": F.col("_1155"),
        "is_erc721": F.col("_721") & ~F.col("_1155"),
        "is_erc20": F.col("_20") & ~F.col("_721") & ~F.col("_1155"),
        "is_proxy_eip1967": F.array_contains("_ops", "7F" + EIP1967_SLOT),
        "is_proxy_minimal": minimal,
    }).drop("_ops", "_20", "_721", "_1155", "_hex")


def trailer(code):
    """The metadata bytes: the last two bytes are their length; null if it is 0 or doesn't fit."""
    n = F.octet_length(code)
    size = F.conv(F.hex(F.substring(code, -2, 2)), 16, 10).cast("int")
    fits = (n >= 4) & (size > 0) & (size + 2 <= n)
    return F.when(fits, F.substring(code, n - 1 - size, size))


class _Bad(Exception):
    pass


class _Reader:
    """The few kinds of CBOR items that compilers write."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        part = self.data[self.at : self.at + n]
        if len(part) < n:
            raise _Bad
        self.at += n
        return part

    def head(self) -> tuple[int, int]:
        b = self.take(1)[0]
        return b >> 5, b & 31

    def number(self, info: int) -> int:
        if info < 24:
            return info
        if info > 26:
            raise _Bad
        return int.from_bytes(self.take(1 << info - 24), "big")

    def text(self, info: int) -> str:
        try:
            return self.take(self.number(info)).decode()
        except UnicodeDecodeError:
            raise _Bad from None

    def value(self) -> bytes | None:
        major, info = self.head()
        if major == 2:
            return self.take(self.number(info))
        if major == 3:
            self.text(info)
        elif major != 7:
            try:
                self.number(info)
            except _Bad:
                pass
        return None


def parse_trailer(data: bytes) -> tuple[str | None, str | None, bool]:
    """Language, compiler version, whether a source hash is named; any error discards all."""
    language = version = None
    sourced, r = False, _Reader(data)
    try:
        major, info = r.head()
        if major != 5:
            raise _Bad
        size = r.number(info)
        if size > 32 or size > len(data) // 2:
            raise _Bad
        items = []
        for _ in range(size):
            kind, info = r.head()
            if kind != 3:
                raise _Bad
            items.append((r.text(info), r.value()))
    except _Bad:
        return None, None, False
    for key, value in items:
        if key in ("solc", "vyper"):
            language = "solidity" if key == "solc" else "vyper"
            if value is not None:
                version = ".".join(map(str, value[:3])) + "".join(f"-{b}" for b in value[3:]) if len(value) in (3, 4) else None
        sourced |= key in ("ipfs", "bzzr0", "bzzr1")
    return language or ("other" if items else None), version, sourced


def _parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        found = [(None, None, False) if b is None else parse_trailer(b) for b in batch.to_pylist()]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        yield pa.StructArray.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.bool_())], ["language", "compiler_version", "has_source_hash"])


def with_trailer(df: DataFrame, code: str = "code") -> DataFrame:
    """df with language, compiler_version, has_source_hash from the metadata trailer."""
    parsed = F.arrow_udf(_parse, "struct<language:string,compiler_version:string,has_source_hash:boolean>")
    return df.withColumn("_t", parsed(trailer(F.col(code)))).select(*df.columns, "_t.*")


def analyzed(df: DataFrame, code: str = "code") -> DataFrame:
    return with_trailer(with_opcode_flags(df, code), code)
