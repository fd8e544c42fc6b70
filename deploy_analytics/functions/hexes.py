"""Hexadecimal text and bytes."""

from __future__ import annotations

from pyspark.sql import functions as F


def unprefixed(column):
    r"""Hex text without a leading \\x, \x or 0x."""
    return F.regexp_replace(column, r"^(?:\\\\x|\\x|0x)", "")


def from_hex(column, digits: int | None = None):
    """Bytes of prefixed hex text; null unless all digits are hex, even in number, and as many as asked for."""
    bare = unprefixed(column)
    count = f"{{{digits}}}" if digits else "*"
    fits = bare.rlike(f"^[0-9a-fA-F]{count}$") & (F.length(bare) % 2 == 0)
    return F.when(fits, F.unhex(bare))


def to_hex(column):
    """0x and lower-case digits; null stays null."""
    return F.concat(F.lit("0x"), F.lower(F.hex(column)))
