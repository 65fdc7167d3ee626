"""Random numbers as column expressions: a counter-based generator on md5 that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bits32(*parts) -> Column:
    """32 random bits (a bigint) of a key; parts are columns or plain values."""
    text = F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    return bits32(*parts) / 4294967296.0


def pick(n, *parts) -> Column:
    """An integer in 0..n-1."""
    return F.floor(uniform(*parts) * n).cast("bigint")


def shuffle_key(*parts) -> Column:
    """Sorting by it shuffles."""
    text = F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.md5(text)


def duck_uniform(text: str) -> str:
    """The same number in DuckDB SQL; text: an expression for the colon-joined key."""
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0)"
