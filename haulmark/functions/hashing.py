"""Stable identifiers, ranks and draws. All come from MD5, SHA-1 or SHA-2, never from a random state,
so that they are the same on every partitioning and on a retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined(*parts: Column) -> Column:
    return F.concat_ws("|", *(p.cast("string") for p in parts))


def stable_long(*parts: Column) -> Column:
    """60 bits of the MD5 of the joined parts."""
    return F.conv(F.substring(F.md5(joined(*parts)), 1, 15), 16, 10).cast("bigint")


def stable_unit(*parts: Column) -> Column:
    """A draw in (0, 1): the first 32 bits of the MD5, centred in their cell."""
    return (F.conv(F.substring(F.md5(joined(*parts)), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def surrogate(prefix: str, size: int, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(joined(*parts)), 1, size))


def fingerprint(*parts: Column) -> Column:
    return F.sha2(joined(*parts), 256)


def sql_long(parts: str) -> str:
    """DuckDB SQL of stable_long over a joined text."""
    return f"CAST('0x' || substr(md5({parts}), 1, 15) AS BIGINT)"


def sql_unit(parts: str) -> str:
    return f"((CAST('0x' || substr(md5({parts}), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
