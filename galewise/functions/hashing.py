"""Repeatable hash buckets that other SQL engines can compute as well."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 1 << 28  # first seven hexadecimal digits of an md5


def hash28(*parts: Column) -> Column:
    """Integer in ``[0, 2^28)`` from the md5 of the parts joined with ``:``."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("int")


def hash60(*parts: Column) -> Column:
    """Integer in ``[0, 2^60)``, for draws from large ranges: the first fifteen digits of the md5."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def hash_bucket(buckets: int, *parts: Column) -> Column:
    return F.pmod(hash28(*parts), F.lit(buckets))
