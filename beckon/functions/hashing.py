"""Stable hash buckets that agree with the published assignment rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_63, TWO_64, TWO_32, TWO_31 = "9223372036854775808", "18446744073709551616", 4294967296, 2147483648


def sha_bucket(text: Column, buckets: int = 100) -> Column:
    """|first eight SHA-256 bytes as a signed big-endian long| mod buckets."""
    unsigned = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    half, full = F.lit(TWO_63).cast("decimal(20,0)"), F.lit(TWO_64).cast("decimal(20,0)")
    magnitude = F.when(unsigned >= half, full - unsigned).otherwise(unsigned)
    return (magnitude % buckets).cast("int")


def java_hash_bucket(text: Column, buckets: int = 100) -> Column:
    """|Java String.hashCode| mod buckets, folding 31*h + c over the UTF-16 units."""
    units = F.hex(F.encode(text, "UTF-16BE"))
    starts = F.filter(F.sequence(F.lit(1), F.length(units) + 1, F.lit(4)), lambda i: i <= F.length(units))
    unsigned = F.aggregate(starts, F.lit(0).cast("bigint"), lambda h, i: (h * 31 + F.conv(F.substring(units, i, 4), 16, 10).cast("bigint")) % TWO_32)
    magnitude = F.when(unsigned >= TWO_31, TWO_32 - unsigned).otherwise(unsigned)
    return (magnitude % buckets).cast("int")


def delivery_id(*parts: Column) -> Column:
    """Deterministic id of a delivery: SHA-256 of its natural key."""
    return F.sha2(F.concat_ws("|", *parts), 256)
