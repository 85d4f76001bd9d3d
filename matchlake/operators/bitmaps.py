"""Membership by bitmaps of key hashes before exact joins.

The keys of one side become a bitmap: bit h of a number of bits is set if some key hashes to it. It is built by partial aggregation and
broadcast; its size is bounded (BITS). A row whose bit is not set has no partner, so it never shuffles: an anti-join lets it
pass, a semi-join drops it. Rows whose bit is set are joined exactly. Null keys have no partner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits at most, 16 MB; and bits for each key, which let one row in so many through that has no partner.
BITS, PER_KEY = 1 << 27, 16
#: Bits of one bitmap, fixed by Spark.
ROW_BITS = 32_768


def _position(keys: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits)) + 1  # Spark counts bits from 1


def _marked(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame | None:
    """df with _may, whether other may hold the row's keys; None where a bitmap of BITS would be too full to tell."""
    held = other.select(*keys).na.drop()
    n = held.count()
    bits = max(ROW_BITS, 1 << (max(1, n * PER_KEY) - 1).bit_length())
    if n * 2 > BITS:
        return None
    bits = min(bits, BITS)
    at = _position(keys, bits)
    maps = held.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
    rows = df.withColumn("_at", F.when(~_any_null(keys), _position(keys, bits)))
    rows = rows.withColumn("_bucket", F.bitmap_bucket_number("_at")).withColumn("_bit", F.bitmap_bit_position("_at"))
    rows = rows.join(F.broadcast(maps), "_bucket", "left")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, (F.col("_bit") % 8).cast("int")).bitwiseAND(1) == 1
    return rows.withColumn("_may", F.coalesce(is_set, F.lit(False))).select(*df.columns, "_may")


def _any_null(keys: list[str]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | F.col(k).isNull()
    return out


def missing_from(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys other lacks (J8, O1 to O3, S20); those that the bitmap rules out pass without a shuffle. Null keys match nothing, so they stay."""
    rows = _marked(df, other, keys)
    if rows is None:
        return df.join(other.select(*keys), keys, "left_anti")
    return rows.filter("NOT _may").drop("_may").unionByName(rows.filter("_may").drop("_may").join(other.select(*keys), keys, "left_anti"))


def present_in(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys other has (J4, J6, S14); those that the bitmap rules out go before the join."""
    rows = _marked(df, other, keys)
    return (df if rows is None else rows.filter("_may").drop("_may")).join(other.select(*keys), keys, "left_semi")


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """old and the first row of each key of new that old lacks (K1)."""
    from matchlake.operators.temporal import first_of

    return old.unionByName(first_of(missing_from(new, old, keys), keys, [seq]).drop(seq))
