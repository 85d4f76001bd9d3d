"""Packed columns, bounded batches, rows as one column, and joins that stand hot keys."""

from __future__ import annotations

import contextlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from matchlake.sources.scratch import drop_path, drop_table, fresh_path, materialise, scratch, shared_dir  # noqa: F401  for the operators

#: A key is hot when it owns more than one row in this many; so there are at most as many hot keys.
HOT_SHARE = 1000
#: Rows and bytes of an Arrow batch, at most; a longer text is a batch of its own.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def pack(*columns: np.ndarray) -> bytes:
    """Columns of fixed width, byte planes apart so that they compress."""
    head = np.array([x for c in columns for x in (len(c), c.itemsize)], "<u4").tobytes()
    return bytes([len(columns)]) + head + zlib.compress(b"".join(np.ascontiguousarray(c.view("u1").reshape(-1, c.itemsize).T).tobytes() for c in columns if len(c)), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    """The columns that pack() made one blob of."""
    n = blob[0]
    data, at, out = zlib.decompress(blob[1 + 8 * n :]), 0, []
    for rows, width in np.frombuffer(blob[1 : 1 + 8 * n], "<u4").reshape(-1, 2).tolist():
        out.append(np.frombuffer(data[at : at + rows * width], "u1").reshape(width, rows).T.copy().view(f"<u{width}").ravel() if rows else np.empty(0, f"<u{width}"))
        at += rows * width
    return out


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds in this session: workers keep a batch, and some hold two, in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def tidied(run: Callable) -> Callable:
    """A function of Arrow batches that gives unused memory back when a task ends: workers live on, and would keep it."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


def give_back() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def boxed(df: DataFrame, **more: Column) -> DataFrame:
    """df's rows as one column _row, and more columns beside it: names of df can't clash with these."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), *(c.alias(n) for n, c in more.items()))


def unboxed(df: DataFrame, *more: str) -> DataFrame:
    """The columns of _row but those named in more, and then these."""
    kept = [f for f in df.schema["_row"].dataType.names if f not in more]
    return df.select(*(F.col("_row").getField(f).alias(f) for f in kept), *more)


def widened(df: DataFrame, more: str) -> StructType:
    """df's schema and the fields of a DDL string after it."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is computed once however often then uses it, also within lambdas."""
    return F.get(F.transform(F.array(value), lambda v: then(v)), F.lit(0))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def bounded_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """At most bound distinct keys, those with the smallest hashes: the same ones on every run."""
    keys = rows.select(F.col(key).alias("_key")).filter(F.col("_key").isNotNull()).distinct()
    return keys.orderBy(F.xxhash64("_key"), "_key").limit(bound)


def lookup_hot_safe(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left-outer lookup of one right row per key, where a key may own any share of left's rows.

    right has one row for each key, and in weight the number of left rows that hold it. Keys with more
    than total / HOT_SHARE rows, of which there can be HOT_SHARE at most, are broadcast; the rest shuffle.
    """
    edge = max(1, total // HOT_SHARE)
    values = [c for c in right.columns if c not in (key, weight)]
    hot = right.filter(F.col(weight) > edge).select(F.col(key).alias("_hot"), F.struct(*values).alias("_h"))
    joined = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    cold = right.filter(F.col(weight) <= edge).select(F.col(key).alias("_cold"), F.struct(*values).alias("_c"))
    # hot rows need no partner: their value comes from the broadcast, and a salt as second key spreads them. The other
    # side's salt is 0 too, but not as a constant: Spark would fold that, join by the first key only, and send all hot rows to one task
    joined = joined.withColumn("_probe", F.when(F.col("_hot").isNull(), F.col(key)))
    joined = joined.withColumn("_deal", F.when(F.col("_probe").isNull(), F.xxhash64(*left.columns)).otherwise(F.lit(0).cast("long")))
    cold = cold.withColumn("_zero", F.pmod(F.xxhash64("_cold"), F.lit(1).cast("long")))
    out = joined.join(cold, (F.col("_probe") == F.col("_cold")) & (F.col("_deal") == F.col("_zero")), "left")
    picked = [F.coalesce(F.col(f"_h.{v}"), F.col(f"_c.{v}")).alias(v) for v in values]
    return out.select(*left.columns, *picked)
