"""Packing rows into batches under budgets, without a large key in one task.

A key of up to `rows` rows moves once: its rows are numbered by a window, which leaves them in order, and one pass over them deals out batches.

Of larger keys no task sees all rows. Where a batch that begins at a row ends depends on that row alone: at the last row up to which count times largest size fits every
budget. Both grow with the batch, so the end is found by halving, over the largest sizes of stretches of 1, 2, 4, ... rows. Which rows
begin a batch is then a matter of pointers: the first row does, and where a batch ends the next begins. Following these
1, 2, 4, ... at a time marks all beginnings in as many rounds as the number of batches has binary digits.

Every step is an equi-join by key and position, so rows of one key spread like any others. Each of them moves all rows again, for which it serves large keys only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlake.operators.segments import SLICE_ROWS, running, sliced
from matchlake.sources.scratch import drop_table, materialise, scratch


def _fits(top: Column, rows: Column, budgets: list[int]) -> Column:
    return F.forall(F.arrays_zip(top.alias("size"), F.array(*(F.lit(b).cast("long") for b in budgets)).alias("most")), lambda x: x["size"] * rows <= x["most"])


def _larger(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def stretches(rows: DataFrame, keys: list[str], budgets: list[int]) -> list[DataFrame]:
    """Table k: keys, _pos, _top, the largest sizes of the 2**k rows from _pos on, where so many rows are there and fit. The first holds all rows."""
    levels = [rows.select(*keys, "_pos", "_top")]
    while True:
        half = 1 << (len(levels) - 1)
        later = levels[-1].select(*keys, (F.col("_pos") - half).alias("_pos"), F.col("_top").alias("_more"))
        # a half that doesn't fit makes a whole that doesn't; so what was left out isn't missed
        both = levels[-1].join(later, [*keys, "_pos"]).select(*keys, "_pos", _larger(F.col("_top"), F.col("_more")).alias("_top"))
        level = materialise(both.filter(_fits(F.col("_top"), F.lit(2 * half), budgets)), "stretches")
        if level.isEmpty():
            return levels
        levels.append(level)


def batch_ends(rows: DataFrame, keys: list[str], budgets: list[int]) -> DataFrame:
    """keys, _pos, _next: where the batch after one that begins at _pos would begin."""
    levels = stretches(rows, keys, budgets)
    none = F.transform("_top", lambda _: F.lit(0).cast("long"))
    at = rows.select(*keys, "_pos", F.lit(0).cast("long").alias("_held"), none.alias("_max"))
    for k in range(len(levels) - 1, -1, -1):
        ahead = levels[k].select(*keys, F.col("_pos").alias("_at"), "_top")
        at = at.withColumn("_at", F.col("_pos") + F.col("_held")).join(ahead, [*keys, "_at"], "left")
        top, held = _larger(F.col("_max"), F.col("_top")), F.col("_held") + (1 << k)
        # a batch has its first row, however large
        on = F.col("_top").isNotNull() & (((F.col("_held") == 0) & F.lit(k == 0)) | _fits(top, held, budgets))
        # a column of its own: within the lambda _held could else mean the column that replaces it
        at, on = at.withColumn("_on", F.coalesce(on, F.lit(False))), F.col("_on")
        at = at.select(*keys, "_pos", F.when(on, held).otherwise(F.col("_held")).alias("_held"), F.when(on, top).otherwise(F.col("_max")).alias("_max"))
    return at.select(*keys, "_pos", (F.col("_pos") + F.col("_held")).alias("_next"))


def batch_starts(ends: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _pos, _batch of the rows that begin a batch, from the pointers of all rows."""
    there = ends.select(*keys, F.col("_pos").alias("_next"))
    jump = materialise(ends.join(there, [*keys, "_next"], "left_semi").select(*keys, "_pos", "_next"), "jumps")
    starts, far = ends.filter("_pos = 0").select(*keys, "_pos", F.lit(0).cast("long").alias("_batch")), 1
    while not jump.isEmpty():
        onward = starts.join(jump, [*keys, "_pos"]).select(*keys, F.col("_next").alias("_pos"), (F.col("_batch") + far).alias("_batch"))
        more = materialise(starts.unionByName(onward), "starts")
        second = jump.select(*keys, F.col("_pos").alias("_next"), F.col("_next").alias("_then"))
        twice = materialise(jump.join(second, [*keys, "_next"]).select(*keys, "_pos", F.col("_then").alias("_next")), "jumps")
        drop_table(jump)
        drop_table(starts)
        starts, jump, far = more, twice, 2 * far
    return starts


def in_order(df: DataFrame, keys: list[str], order: list[str], tops: list[Column], budgets: list[int]) -> DataFrame:
    """df with batch, by one pass over the rows of each key, of which a task holds an Arrow batch at a time."""
    names = [f"_top_{n}" for n in range(len(tops))]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    rows = df.select("*", *(t.alias(n) for t, n in zip(tops, names, strict=True))).withColumn("_pos", place)
    columns = df.columns

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, held, most = 0, 0, ()
        for part in parts:
            out = []
            for pos, *own in zip(part["_pos"].to_pylist(), *(part[n].to_pylist() for n in names), strict=True):
                if pos == 1:
                    batch, held, most = 0, 0, own
                else:
                    most = [max(a, b) for a, b in zip(most, own, strict=True)]
                    if any(m * (held + 1) > b for m, b in zip(most, budgets, strict=True)):
                        batch, held, most = batch + 1, 0, own
                held += 1
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*(part[c] for c in columns), pa.array(out, pa.int64())], names=[*columns, "batch"])

    return rows.mapInArrow(deal, T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())]))


def budget_batches(df: DataFrame, keys: list[str], order: list[str], sizes: list[str], budgets: list[int], rows: int = SLICE_ROWS) -> DataFrame:
    """df with batch: rows packed in order while the padded size (rows times the largest) fits every budget.

    A row that fits none is a batch of its own. Null sizes are 0, null keys are a key. order[0] is a number or a time.
    """
    tops = [F.coalesce(F.col(s).cast("long"), F.lit(0).cast("long")) for s in sizes]
    with scratch() as keep:
        cut = sliced(materialise(df, "rows"), keys, order[0], rows)
        small = in_order(cut.filter("_slice IS NULL").drop("_slice"), keys, order, tops, budgets)
        large = cut.filter("_slice IS NOT NULL")
        if large.isEmpty():
            return keep(materialise(small, "batches"))
        one = running(large, keys, order, _pos=("sum", F.lit(1).cast("long")))
        top = F.array(*tops)
        # nulls within a struct are equal, so that rows with a null key find each other
        numbered = materialise(one.withColumn("_pos", F.col("_pos") - 1).withColumn("_top", top).withColumn("_key", F.struct(*keys)), "numbered")
        ends = materialise(batch_ends(numbered, ["_key"], budgets), "ends")
        marked = numbered.join(batch_starts(ends, ["_key"]), ["_key", "_pos"], "left")
        out = running(marked, keys, ["_pos"], batch=("max", F.col("_batch")))
        return keep(materialise(small.unionByName(out.select(*df.columns, "batch")), "batches"))
