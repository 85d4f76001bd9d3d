"""Ordered operators: running counts, as-of joins, deltas, edges, anchor windows, streaks.

Each is one window over a hash partitioning by the keys, so chained operators on the same keys share a shuffle.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.scalars import seeded
from matchlake.operators.splits import places_by


def so_far(keys: list[str], order: str) -> Window:
    """Everything up to and including the row's time; rows of the same time count together."""
    return Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)


def running_counts(df: DataFrame, keys: list[str], order: str, counted: dict[str, Column]) -> DataFrame:
    """df with a running conditional count for each name in counted."""
    over = so_far(keys, order)
    return df.withColumns({name: F.count_if(when).over(over) for name, when in counted.items()})


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, values: list[str], tie: str | None = None, offset: int = 0) -> DataFrame:
    """left with the values of the last right row of its keys at or before left_on - offset.

    Of right rows with one time that with the largest tie wins. Values are null where there is no such row.
    One shuffle: both sides are put in one relation and the newest right row is carried forward.
    """
    held = F.struct(F.col(right_on).alias("at"), *([F.col(tie).alias("tie")] if tie else []), *(F.col(v).alias(f"value_{k}") for k, v in enumerate(values)))
    empty = left.columns
    a = left.select(*empty, (F.col(left_on) - offset).alias("_time"), F.lit(True).alias("_left"))
    b = right.select(*keys, F.col(right_on).alias("_time"), held.alias("_held"))
    both = a.unionByName(b, allowMissingColumns=True)
    carried = F.max("_held").over(so_far(keys, "_time"))
    out = both.withColumn("_last", carried).filter("_left")
    return out.select(*empty, *(F.col(f"_last.value_{k}").alias(v) for k, v in enumerate(values)))


def lag_delta(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "delta") -> DataFrame:
    """df with value minus the previous row's; null in the first row."""
    return df.withColumn(name, F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def entered(df: DataFrame, keys: list[str], order: list[str], inside: Column) -> DataFrame:
    """Rows in which a condition holds that did not hold in the row before; a first row never enters."""
    before = F.lag("_in").over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_in", inside).withColumn("_was", before).filter("_in AND NOT _was").drop("_in", "_was")


def anchor_windows(df: DataFrame, keys: list[str], order: list[str], is_anchor: Column) -> DataFrame:
    """df with window_id, the number of anchors up to the row: 0 before the first, the last one open."""
    over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("window_id", F.count_if(is_anchor).over(over))


def window_labels(df: DataFrame, keys: list[str], order: list[str], kind: str, is_anchor: Column, kinds: list[str], none: str = "none") -> DataFrame:
    """One row a closed window: its first and last event kind, and a flag for each kind seen.

    The last window of a key is open, so it has no labels.
    """
    rows = anchor_windows(df.withColumn("_anchor", is_anchor), keys, order, F.col("_anchor"))
    last = F.max("window_id").over(Window.partitionBy(*keys))
    rows = rows.withColumn("_last", last).filter((F.col("window_id") > 0) & (F.col("window_id") < F.col("_last")))
    at = F.struct(*order)
    own = ~F.col("_anchor")
    return rows.groupBy(*keys, "window_id").agg(
        F.coalesce(F.min_by(F.when(own, F.col(kind)), F.when(own, at)), F.lit(none)).alias("first_kind"),
        F.coalesce(F.max_by(F.when(own, F.col(kind)), F.when(own, at)), F.lit(none)).alias("last_kind"),
        *(F.max(F.when(own & (F.col(kind) == k), 1).otherwise(0)).alias(f"has_{k}") for k in kinds),
    )


def lead_delta(df: DataFrame, keys: list[str], order: list[str], value: str, valid: Column) -> DataFrame:
    """df with next_delta (the next row's value minus this one's) and both_valid."""
    over = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_valid", valid)
    return rows.withColumn("next_delta", F.lead(value).over(over) - F.col(value)).withColumn("both_valid", F.coalesce(F.lead("_valid").over(over) & F.col("_valid"), F.lit(False))).drop("_valid")


def first_at_or_after(df: DataFrame, keys: list[str], order: str, target: float, value: str, tie: str | None = None) -> DataFrame:
    """Each key's value at the first row at or after target; else at its first row (W10). Of equal times the smallest tie."""
    at = F.struct((F.col(order) < target).alias("early"), F.col(order).alias("at"), *([F.col(tie).alias("tie")] if tie else []))
    return df.groupBy(*keys).agg(F.min_by(value, at).alias(value))


def nth_row(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Each key's n-th row, counted from 1."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") == n).drop("_rn")


def previous_values(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """df with prev_<value>, the values of the row before."""
    over = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"prev_{v}": F.lag(v).over(over) for v in values})


def offsets(df: DataFrame, keys: list[str], order: list[str], count: str) -> DataFrame:
    """df with offset, the sum of the counts before the row."""
    over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(count).over(over), F.lit(0)))


def seeded_order(df: DataFrame, key: str, seed: int) -> DataFrame:
    """key, place: places in an order that depends on the seed and the key alone (W15). No task sorts everything."""
    return places_by(df.select(key), key, seeded(seed, F.col(key)))


def first_of(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def last_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The n rows of each key that the order puts first."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def throughput(df: DataFrame, ts: str, width: str = "30 seconds") -> DataFrame:
    """Rows in each tumbling window."""
    return df.groupBy(F.window(ts, width).alias("_w")).agg(F.count("*").alias("n")).select(F.unix_micros(F.col("_w.start").cast("timestamp")).alias("start_us"), "n")


def streaks(df: DataFrame, keys: list[str], order: list[str], micros: str, day_us: int = 86_400_000_000) -> DataFrame:
    """df with streak: within a day it stays, after one whole day it grows, after more it begins anew at 1."""
    over = Window.partitionBy(*keys).orderBy(*order)
    gap = F.floor((F.col(micros) - F.lag(micros).over(over)) / day_us)
    rows = df.withColumn("_gap", gap)
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_gap").isNull() | (F.col("_gap") > 1), 1).otherwise(0)).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(*keys, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("streak", 1 + F.sum(F.when(F.col("_gap") == 1, 1).otherwise(0)).over(within)).drop("_gap", "_run")


def fold(df: DataFrame, keys: list[str], step, schema: str) -> DataFrame:
    """A keyed ordered fold in pandas, for state that no frame can say."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return step(frame)

    return df.groupBy(*keys).applyInPandas(run, schema)

