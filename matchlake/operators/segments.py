"""Ordered operators for keys of any size: a key's history is cut into slices, which are scanned apart.

A window over a key runs in one task, however much of the table the key owns. Here a key of more than `rows` rows is cut at
quantiles of its order column; rows of one time stay together. Each slice is scanned alone, with the slice as part of the
partitioning. A second scan, over one row a slice, carries what the slices before it leave (a sum, a maximum, the last row) into each.

The results are those of the operators of the same names in temporal.py. Keys of up to `rows` rows are one slice. The cuts are approximate
quantiles: they set the sizes of slices, not the results. They are broadcast: `rows` grows with the table, so that all cuts
together are at most MAX_CUTS numbers. Rows of one key at one and the same time are one slice, whatever their number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.sources.scratch import materialise

SLICE_ROWS, MAX_CUTS, ACCURACY = 1_000_000, 500_000, 10_000
#: Quantiles that one key is cut at, at most; a larger key has larger slices.
MOST = 5_000


def _position(cuts: Column, value: Column) -> Column:
    """The number of cuts under value, by halving: cuts is an ascending array."""
    ends = F.struct(F.lit(0).alias("low"), F.size(cuts).alias("high"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        under = F.get(cuts, middle) < value
        still = at["low"] < at["high"]
        return F.struct(F.when(still & under, middle + 1).otherwise(at["low"]).alias("low"), F.when(still & ~under, middle).otherwise(at["high"]).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(MOST.bit_length() + 1))
    return F.aggregate(steps, ends, halve)["low"]


def _same(names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in names))


def sliced(df: DataFrame, keys: list[str], order: str, rows: int = SLICE_ROWS) -> DataFrame:
    """df with _slice: null for keys of up to `rows` rows, else the place of the row's order value among the key's cuts. Nulls come first."""
    held = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = held.agg(F.sum("_n"), F.max("_n")).first()
    rows = max(rows, -(-2 * (total[0] or 0) // MAX_CUTS))
    if (total[1] or 0) <= rows:
        return df.withColumn("_slice", F.lit(None).cast("long"))
    n = min(MOST, -(-total[1] // rows))
    big = held.filter(F.col("_n") > rows)
    mine = df.alias("a").join(F.broadcast(big.alias("b")), _same(keys)).select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col(f"a.{order}").alias("_at"), "_n")
    quantiles = F.percentile_approx("_at", [k / n for k in range(1, n)] or [1.0], ACCURACY)
    # every so many of the n quantiles make slices of about `rows` rows
    stride = F.greatest(F.lit(1), F.floor(F.lit(n) * rows / F.max("_n"))).cast("int")
    cuts = mine.groupBy(*keys).agg(quantiles.alias("_all"), stride.alias("_stride"))
    chosen = F.array_distinct(F.filter("_all", lambda _, k: (k + 1) % F.col("_stride") == 0))
    cuts = materialise(cuts.select(*keys, chosen.alias("_cuts")), "cuts")
    found = df.alias("a").join(F.broadcast(cuts.alias("b")), _same(keys), "left")
    place = F.when(F.col("b._cuts").isNotNull(), F.when(F.col(f"a.{order}").isNull(), F.lit(0)).otherwise(_position(F.col("b._cuts"), F.col(f"a.{order}"))))
    return found.select("a.*", place.cast("long").alias("_slice"))


def _carried(rows: DataFrame, keys: list[str], left: dict[str, Column], how: dict[str, Column]) -> DataFrame:
    """rows with what the earlier slices of their key leave: `left` sums a slice up, `how` (over the window of all earlier slices) puts those sums together.

    Only keys that are cut have such rows, one a slice: MAX_CUTS and a few at most, which are broadcast, so that rows don't move for them.
    They are ordered in one place for each key, which has at most MOST.
    """
    after = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.filter(F.col("_slice").isNotNull()).groupBy(*keys, "_slice").agg(*(c.alias(n) for n, c in left.items()))
    sums = sums.select(*keys, "_slice", *(c.over(after).alias(n) for n, c in how.items()))
    sums = sums.filter(reduce(lambda x, y: x | y, (F.col(n).isNotNull() for n in how)))  # first slices get nothing
    return rows.alias("a").join(F.broadcast(sums.alias("b")), _same([*keys, "_slice"]), "left").select("a.*", *(f"b.{n}" for n in how))


def _within(keys: list[str], order: list[str], together: bool) -> Window:
    over = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return over.rangeBetween(Window.unboundedPreceding, Window.currentRow) if together else over.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running(rows: DataFrame, keys: list[str], order: list[str], together: bool = False, **values: tuple[str, Column]) -> DataFrame:
    """rows (sliced) with running values by name: ("sum" | "max" | "min", column) over everything of the key up to the row;
    with together, rows of the same order count together."""
    fold = {"sum": F.sum, "max": F.max, "min": F.min}
    join = {"sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), "max": F.greatest, "min": F.least}
    rows = rows.withColumns({f"_value_{n}": c for n, (_, c) in values.items()})
    out = _carried(rows, keys, {f"_left_{n}": fold[h](f"_value_{n}") for n, (h, _) in values.items()}, {f"_carry_{n}": fold[h](f"_left_{n}") for n, (h, _) in values.items()})
    within = _within(keys, order, together)
    out = out.withColumns({n: join[h](fold[h](f"_value_{n}").over(within), F.col(f"_carry_{n}")) for n, (h, _) in values.items()})
    return out.drop(*(f"{p}{n}" for n in values for p in ("_value_", "_carry_")))


def before(rows: DataFrame, keys: list[str], order: list[str], **values: Column) -> DataFrame:
    """rows (sliced) with values of the row before, by name; null in a key's first row."""
    rows = rows.withColumn("_now", F.struct(*(c.alias(n) for n, c in values.items())))
    last = {"_left": F.max_by("_now", F.struct(*order))}
    out = _carried(rows, keys, last, {"_carry": F.last("_left")})
    prior = F.coalesce(F.lag("_now").over(Window.partitionBy(*keys, "_slice").orderBy(*order)), F.col("_carry"))
    out = out.withColumn("_prior", prior)
    return out.withColumns({n: F.col(f"_prior.{n}") for n in values}).drop("_now", "_prior", "_carry")


def places(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """df with place, each row's number among its key's rows by an order column of any type, from 0. Ranges of rows are numbered
    apart, and the counts of those before are added. Of equal rows either may come first."""
    ranges = materialise(df.repartitionByRange(*keys, order).withColumn("_slice", F.spark_partition_id().cast("long")), "ranges")
    return running(ranges, keys, [order], place=("sum", F.lit(1).cast("long"))).withColumn("place", F.col("place") - 1).drop("_slice")


def running_counts(df: DataFrame, keys: list[str], order: str, counted: dict[str, Column], rows: int = SLICE_ROWS) -> DataFrame:
    """df with a running conditional count for each name in counted; rows of the same time count together."""
    ones = {n: ("sum", F.when(c, 1).otherwise(0)) for n, c in counted.items()}
    return running(sliced(df, keys, order, rows), keys, [order], True, **ones).drop("_slice")


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, values: list[str], tie: str | None = None, offset: int = 0, rows: int = SLICE_ROWS) -> DataFrame:
    """left with the values of the last right row of its keys at or before left_on - offset."""
    held = F.struct(F.col(right_on).alias("at"), *([F.col(tie).alias("tie")] if tie else []), *(F.col(v).alias(f"value_{k}") for k, v in enumerate(values)))
    a = left.select(*left.columns, (F.col(left_on) - offset).alias("_time"), F.lit(True).alias("_left_row"))
    b = right.select(*keys, F.col(right_on).alias("_time"), held.alias("_held"))
    both = sliced(a.unionByName(b, allowMissingColumns=True), keys, "_time", rows)
    out = running(both, keys, ["_time"], True, _last=("max", F.col("_held"))).filter("_left_row")
    return out.select(*left.columns, *(F.col(f"_last.value_{k}").alias(v) for k, v in enumerate(values)))


def lag_delta(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "delta", rows: int = SLICE_ROWS) -> DataFrame:
    """df with value minus the previous row's; null in the first row."""
    out = before(sliced(df, keys, order[0], rows), keys, order, _before=F.col(value))
    return out.withColumn(name, F.col(value) - F.col("_before")).drop("_before", "_slice")


def entered(df: DataFrame, keys: list[str], order: list[str], inside: Column, rows: int = SLICE_ROWS) -> DataFrame:
    """Rows in which a condition holds that did not hold in the row before; a first row never enters."""
    out = before(sliced(df.withColumn("_in", inside), keys, order[0], rows), keys, order, _was=F.col("_in"))
    return out.filter("_in AND NOT _was").drop("_in", "_was", "_slice")


def anchor_windows(df: DataFrame, keys: list[str], order: list[str], is_anchor: Column, rows: int = SLICE_ROWS) -> DataFrame:
    """df with window_id, the number of anchors up to the row: 0 before the first, the last one open."""
    return running(sliced(df, keys, order[0], rows), keys, order, window_id=("sum", F.when(is_anchor, 1).otherwise(0))).drop("_slice")


def streaks(df: DataFrame, keys: list[str], order: list[str], micros: str, day_us: int = 86_400_000_000, rows: int = SLICE_ROWS) -> DataFrame:
    """df with streak: within a day it stays, after one whole day it grows, after more it begins anew at 1.

    No run is gathered: a streak is the count of growing rows so far, less that count where the run began, which is the largest one
    at any beginning so far as the count never falls.
    """
    out = before(sliced(df, keys, order[0], rows), keys, order, _before=F.col(micros))
    gap = F.floor((F.col(micros) - F.col("_before")) / day_us)
    out = out.withColumn("_gap", gap).withColumn("_begins", F.col("_gap").isNull() | (F.col("_gap") > 1))
    out = running(out, keys, order, _grown=("sum", F.when(F.col("_gap") == 1, 1).otherwise(0)))
    out = running(out, keys, order, _then=("max", F.when(F.col("_begins"), F.col("_grown"))))
    return out.withColumn("streak", 1 + F.col("_grown") - F.col("_then")).drop("_before", "_gap", "_begins", "_grown", "_then", "_slice")
