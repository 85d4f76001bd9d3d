"""Joins: anti and semi forms, lookups with defaults, radius counts, nearest matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing_from(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys other lacks (J8, O1 to O3, S20). Null keys match nothing, so they stay."""
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


def not_in(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """SQL's NOT IN: nothing passes once other holds a null, and a null key passes only an empty other."""
    spark = df.sparkSession
    return spark.sql(f"SELECT * FROM {{df}} d WHERE d.{key} NOT IN (SELECT o.{other_key} FROM {{other}} o)", df=df, other=other)


def present_in(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys other has (J4, J6, S14). The side of keys is broadcast when Spark finds it small."""
    return df.join(other.select(*keys).distinct(), keys, "left_semi")


def lookup_or(df: DataFrame, dim: DataFrame, keys: list[str], value: str, default: object) -> DataFrame:
    """df with value from dim, default where dim lacks the keys."""
    return df.join(dim.select(*keys, value), keys, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def any_one(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One value a key: the smallest, so that the answer is the same each time."""
    return df.groupBy(*keys).agg(F.min(value).alias(value))


def count_within(points: DataFrame, others: DataFrame, keys: list[str], x: str, y: str, radius: float, counted: dict[str, Column]) -> DataFrame:
    """points with the number of others of the same keys within a radius, one count for each condition.

    others must have the columns _x and _y. The equi-join comes first; the distance is a filter in the counts.
    """
    joined = points.join(others, keys, "left")
    near = (F.col("_x") - F.col(x)) * (F.col("_x") - F.col(x)) + (F.col("_y") - F.col(y)) * (F.col("_y") - F.col(y)) <= radius * radius
    return joined.groupBy(*points.columns).agg(*(F.count_if(near & c).alias(n) for n, c in counted.items()))


def positions(df: DataFrame, array: str, upto: int, name: str) -> DataFrame:
    """The first elements of an array, a row each, with their places from 0."""
    return df.select("*", F.posexplode(F.slice(array, 1, upto)).alias("slot", name)).drop(array)


def nearest_scalar(left: DataFrame, right: DataFrame, on: str, right_on: str, right_id: str, low: float = 0.0, high: float = 1.0, cells: int = 1024) -> DataFrame:
    """left with the id of the right row whose scalar is nearest; ties go to the smallest id.

    No cross join: the nearest row is the last at or below, or the first above, so both sides form one ordered
    relation. It is cut into cells of the scalar's range, and each cell's edge rows carry over to the others;
    of these there is one a cell.
    """
    one = right.groupBy(F.col(right_on).cast("double").alias("_v")).agg(F.min(right_id).alias("_id"))
    a = left.select("*", F.col(on).cast("double").alias("_v"), F.lit(True).alias("_left"))
    b = one.select("_v", F.struct(F.col("_v").alias("v"), F.col("_id").alias("id")).alias("_held"))
    cell = F.floor((F.col("_v") - low) / (high - low) * cells)
    rows = a.unionByName(b, allowMissingColumns=True).withColumn("_part", F.least(F.greatest(cell, F.lit(0)), F.lit(cells - 1)))
    return _carry_both(rows, left.columns)


def _carry_both(rows: DataFrame, columns: list[str]) -> DataFrame:
    edges = rows.groupBy("_part").agg(F.max("_held").alias("_top"), F.min("_held").alias("_bottom"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    edges = edges.select("_part", F.max("_top").over(before).alias("_under"), F.min("_bottom").over(after).alias("_over"))
    up = Window.partitionBy("_part").orderBy("_v").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("_part").orderBy("_v").rangeBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("_lo", F.max("_held").over(up)).withColumn("_hi", F.min("_held").over(down)).filter("_left")
    rows = rows.join(F.broadcast(edges), "_part", "left").withColumn("_lo", F.coalesce("_lo", "_under")).withColumn("_hi", F.coalesce("_hi", "_over"))
    low, high = F.col("_v") - F.col("_lo.v"), F.col("_hi.v") - F.col("_v")
    take_low = F.col("_hi").isNull() | (low < high) | ((low == high) & (F.col("_lo.id") <= F.col("_hi.id")))
    return rows.select(*columns, F.when(take_low & F.col("_lo").isNotNull(), F.col("_lo.id")).otherwise(F.col("_hi.id")).alias("nearest_id"))
