"""Slices of hot keys: the rows of the plain windows, and no task with a tenth of the table."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from matchlake.operators import segments, temporal
from matchlake.plans import skewed
from matchlake.plans.registry import QUERIES, SQL, Tables
from tests.conftest import duck, rows_of

SF = "/root/testdata/sf0.01"
KEYS, ORDER = ["k"], ["t", "i"]


@pytest.fixture(scope="module")
def rows(spark):
    """A key with half of the rows, one with all its rows at one time, few others, null keys, times and values."""
    rng = random.Random(3)
    made = []
    for i in range(3000):
        key = rng.choice(["hot", "hot", "hot", "tied", "a", "b", None])
        t = 7 if key == "tied" else None if rng.random() < 0.01 else rng.randint(0, 400) * 30_000_000_000
        made.append((key, t, i, rng.choice([None, 1.0, 2.5, 4.0]), rng.choice(["x", "y", "z", None])))
    return spark.createDataFrame(made, "k string, t long, i long, v double, kind string").cache()


def same(a, b):
    assert rows_of(a.toPandas()) == rows_of(b.toPandas())


@pytest.mark.parametrize("size", [40, 700, 10**6])
def test_equal_to_plain_windows(rows, size):
    is_x = F.col("kind") == "x"
    same(segments.running_counts(rows, KEYS, "t", {"n": is_x, "all": F.lit(True)}, size), temporal.running_counts(rows, KEYS, "t", {"n": is_x, "all": F.lit(True)}))
    same(segments.lag_delta(rows, KEYS, ORDER, "v", rows=size), temporal.lag_delta(rows, KEYS, ORDER, "v"))
    same(segments.entered(rows, KEYS, ORDER, is_x, size), temporal.entered(rows, KEYS, ORDER, is_x))
    same(segments.anchor_windows(rows, KEYS, ORDER, is_x, size), temporal.anchor_windows(rows, KEYS, ORDER, is_x))
    known = rows.filter("t IS NOT NULL")
    same(segments.streaks(known, KEYS, ORDER, "t", rows=size), temporal.streaks(known, KEYS, ORDER, "t"))
    right = known.filter("kind = 'y'").select("k", "t", F.col("i").alias("j"), F.col("v").alias("w"))
    left = known.filter(is_x).select("k", "t", "i")
    for offset in (0, 90_000_000_000):
        same(segments.asof_backward(left, right, KEYS, "t", "t", ["w", "j"], "j", offset, size), temporal.asof_backward(left, right, KEYS, "t", "t", ["w", "j"], "j", offset))


def test_empty(rows):
    assert segments.lag_delta(rows.limit(0), KEYS, ORDER, "v").count() == 0


def largest(df):
    """Rows of the largest task that makes df, and all rows. All columns are read, so that no window is pruned."""
    each = df.withColumn("_task", F.spark_partition_id()).groupBy("_task").agg(F.count("*").alias("n"), F.max(F.struct(*df.columns)).alias("_all"))
    return each.agg(F.max("n"), F.sum("n"), F.max("_all")).first()


def test_a_hot_key_is_many_slices(spark):
    """Half of the stream is one user's: slices are about as large as asked for, and no window task reads a tenth of the rows."""
    x = Tables(spark, SF)
    cut = segments.sliced(skewed.stream(x), ["user_id"], "us", skewed.ROWS)
    sizes = [r["count"] for r in cut.filter("user_id = -1").groupBy("_slice").count().collect()]
    assert sum(sizes) == 5000 and max(sizes) <= 1.2 * skewed.ROWS and cut.filter("user_id <> -1 AND _slice IS NOT NULL").count() == 0
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("w1_running_counts_hot_key", "w2_lag_delta_hot_key", "w18_streaks_hot_key"):
            out = QUERIES[name](spark, SF)
            most = largest(out)
            assert most[1] == 10_000 and most[0] < 1_000, (name, most)
        plain = temporal.running_counts(skewed.stream(x), ["user_id"], "us", {"n": F.lit(True)})
        assert largest(plain)[0] > 5_000
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", [n for n in SQL if n.endswith("_hot_key")])
def test_hot_key_sql(spark, name):
    assert rows_of(QUERIES[name](spark, SF).toPandas()) == rows_of(duck(SF).sql(SQL[name]).df())
