"""Keyed tables: merges equal full outer joins, leave untouched partitions alone, and take a batch once."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from matchlake.operators import upsert as u
from matchlake.sources.keyed import KeyedTable, merge_sink
from tests.conftest import rows_of

RULE = {"v": "keep", "n": "greatest"}


def files(path) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for d, _, names in os.walk(path):
        if "_part=" in d:
            out[d.rpartition("_part=")[2]] = {f"{f} {os.stat(f'{d}/{f}').st_mtime_ns}" for f in names if f.endswith(".parquet")}
    return out


def test_a_batch_of_one_partition_leaves_63(spark, tmp_path):
    old = spark.range(5000).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.col("id").alias("n"))
    table = KeyedTable.create(old, str(tmp_path / "t"), ["k"])
    before = files(tmp_path)
    assert len(before) == 64
    batch = old.filter("k = 77").withColumn("v", F.lit("new"))
    (part,) = table.merge(batch, lambda a, b: u.upsert(a, b, ["k"], RULE))
    after = files(tmp_path)
    assert [p for p in before if before[p] != after[p]] == [str(part)] and after.keys() == before.keys()
    assert rows_of(table.read().toPandas()) == rows_of(u.upsert(old, batch, ["k"], RULE).toPandas())
    # the scan of a merge lists that partition's files only
    assert {f.rpartition("_part=")[2].partition("/")[0] for f in table.read([part]).inputFiles()} >= {str(part)}
    plan = table.read([part])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_part" in plan


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    table = KeyedTable.create(spark.createDataFrame([], "k long, submissions long, created_at long, updated_at long, source string"), str(tmp_path / "t"), ["k"], 8)
    sink = merge_sink(table, lambda old, rows: u.count_into(old, rows, "k", "us", "s", "id"))
    one = spark.range(100).select((F.col("id") % 10).alias("k"), F.col("id").alias("us"), F.lit("a").alias("s"), "id")
    two = one.filter("k < 5").withColumn("us", F.col("us") + 1000).withColumn("s", F.lit("b"))
    sink(one, 0)
    whole = rows_of(table.read().toPandas())
    sink(one, 0)
    assert rows_of(table.read().toPandas()) == whole
    # a crash between two partitions: only some of them have batch 1 when it comes again
    parts = table.touched(two)
    table.merge(two.filter(table._part() == parts[0]), lambda old, rows: u.count_into(old, rows, "k", "us", "s", "id"), 1)
    sink(two, 1)
    sink(two, 1)
    got = {r.k: (r.submissions, r.source) for r in table.read().collect()}
    assert got == {k: (20, "b") if k < 5 else (10, "a") for k in range(10)}
    sink(one.limit(0), 2)
    assert table.read().count() == 10


def test_null_keys_and_new_partitions(spark, tmp_path):
    old = spark.createDataFrame([(None, "a"), (1, "b")], "k long, v string")
    table = KeyedTable.create(old, str(tmp_path / "t"), ["k"], 4)
    table.merge(spark.createDataFrame([(k, "c") for k in range(2, 9)], "k long, v string"), lambda a, b: u.append(a, b))
    assert table.read().count() == 9 and table.read().filter("k IS NULL").first().v == "a"
