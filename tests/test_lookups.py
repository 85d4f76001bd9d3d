"""Trigram search against ILIKE, and bitmap joins against plain ones, with what they read and shuffle."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from matchlake.operators import bitmaps, joins, trigrams
from tests.conftest import rows_of


def names(n: int, seed: int):
    rng = random.Random(seed)
    bits = ["an", "Na", "é", "É", "%", "_", "\\", "ß", "x", "1", " ", "ll", "İ"]
    return [(k, None if k % 50 == 7 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for k in range(n)]


def test_search_equals_a_scan(spark, tmp_path):
    df = spark.createDataFrame(names(1500, 1), "id long, name string")
    index = trigrams.TrigramIndex(spark, str(tmp_path / "i"), "id", "name", 8)
    index.add(df.filter("id < 1000"))
    index.add(df.filter("id >= 1000"))
    for pattern in ("%anna%", "%ANNA%", "%an%na%", "%nan_x%", "%ann\\%%", "%x1\\_a%", "an%", "%", "%ß%", "%éan%", "anna", "%zzzz%", ""):
        want = sorted(r.id for r in df.filter(F.col("name").ilike(pattern)).collect())
        assert sorted(r.id for r in index.matching(pattern).collect()) == want, pattern
    assert trigrams.pattern_grams("%AnNa_b\\%c%xy%") == ["ann", "b%c", "nna"]


def test_search_reads_candidates_only(spark, tmp_path):
    df = spark.range(20_000).select("id", F.concat(F.lit("player "), F.sha1(F.col("id").cast("string"))).alias("name"))
    index = trigrams.TrigramIndex(spark, str(tmp_path / "i"), "id", "name")
    index.add(df)
    keys = index.candidates("%abcde%")
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and "PushedFilters: [In(gram" in plan
    assert keys.count() < 200  # all three trigrams
    plan = index.matching("%abcde%")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(id" in plan or "InSet" in plan or "id#" in plan


def test_bitmap_joins_equal_plain_ones(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.choice([None, k, k % 40]), str(k % 7), k) for k in range(3000)], "a long, b string, c long")
    other = spark.createDataFrame([(k if k % 9 else None, str(k % 7)) for k in range(0, 3000, 3)] * 2, "a long, b string")
    for keys in (["a"], ["a", "b"], ["b"]):
        for right in (other, other.limit(0)):
            assert rows_of(bitmaps.missing_from(df, right, keys).toPandas()) == rows_of(joins.missing_from(df, right, keys).toPandas())
            assert rows_of(bitmaps.present_in(df, right, keys).toPandas()) == rows_of(joins.present_in(df, right, keys).toPandas())


def shuffled_rows(df) -> int:
    """Records that the exchanges of df's joins wrote."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        if name == "Exchange":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        for k in range(node.children().size()):
            todo.append(node.children().apply(k))
    return total


def test_new_keys_do_not_shuffle(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df, other = spark.range(60_000).withColumnRenamed("id", "k"), spark.range(0, 600).withColumnRenamed("id", "k")
        plain = shuffled_rows(df.join(other, "k", "left_anti"))
        quick = bitmaps.missing_from(df, other, ["k"])
        assert quick.count() == 59_400
        assert shuffled_rows(quick) < 0.2 * plain, plain
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
