"""Batches under budgets against a row loop; a key's rows spread over tasks; no Python in the plan."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from matchlake.operators import packing
from matchlake.plans.registry import QUERIES

ROWS = "k string, t long, a long, b long"


def loop(rows, budgets):
    out, state = [], {}
    for k, t, a, b in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        batch, held, top = state.get(k, (0, 0, [0, 0]))
        new = [max(x, y or 0) for x, y in zip(top, (a, b), strict=True)]
        if held and any(n * (held + 1) > most for n, most in zip(new, budgets, strict=True)):
            batch, held, new = batch + 1, 0, [a or 0, b or 0]
        state[k] = batch, held + 1, new
        out.append((k, t, batch))
    return sorted(out, key=str)


@pytest.mark.parametrize("budgets", [(40, 300), (1, 1), (10**9, 10**9)])
def test_batches_equal_a_row_loop(spark, budgets):
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), t, rng.choice([0, 1, 3, 9, 50, None]), rng.randint(0, 60)) for t in range(700)] + [("one", 1, 5, 5), ("zero", 1, 0, 0), ("zero", 2, 0, 0)]
    df = spark.createDataFrame(rows, ROWS)
    got = packing.budget_batches(df, ["k"], ["t"], ["a", "b"], list(budgets), rows=100)
    assert got.columns == ["k", "t", "a", "b", "batch"]
    assert sorted(((r.k, r.t, r.batch) for r in got.collect()), key=str) == loop(rows, budgets)
    assert packing.budget_batches(df.limit(0), ["k"], ["t"], ["a", "b"], list(budgets)).count() == 0


def test_one_key_of_many_rows_is_spread(spark):
    """All rows are one key's; each join by key and position deals them out, and the plan runs no Python."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(held, ("20", "false", "-1"), strict=True):
        spark.conf.set(k, v)
    try:
        rows = spark.range(40_000).select(F.struct(F.lit("k")).alias("_key"), F.col("id").alias("_pos"), F.array(F.pmod(F.xxhash64("id"), F.lit(50))).alias("_top"))
        ends = packing.batch_ends(rows, ["_key"], [400])
        plan = ends._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
        each = ends.withColumn("_task", F.spark_partition_id()).groupBy("_task").agg(F.count("*").alias("n"), F.sum("_next").alias("s"))
        most = each.agg(F.max("n"), F.sum("n"), F.sum("s")).first()
        assert most[1] == 40_000 and most[0] < 4_000
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_query_runs_no_python(spark):
    plan = QUERIES["w14_budget_batches"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan


def test_small_keys_move_once(spark, monkeypatch):
    """Pointers, which move all rows several times, serve large keys only; the others are packed in one ordered pass, over Arrow batches of any size."""
    rows = [(f"k{t % 7}", t, t * 7 % 11, t * 5 % 60) for t in range(700)]
    df = spark.createDataFrame(rows, ROWS)
    seen = []
    ends = packing.batch_ends
    monkeypatch.setattr(packing, "batch_ends", lambda *a: seen.append(1) or ends(*a))
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = packing.budget_batches(df, ["k"], ["t"], ["a", "b"], [40, 300])
        assert sorted(((r.k, r.t, r.batch) for r in got.collect()), key=str) == loop(rows, [40, 300])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert not seen
