"""Concepts by impurity against plain counting, and the gate's and probe's queries."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from matchlake.operators import teamstate
from matchlake.plans import analytics  # noqa: F401  registers the query
from matchlake.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def plain_gain(values, labels, bins=32):
    held = [(v, y) for v, y in zip(values, labels, strict=True) if v is not None]
    low, high = min(v for v, _ in held), max(v for v, _ in held)
    cell = lambda v: min(int((v - low) // ((high - low) / bins)), bins - 1) if high > low else 0
    gini = lambda rows: 2 * (p := sum(y for _, y in rows) / len(rows)) * (1 - p)
    best = 0.0
    for c in range(bins):
        a, b = [r for r in held if cell(r[0]) <= c], [r for r in held if cell(r[0]) > c]
        if a and b:
            best = max(best, gini(held) - len(a) / len(held) * gini(a) - len(b) / len(held) * gini(b))
    return best


def test_gains_equal_plain_counting(spark):
    rng = random.Random(1)
    rows = [(y := rng.randint(0, 1), y + rng.gauss(0, 1), rng.gauss(0, 1), 5.0, None if rng.random() < 0.2 else float(y)) for _ in range(500)]
    df = spark.createDataFrame(rows, "won int, good double, noise double, flat double, holes double")
    features = ["good", "noise", "flat", "holes"]
    got = {r.feature_key: r.gain for r in teamstate.impurity_gains(df, features).collect()}
    for k, f in enumerate(features, 1):
        assert got[f] == pytest.approx(plain_gain([r[k] for r in rows], [r[0] for r in rows]), abs=1e-9), f
    named = {r.feature_key: r.importance for r in teamstate.concepts_by_impurity(df, features).collect()}
    assert sum(named.values()) == pytest.approx(1, abs=0.03) and max(named, key=named.get) == "holes" and "flat" not in named
    assert teamstate.concepts_by_impurity(df.limit(19), features).count() == 0
    assert teamstate.concepts_by_impurity(df.withColumn("won", F.lit(1)), features).count() == 0


def test_probe_query(spark):
    got = {r.view: r.auc for r in QUERIES["c31_rank_probe"](spark, SF).collect()}
    assert set(got) == {"whole", "half", "four"} and all(0.3 < v <= 1 for v in got.values()) and got["whole"] >= got["four"] - 0.05
