"""Pruned neighbour search gives the rows of the plain one, and skips blocks of far clusters."""

from __future__ import annotations

import numpy as np
import pytest

from matchlake.operators import knn, pruned
from tests.conftest import rows_of


def corpus(spark, n, spread, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, 6)) * 10
    rows = [(k, (centres[k % 10] + rng.normal(size=6) * spread).astype("f4").tolist(), f"g{k // 20}") for k in range(n)]
    for k in range(0, n, 4):
        rows[k] = (k, rows[0][1], rows[k][2])  # a quarter are one vector: ties everywhere
    return spark.createDataFrame(rows, "row_id long, key array<float>, grp string")


@pytest.mark.parametrize(("spread", "share"), [(0.05, 0.4), (30.0, 1.1)])
def test_same_rows_and_skipped_blocks(spark, spread, share):
    df, counts = corpus(spark, 1200, spread, 3), {}
    asks = df.filter("row_id % 17 = 0").withColumnRenamed("row_id", "query_id")
    for exclude in (None, ("grp", "grp")):
        got = pruned.nearest(asks, df, 5, exclude=exclude, query_block=16, corpus_block=64, counts=counts)
        assert rows_of(got.toPandas()) == rows_of(knn.nearest(asks, df, 5, exclude=exclude).toPandas())
        assert 0 < counts["met"] < share * counts["every"], counts


def test_odd_sides(spark):
    df = corpus(spark, 30, 1.0, 4)
    asks = df.filter("row_id < 3").withColumnRenamed("row_id", "query_id")
    assert pruned.nearest(asks, df.limit(0), 3).count() == 0 and pruned.nearest(asks.limit(0), df, 3).count() == 0
    assert rows_of(pruned.nearest(asks, df, 100).toPandas()) == rows_of(knn.nearest(asks, df, 100).toPandas())
