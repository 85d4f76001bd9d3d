"""Hard negatives against brute force: ties, copies, nulls, odd lengths, small blocks; and the registered SQL."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlake.llm import negatives, queries
from tests.conftest import duck, rows_of

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, k=5):
    held = []
    for i, v, label in rows:
        if None not in (i, v, label) and all(x is not None and math.isfinite(x) and abs(x) * 256 < negatives.LARGEST for x in v):
            held.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for a in sorted({i for i, *_ in held if i % every == 0}):
        label, v = min((lab, v) for i, lab, v in held if i == a)
        others = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, lab) for i, lab, w in held if i != a and len(w) == len(v))
        for p, pid, _ in [o for o in others if o[2] == label][:k]:
            fits = [o for o in others if o[2] != label and 80 * -p <= 100 * -o[0] <= 100 * -p]
            out += [(a, pid, n + 1, i, -p, -s) for n, (s, i, _) in enumerate(fits[:k])]
    return sorted(out)


def vectors(n: int, seed: int, dim: int = 12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = [(k, (centres[k % 6] + rng.normal(size=dim) * rng.choice([0.05, 0.5])).astype("f4").tolist(), int(rng.integers(0, 4))) for k in range(n)]
    for k in range(n // 3):  # a third are copies of one vector, under two labels
        rows[3 * k] = (3 * k, rows[0][1], k % 2)
    rows += [(None, rows[1][1], 1), (n, None, 1), (n + 1, rows[1][1], None), (n + 2, [None] * dim, 1), (n + 3, [float("nan")] * dim, 1), (n + 4, [float("inf")] * dim, 2), (n + 5, [0.5, 0.25], 1), (n + 6, [0.5, 0.5], 2), (n + 7, [0.5, 0.5], 1), (1000, [0.25, 1.0], 1), (2000, [], 1), (2001, [], 1), (2002, [], 2)]
    rows += [rows[100], (100, rows[101][1], 9), rows[7], rows[7]]  # an anchor's rows twice, another's id under another label
    return rows


def got(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize(("seed", "block"), [(1, 64), (2, negatives.ROW_BLOCK)])
def test_negatives_equal_brute_force(spark, seed, block):
    rows = vectors(420, seed)
    df = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit(3) for c in ("id", "n", "v", "cell", "block", "salt", "_label", "score")})
    want = brute(rows)
    assert got(negatives.hard_negatives(df, row_block=block)) == want and len(want) > 50


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=5) * 200_000).astype("f4").tolist(), k % 2) for k in range(300)] + [(300, [1e9] * 5, 1)]
    assert got(negatives.hard_negatives(spark.createDataFrame(rows, ROWS))) == brute(rows)


def test_empty_and_lonely(spark):
    assert got(negatives.hard_negatives(spark.createDataFrame([], ROWS))) == []
    assert got(negatives.hard_negatives(spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1)], ROWS))) == []


def test_brackets_hold_every_score():
    """Survivors lose no row that has what is asked for, and rule out some."""
    rng = np.random.default_rng(4)
    x = rng.integers(-300, 300, size=(3000, 16)) // rng.integers(1, 9, size=(3000, 1))
    square = float((x**2).sum(axis=1).max())
    table = np.vstack([np.column_stack([x[:16], np.sqrt(square - (x[:16].astype(float) ** 2).sum(axis=1))]), [[square] + [0] * 16]])
    e, skipped = negatives._distances(x, table, False), 0
    for q in x[::100]:
        d, score = negatives._distances(q[None], table, True)[0], x @ q
        least, most = np.sort(score)[-20], np.sort(score)[-3]
        left = negatives.survivors(np.arange(len(x)), d, e, square + float((q.astype(float) ** 2).sum()), least, most)
        assert set(np.flatnonzero((score >= least) & (score <= most))) <= set(left.tolist())
        skipped += len(x) - len(left)
    assert skipped > 3000


def test_blocks_are_ruled_out(spark):
    """Far clusters: pairs of blocks go before their vectors meet, and the rows stay the same."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 8)) * 4
    rows = [(k, (centres[k % 8] + rng.normal(size=8) * 0.02).astype("f4").tolist(), (k // 8) % 3) for k in range(1600)]
    held = negatives.quantised(spark.createDataFrame(rows, ROWS), "vec_id", "label", "embedding")
    table = negatives.PivotTable(held, row_block=100)
    ends = [F.array(F.lit(x).cast("long")) for x in (-(1 << 62), 1 << 62)]
    found = table.search(held.filter("id % 100 = 0").withColumn("low", ends[0]).withColumn("high", ends[1]), 5, True, 1)
    assert found.count() == 16 * 5
    met, pairs = (sum(x) for x in zip(*table.met, strict=True))
    assert met < 0.5 * pairs, (met, pairs)


def test_negatives_sql(spark):
    sf = "/root/testdata/sf0.01"
    want = duck(sf).sql(queries.SQL["op13_hard_negatives"]).df()
    assert rows_of(queries.op13_hard_negatives(spark, sf).toPandas()) == rows_of(want) and len(want) > 0
