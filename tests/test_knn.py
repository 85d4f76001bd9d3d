"""Neighbour search: exclusion by text keys, nulls, empty sides; random cohorts over the whole corpus."""

from __future__ import annotations

import numpy as np

from matchlake.operators import knn, topk

ROWS = "row_id long, key array<float>, grp string, band int"


def corpus(spark, n: int = 90):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=4)], None if i % 30 == 7 else f"NA1_{i // 3}", i % 4 - 1) for i in range(n)]
    return spark.createDataFrame(rows, ROWS), rows


def test_text_keys_exclude_and_nulls_do_not(spark):
    df, rows = corpus(spark)
    asks = df.filter("row_id % 10 = 7").withColumnRenamed("row_id", "query_id")
    got: dict[int, list[int]] = {}
    for r in knn.nearest(asks, df, 4, exclude=("grp", "grp")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.row_id)
    for q, vector, group, _ in rows:
        if q % 10 == 7:
            free = [(float(np.linalg.norm(np.float32(v) - np.float32(vector))), i) for i, v, g, _ in rows if g is None or group is None or g != group]
            assert got[q] == [i for _, i in sorted(free)[:4]]
    assert (7 in got[7]) and 17 not in got[17]


def test_bands_with_text_groups_and_empty_sides(spark):
    df, rows = corpus(spark)
    asks = df.filter("row_id < 12").withColumnRenamed("row_id", "query_id")
    out = knn.nearest_in_bands(asks, df, 5).collect()
    by = {i: (v, g, b) for i, v, g, b in rows}
    for r in out:
        assert r.stage == 3 or by[r.query_id][1] is None or by[r.row_id][1] != by[r.query_id][1]
    assert {r.query_id for r in out} == set(range(12))
    for search in (knn.nearest, knn.nearest_in_bands):
        assert search(asks, df.limit(0), 5).count() == 0 and search(asks.limit(0), df, 5).count() == 0


def test_random_cohorts_reach_every_row(spark):
    df = spark.range(3000).withColumnRenamed("id", "row_id")
    asks = spark.range(400).withColumnRenamed("id", "query_id")
    got = topk.random_per_query(asks, df, "query_id", "row_id", 20, 3).collect()
    assert len({(r.query_id, r.row_id) for r in got}) == len(got) == 8000
    assert all(r.query_id != r.row_id for r in got) and {r["rank"] for r in got} == set(range(1, 21))
    # 8,000 draws of 3,000 rows leave out some seven in a hundred
    assert 2700 < len({r.row_id for r in got}) < 2900
    few = topk.random_per_query(asks.limit(5), df.limit(6), "query_id", "row_id", 20, 3).groupBy("query_id").count().collect()
    assert all(r["count"] == 5 for r in few)
    assert topk.random_per_query(asks, df.limit(0), "query_id", "row_id", 20, 3).count() == 0


def test_a_full_pair_of_blocks_takes_little_memory(spark, monkeypatch):
    """What a task does with the largest blocks, run here: a matrix of all their distances alone would be 134 MB."""
    import tracemalloc

    import pandas as pd
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    held = []
    apply = PandasCogroupedOps.applyInPandas
    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", lambda self, f, schema: held.append(f) or apply(self, f, schema))
    df, _ = corpus(spark)
    asks = df.withColumnRenamed("row_id", "query_id")
    knn.nearest(asks, df, 4)
    knn.nearest_in_bands(asks, df, 4)
    rng = np.random.default_rng(5)

    def block(n):
        return pd.DataFrame({"_id": np.arange(n), "_vec": list(rng.normal(size=(n, 4)).astype(np.float32)), "_x": np.arange(n), "_band": np.arange(n) % 5 - 1, "_grp": np.arange(n) % 7})

    a, b = block(knn.QUERY_BLOCK), block(knn.CORPUS_BLOCK)
    for meet in held:
        tracemalloc.start()
        out = meet(a, b)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(out) >= 4 * len(a) and peak < 100e6
        few = meet(a.tail(3), b)  # a strip of its own gives the rows that it gives among others
        assert few.sort_values(list(few.columns)).reset_index(drop=True).equals(out[out["q"].isin(few["q"])].sort_values(list(few.columns)).reset_index(drop=True))


def test_products_choose_what_differences_would():
    """Ties, near ties far from the origin, and numbers that a product can't hold: pairs, order and every bit as by all distances."""
    rng = np.random.default_rng(6)
    far = rng.normal(size=(3000, 8)) * 1e-4 + 1e6
    odd = rng.normal(size=(3000, 8))
    odd[5::50], odd[7::90, 2], odd[11::70, 3], odd[13::80] = odd[5], np.nan, np.inf, 1e200
    small = rng.normal(size=(3000, 8)) * 1e-170
    for rows in (rng.normal(size=(3000, 8)), rng.integers(-1, 2, size=(3000, 8)).astype(float), far, odd, small, np.ones((3000, 8))):
        asks = rows[::37]
        times = np.where(rng.random((len(asks), len(rows))) < 0.5, 1.25 ** rng.integers(0, 4, size=(len(asks), len(rows))), 1.0)
        few = rng.random((len(asks), len(rows))) < 0.002
        with np.errstate(all="ignore"):
            every = knn._distances(asks, rows)
        for k, free, by in ((7, None, None), (7, rng.random(few.shape) < 0.4, times), (7, few, None), (4000, None, times)):
            at, to, d = knn._best(*knn._sides(list(asks), list(rows)), k, free, by)
            with np.errstate(all="ignore"):
                wide = every if by is None else every * by
            wide = np.where(np.isfinite(wide) & (free is None or free), wide, np.inf)
            order = np.argsort(wide, axis=1, kind="stable")[:, :k]
            want = [(q, r, wide[q, r]) for q in range(len(asks)) for r in order[q] if np.isfinite(wide[q, r])]
            assert list(zip(at, to, d, strict=True)) == want


def test_bands_in_all_stages(spark, monkeypatch):
    monkeypatch.setattr(knn, "SHORT", 6)
    k, n, rng = 8, 120, np.random.default_rng(7)
    bands = [int(x) for x in rng.integers(0, 2, n)]
    for i in range(n):
        if bands[i] == 1 and i % 7:
            bands[i] = 2
    bands[4], bands[33], bands[60], bands[115], bands[116], bands[117], bands[118], bands[119] = -1, None, 6, 0, 3, 6, -1, None
    rows = [(i, [float(v) for v in rng.integers(-2, 3, 3)], None if i in (7, 77) else "big" if i < 115 else f"s{i}", bands[i]) for i in range(n)]
    rows[50] = (50, [float("nan"), 0.0, 0.0], "big", 0)
    df = spark.createDataFrame(rows, ROWS)
    asks = df.filter("row_id % 4 = 3 or row_id >= 115").withColumnRenamed("row_id", "query_id")
    got: dict[int, list] = {}
    for r in knn.nearest_in_bands(asks, df, k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.row_id, r.distance, r.stage, r.effective_k, r.in_band))
    seen = set()
    for q, v, g, b in rows:
        if q % 4 == 3 or q >= 115:
            b = -1 if b is None else b
            every = [(float(np.linalg.norm(np.subtract(w, v))), i, abs(b - c) if b >= 0 and c >= 0 else 0, b >= 0 and c >= 0, g is None or h is None or g != h) for i, w, h, c in ((*r[:3], -1 if r[3] is None else r[3]) for r in rows)]
            kept = [sum(free and gap <= most for _, _, gap, _, free in every) for most in (0, 1, 99)]
            stage = 0 if b < 0 or kept[0] >= 6 else 1 if kept[1] >= 6 else 2
            stage = 3 if kept[stage] < k else stage
            fits = [(d * 1.25**gap if stage == 2 else d, i, both and gap == 0) for d, i, gap, both, free in every if d == d and (stage == 3 or (free and gap <= (0, 1, 99)[stage]))]
            same = min(k, sum(gap == 0 for _, _, gap, _, _ in every))
            want = [(i, d, stage, same, equal if b >= 0 else None) for d, i, equal in sorted(fits)[:k]]
            assert [(x[0], *x[2:]) for x in got[q]] == [(x[0], *x[2:]) for x in want] and np.allclose([x[1] for x in got[q]], [x[1] for x in want], rtol=1e-12)
            seen.add(stage)
    assert seen == {0, 1, 2, 3}


def test_the_skill_gate_searches_once_a_side(spark, monkeypatch, tmp_path):
    """Before, every figure of the gate ran its search anew, and the band-aware one sent four lists a query."""
    import uuid

    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    import __spark_entry__

    apply, folder = PandasCogroupedOps.applyInPandas, str(tmp_path)

    def counted(self, f, schema):
        def meet(a, b):
            out = f(a, b)
            if len(a) and len(b):
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
                    file.write(f"{len(a)} {len(out)}")
            return out

        return apply(self, meet, schema)

    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", counted)
    __spark_entry__.queries()["c23_skill_gate"](spark, "/root/testdata/sf0.001").collect()
    calls = [tuple(map(int, p.read_text().split())) for p in tmp_path.iterdir()]
    assert len(calls) == 2 and all(n_out <= 40 * n for n, n_out in calls)
