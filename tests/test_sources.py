"""Paged sources over a local server, drains with limits, whole-corpus jobs."""

from __future__ import annotations

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.error import HTTPError

import pytest

from matchlake.plans import analytics, engine, telemetry  # noqa: F401  registers the queries
from matchlake.plans.registry import Tables
from matchlake.sources.paged import PagedJson, fetch_json
from matchlake.streaming.workers import drain, drain_until_idle

PAGES = {"kr": 5, "na": 2, "none": 0}


@pytest.fixture(scope="module")
def server():
    asked: Counter = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] += 1
            _, kind, scope, page = self.path.split("/")
            refuse = kind == "busy" and asked[self.path] < 3 or kind == "never"
            rows = [{"id": f"{scope}{page}.{k}"} for k in range(3)] if int(page) <= PAGES.get(scope, 0) else []
            body = rows if kind != "total" else {"data": rows, "recordsTotal": 3 * PAGES.get(scope, 0)}
            self.send_response(429 if refuse else 404 if kind == "gone" else 200)
            if kind == "busy":
                self.send_header("Retry-After", "0.2")
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    made = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}", asked
    made.shutdown()


def test_pages_until_empty_until_total_and_by_range(spark, server):
    root, asked = server
    spark.dataSource.register(PagedJson)
    want = sorted(f"{s}{p}.{k}" for s, n in PAGES.items() for p in range(1, n + 1) for k in range(3))
    read = lambda **o: spark.read.format("paged_json").options(scopes="kr,na,none", **o).load()
    ids = lambda df: sorted(json.loads(r.value)["id"] for r in df.collect())
    assert ids(read(url=root + "/list/{scope}/{page}")) == want and asked["/list/kr/6"] >= 1
    assert ids(read(url=root + "/total/{scope}/{page}", rows="data", total="recordsTotal")) == want
    assert asked["/total/kr/6"] == 0 and asked["/total/na/3"] == 0  # the total says when to stop
    asked.clear()
    assert ids(read(url=root + "/total/{scope}/{page}", rows="data", total="recordsTotal", pages="8", per_task="2")) == want
    assert asked["/total/kr/5"] == 1 and asked["/total/kr/6"] == 0 and asked["/total/na/3"] == 1 and asked["/total/na/4"] == 0  # in every range
    ranged = read(url=root + "/range/{scope}/{page}", pages="6", per_task="2")
    assert ranged.rdd.getNumPartitions() == 9 and ids(ranged) == want


def test_filters_plan_only_their_requests(spark, server):
    """The server's log shows what was asked for; rows are those of the filter over a whole read."""
    root, asked = server
    spark.dataSource.register(PagedJson)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = lambda kind, **o: spark.read.format("paged_json").options(scopes="kr,na,none", pushdown="true", url=root + f"/{kind}/{{scope}}/{{page}}", **o).load()
        pages = lambda df: sorted({(r.scope, r.page) for r in df.collect()})
        assert pages(read("one").filter("scope = 'na'")) == [("na", 1), ("na", 2)]
        assert [k for k in asked if k.startswith("/one/") and "/na/" not in k] == []
        assert pages(read("bounds").filter("scope IN ('kr', 'other') AND page > 2 AND page <= 4")) == [("kr", 3), ("kr", 4)]
        assert sorted(k for k in asked if k.startswith("/bounds/")) == ["/bounds/kr/3", "/bounds/kr/4"]
        assert pages(read("pages", pages="6", per_task="2").filter("page = 5")) == [("kr", 5)]
        assert {k for k in asked if k.startswith("/pages/")} == {f"/pages/{s}/5" for s in PAGES}
        assert pages(read("left").filter("scope LIKE '%r' AND value LIKE '%kr1.2%'")) == [("kr", 1)]
        assert pages(read("gone").filter("scope = 'no such'")) == []
        assert pages(read("bounds2").filter("page < 1")) == []
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_back_off_is_shared(server, tmp_path):
    """A refusal that one process met holds up another, which finds the note in the shared folder."""
    import subprocess
    import sys

    root, asked = server
    fetch_json(root + "/list/kr/1", {}, shared=str(tmp_path / "none"))
    note = tmp_path / "notes"
    assert len(fetch_json(root + "/busy/na/1", {}, shared=str(note))) == 3
    (held,) = note.iterdir()
    held.write_text(f"{time.time() + 2:.3f}")
    code = f"import time; from matchlake.sources.paged import fetch_json; t = time.time(); fetch_json('{root}/list/na/1', {{}}, shared='{note}'); print(time.time() - t)"
    began = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=60, check=True)
    assert float(began.stdout) > 0.2


def test_back_off(server):
    root, asked = server
    began = time.monotonic()
    assert len(fetch_json(root + "/busy/kr/1", {})) == 3 and asked["/busy/kr/1"] == 3
    assert time.monotonic() - began >= 0.4
    for path, times in (("/never/kr/1", 2), ("/gone/kr/1", 1)):
        with pytest.raises(HTTPError):
            fetch_json(root + path, {}, tries=2, wait_s=0.05)
        assert asked[path] == times


def test_drains_have_limits(spark, tmp_path):
    rows = lambda k: spark.createDataFrame([(k * 10 + i,) for i in range(3)], "id long").write.mode("append").parquet(str(tmp_path / "in"))
    rows(0)
    source = lambda: spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    got: list[int] = []

    def sink(df, n):
        got.extend(r.id for r in df.collect())
        if n == 0:
            rows(1)  # comes while the first batch is in work

    assert drain_until_idle(source, sink, str(tmp_path / "ck"), idle_s=0.5, wall_s=60, pause_s=0.1) == 6
    assert sorted(got) == [0, 1, 2, 10, 11, 12]
    slow = lambda df, n: time.sleep(30)
    assert drain(source(), slow, str(tmp_path / "ck2"), wall_s=1.0) is False
    assert drain(source(), lambda df, n: None, str(tmp_path / "ck3")) is True


def test_whole_corpus_job(spark):
    x = Tables(spark, "/root/testdata/sf0.001")
    vectors, concepts, moments = engine.process_all(telemetry.frames(x), telemetry.events(x), telemetry.games(x))
    assert vectors.count() == 2 * telemetry.FRAMES * x.supplier.count()
    found = [r.importance for r in concepts.collect()]
    assert found == sorted(found, reverse=True) and min(found) >= 0.01 and len(found) <= 10
    keys = {r.concept_id for r in concepts.collect()}
    rows = moments.collect()
    assert rows and {r.concept_id for r in rows} <= keys and max(Counter(r.match_id for r in rows).values()) <= 10


def test_effects_equal_plain_numpy(spark):
    """The query's estimates, group by group, against loops over the same formulas."""
    import numpy as np

    from matchlake.operators import causal
    from matchlake.plans.registry import QUERIES

    x = Tables(spark, "/root/testdata/sf0.01")
    got = {r.lang: r for r in QUERIES["c28_c30_effects"](spark, x.sf_dir).collect()}
    rows = x.labels.join(x.documents.select("doc_id", "lang", "n_chars"), "doc_id").toPandas()
    for lang, g in rows.groupby("lang"):
        g = g.assign(size=np.log1p(g["n_chars"].astype(float)), noise=(g["doc_id"] % 7).astype(float)).sort_values(["doc_id", "size", "noise"])
        feats = g[["size", "noise"]].to_numpy(float)
        feats = (feats - feats.mean(axis=0)) / np.where(feats.std(axis=0) > 0, feats.std(axis=0), 1)
        t, y = g["toxic"].to_numpy(float), g["quality"].to_numpy(float)
        ids = g["doc_id"].astype(str).to_numpy()
        rank = {v: k for k, v in enumerate(sorted(set(ids)))}
        fold = np.array([rank[i] % causal.FOLDS for i in ids])
        row = got[lang]
        assert (row.n_treated, row.n_control) == (int(t.sum()), int((1 - t).sum()))
        if min(row.n_treated, row.n_control) < 2:
            continue
        z = np.column_stack([np.ones(len(feats)), feats])
        p, m, m1, m0 = np.full(len(t), t.mean()), np.zeros(len(t)), np.zeros(len(t)), np.zeros(len(t))
        ridge = lambda a, b: np.linalg.solve(a.T @ a + np.diag([0.0, 1.0, 1.0]), a.T @ b)
        for k in sorted(set(fold)):
            rest, here = fold != k, fold == k
            if 0 < t[rest].sum() < rest.sum():
                w = np.zeros(3)
                for _ in range(200):  # gradient of the penalised likelihood, by Newton
                    q = 1 / (1 + np.exp(-z[rest] @ w))
                    pen = np.array([1e-8, 1.0, 1.0])
                    w = w + np.linalg.solve(z[rest].T @ (z[rest] * (q * (1 - q))[:, None]) + np.diag(pen), z[rest].T @ (t[rest] - q) - pen * w)
                p[here] = 1 / (1 + np.exp(-z[here] @ w))
            m[here] = z[here] @ ridge(z[rest], y[rest])
            for arm, out in ((1, m1), (0, m0)):
                some = rest & (t == arm)
                out[here] = z[here] @ ridge(z[some], y[some]) if some.any() else y[rest].mean()
        p = np.clip(p, 1e-3, 1 - 1e-3)
        score = m1 - m0 + t * (y - m1) / p - (1 - t) * (y - m0) / (1 - p)
        v, u = t - p, y - m
        effect = (v * u).sum() / (v * v).sum()
        pairs = [y[i] - y[min((j for j in range(len(t)) if t[j] == 0), key=lambda j: (abs(p[j] - p[i]), j))] for i in range(len(t)) if t[i] == 1]  # noqa: B023
        assert row.overlap == pytest.approx(((p >= 0.05) & (p <= 0.95)).mean(), abs=1e-6)
        assert row.dr_effect == pytest.approx(score.mean(), abs=1e-6) and row.dml_effect == pytest.approx(effect, abs=1e-6)
        sums = {}
        for i, s in zip(ids, score - score.mean(), strict=True):
            sums[i] = sums.get(i, 0.0) + s
        assert row.dr_se == pytest.approx(np.sqrt(sum(s * s for s in sums.values())) / len(y), abs=1e-6)
        assert len(pairs) == row.n_treated and row.match_effect == pytest.approx(np.mean(pairs), abs=0.05)
