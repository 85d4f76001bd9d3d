"""Effects from sums over rows against numpy fits of one group at a time, to 1e-8."""

from __future__ import annotations

import numpy as np
import pytest

from matchlake.operators import causal


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights (intercept first) of a ridge logistic fit by Newton steps."""
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    keep = ridge * np.eye(len(w))
    keep[0, 0] = 1e-8
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep, z.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-10:
            break
    return w


def ridge_fit(x: np.ndarray, y: np.ndarray, alpha: float = causal.RIDGE) -> np.ndarray:
    z = np.column_stack([np.ones(len(x)), x])
    keep = alpha * np.eye(z.shape[1])
    keep[0, 0] = 0
    return np.linalg.solve(z.T @ z + keep, z.T @ y)


def _on(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return w[0] + x @ w[1:]


def propensity(x: np.ndarray, t: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Cross-fitted P(treated)."""
    out = np.full(len(t), t.mean())
    for k in np.unique(fold):
        rest = fold != k
        if 0 < t[rest].sum() < rest.sum():
            out[~rest] = 1 / (1 + np.exp(-_on(logistic(x[rest], t[rest]), x[~rest])))
    return np.clip(out, 1e-3, 1 - 1e-3)


def clustered_se(score: np.ndarray, cluster: np.ndarray, n: int) -> float:
    """Root of the sum of squared cluster sums, over n."""
    _, at = np.unique(cluster, return_inverse=True)
    return float(np.sqrt((np.bincount(at, weights=score) ** 2).sum()) / max(n, 1))


def matching(y: np.ndarray, t: np.ndarray, p: np.ndarray, cluster: np.ndarray) -> tuple[float, float]:
    """Treated minus nearest control by propensity, with replacement; the first control wins a tie ."""
    one, none = np.flatnonzero(t == 1), np.flatnonzero(t == 0)
    order = none[np.argsort(p[none], kind="stable")]
    at = np.searchsorted(p[order], p[one])
    low, high = np.clip(at - 1, 0, len(order) - 1), np.clip(at, 0, len(order) - 1)
    low = np.searchsorted(p[order], p[order][low])  # the first of equal propensities
    near = np.where(np.abs(p[order][low] - p[one]) <= np.abs(p[order][high] - p[one]), low, high)
    gain = y[one] - y[order][near]
    return float(gain.mean()), clustered_se(gain - gain.mean(), cluster[one], len(one))


def doubly_robust(x: np.ndarray, y: np.ndarray, t: np.ndarray, p: np.ndarray, fold: np.ndarray, cluster: np.ndarray) -> tuple[float, float]:
    m1, m0 = np.zeros(len(y)), np.zeros(len(y))
    for k in np.unique(fold):
        rest = fold != k
        for arm, out in ((1, m1), (0, m0)):
            some = rest & (t == arm)
            out[~rest] = _on(ridge_fit(x[some], y[some]), x[~rest]) if some.any() else y[rest].mean()
    score = m1 - m0 + t * (y - m1) / p - (1 - t) * (y - m0) / (1 - p)
    return float(score.mean()), clustered_se(score - score.mean(), cluster, len(y))


def double_ml(x: np.ndarray, y: np.ndarray, t: np.ndarray, p: np.ndarray, fold: np.ndarray, cluster: np.ndarray) -> tuple[float, float]:
    m = np.zeros(len(y))
    for k in np.unique(fold):
        m[fold == k] = _on(ridge_fit(x[fold != k], y[fold != k]), x[fold == k])
    v, u = t - p, y - m
    effect = float((v * u).sum() / (v * v).sum())
    return effect, clustered_se(v * (u - effect * v), cluster, len(y)) * len(y) / float((v * v).sum())


def plain(rows: list[tuple]) -> dict:
    """One group's estimates; rows: a, b, t, y, cluster."""
    rows = sorted(rows, key=lambda r: (r[4], r[0], r[1], r[3]))
    x, t, y = np.array([r[:2] for r in rows], float), np.array([r[2] for r in rows], float), np.array([r[3] for r in rows], float)
    sd = x.std(axis=0)
    x = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)
    ids = np.array([r[4] for r in rows])
    _, at = np.unique(ids, return_inverse=True)
    fold = at % causal.FOLDS
    out = dict.fromkeys(("overlap", *(f"{m}_{k}" for m in ("match", "dr", "dml") for k in ("effect", "se"))), 0.0)
    if min(t.sum(), (1 - t).sum()) >= 2 and len(np.unique(fold)) > 1:
        p = propensity(x, t, fold)
        out["overlap"] = ((p >= causal.OVERLAP[0]) & (p <= causal.OVERLAP[1])).mean()
        for m, got in (("match", matching(y, t, p, ids)), ("dr", doubly_robust(x, y, t, p, fold, ids)), ("dml", double_ml(x, y, t, p, fold, ids))):
            out[f"{m}_effect"], out[f"{m}_se"] = got
    return out | {"n_treated": int(t.sum()), "n_control": int((1 - t).sum())}


def test_effects_equal_numpy_group_by_group(spark):
    """Groups of all sizes: a large one, one without controls, one whose treated are in one fold, one cluster only, constant features, a null key."""
    rng = np.random.default_rng(11)
    groups: dict[str | None, list[tuple]] = {}
    for name, n in (("large", 900), ("small", 40), (None, 60), ("flat", 50)):
        x = rng.normal(size=(n, 2)) * (0 if name == "flat" else 1) + 1
        t = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 1)))).astype(int)
        y = 0.5 * x[:, 0] + 0.3 * t + rng.normal(size=n)
        groups[name] = [(float(a), float(b), int(c), float(d), f"c{k // 3}") for k, (a, b, c, d) in enumerate(zip(*x.T, t, y, strict=True))]
    groups["no control"] = [(float(k), 0.0, 1, 1.0, f"c{k}") for k in range(9)]
    groups["one fold"] = [(float(k % 5), float(k), int(k % 10 == 0), float(k % 3), f"c{k % 10}") for k in range(40)]
    groups["one cluster"] = [(float(k), 0.0, k % 2, 1.0, "c") for k in range(9)]
    rows = [(g, *r) for g, held in groups.items() for r in held]
    df = spark.createDataFrame(rows, "g string, a double, b double, t int, y double, cl string")
    out = causal.estimate_effects(df, ["g"], ["a", "b"], "t", "y", "cl")
    got = {r.g: r.asDict() for r in out.collect()}
    assert got.keys() == groups.keys()
    for g, held in groups.items():
        for name, value in plain(held).items():
            assert got[g][name] == pytest.approx(value, abs=1e-8), (g, name)
    assert got["large"]["overlap"] > 0.9 and got["no control"]["dr_effect"] == 0


def test_no_group_is_gathered(spark):
    """The passes over rows are aggregates and joins; Python sees one row a group, fold and arm."""
    df = spark.range(400).selectExpr("'g' AS g", "CAST(id % 11 AS DOUBLE) AS a", "CAST(id % 7 AS DOUBLE) AS b", "CAST(id % 3 = 0 AS INT) AS t", "CAST(id % 5 AS DOUBLE) AS y", "CAST(id AS STRING) AS cl")
    data = causal._Rows(df, ["g"], ["a", "b"], "t", "y", "cl")
    plan = causal._outcomes(data, causal._propensity(data))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "Python" not in plan and "Pandas" not in plan
    assert causal.estimate_effects(df.limit(0), ["g"], ["a", "b"], "t", "y", "cl").count() == 0
