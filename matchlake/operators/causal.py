"""Effect estimates from observed rows: matching, doubly robust, double machine learning.

All groups (event kind and minute, say) are fitted at once, from sums over rows. Features are few, so a linear fit is a handful of sums, X'X and
X'y, by group, fold and arm; what a fold's model must not see is left out of its sum. A logistic fit is such a fit again and again:
each Newton step sums X'WX and the gradient over all rows, and solves a small table, one row a group and fold. Matching finds the nearest
control by propensity from below and from above with as-of joins. A group may be any part of the rows: none is gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.operators.segments import asof_backward, places
from matchlake.sources.scratch import materialise, scratch

FOLDS, RIDGE, OVERLAP, CRITICAL, MIN_ARM, MIN_OVERLAP = 5, 1.0, (0.05, 0.95), 1.96, 15, 0.20
STEPS, ENOUGH = 30, 1e-10
#: Tables of one row a group are broadcast up to this many; beyond it rows are joined by group, and Spark splits what is skewed.
MAX_GROUPS = 100_000


def _add(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


class _Rows:
    """Standardised rows of all groups: _g, cluster, fold, t, y, x0, x1, ...; groups has _g, the keys, and counts."""

    def __init__(self, df: DataFrame, keys: list[str], features: list[str], treated: str, outcome: str, cluster: str):
        self.d = len(features)
        self.x = [f"x{k}" for k in range(self.d)]
        self.z = [F.lit(1.0), *(F.col(c) for c in self.x)]
        raw = df.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(cluster).cast("string").alias("cluster"), F.col(treated).cast("double").alias("t"), F.col(outcome).cast("double").alias("y"), *(F.col(f).cast("double").alias(x) for f, x in zip(features, self.x, strict=True)))
        names = [f"_k{i}" for i in range(len(keys))]
        stats = [s for x in self.x for s in (F.avg(x).alias(f"_mean_{x}"), F.stddev_pop(x).alias(f"_sd_{x}"))]
        groups = raw.groupBy(*names).agg(F.count("*").alias("n"), F.sum("t").cast("long").alias("n_treated"), F.avg("t").alias("t_mean"), *stats)
        self.groups = materialise(groups.withColumn("_g", F.monotonically_increasing_id()), "groups")
        self.small = self.groups.count() <= MAX_GROUPS
        own = reduce(lambda a, b: a & b, (F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names))
        rows = raw.alias("a").join(self._side(self.groups).alias("b"), own)
        scaled = [((F.col(f"a.{x}") - F.col(f"_mean_{x}")) / F.when(F.col(f"_sd_{x}") > 0, F.col(f"_sd_{x}")).otherwise(1.0)).alias(x) for x in self.x]
        rows = rows.select("_g", "cluster", "t", "y", "t_mean", *scaled)
        # a cluster stays in one fold: its place among the group's clusters, by turns
        fold = places(rows.select("_g", "cluster").distinct(), ["_g"], "cluster").select(F.col("_g").alias("_g2"), F.col("cluster").alias("_c2"), (F.col("place") % FOLDS).cast("int").alias("fold"))
        rows = rows.join(fold, (F.col("_g") == F.col("_g2")) & F.col("cluster").eqNullSafe(F.col("_c2"))).drop("_g2", "_c2")
        fit = self.groups.filter((F.col("n_treated") >= 2) & (F.col("n") - F.col("n_treated") >= 2)).select("_g")
        folds = rows.groupBy("_g").agg(F.count_distinct("fold").alias("_n")).filter("_n > 1").select("_g")
        self.rows = materialise(rows.join(self._side(fit.join(folds, "_g")), "_g", "left_semi"), "rows")

    def _side(self, groups: DataFrame) -> DataFrame:
        return F.broadcast(groups) if self.small else groups

    def of_group(self, rows: DataFrame, groups: DataFrame) -> DataFrame:
        """rows with the columns of a table of one row a group, if there is one."""
        return rows.join(self._side(groups), "_g", "left")

    def dot(self, weights: Column) -> Column:
        return _add([F.get(weights, F.lit(k)) * z for k, z in enumerate(self.z)])

    def products(self, weight: Column, target: Column) -> list[Column]:
        """Sums of weight z z' (upper half, row by row) and of z target, as the arrays a and b."""
        half = [F.sum(weight * self.z[i] * self.z[j]) for i in range(self.d + 1) for j in range(i, self.d + 1)]
        return [F.array(*half).alias("a"), F.array(*(F.sum(z * target) for z in self.z)).alias("b")]


def _square(half: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = half
    return out + np.triu(out, 1).T


def _newton(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One step of each group's and fold's logistic fit, with a ridge on all but the intercept."""
    for frame in frames:
        weights, moved = [], []
        for a, b, w in zip(frame["a"], frame["b"], frame["w"], strict=True):
            w = np.asarray(w, float)
            keep = RIDGE * np.eye(len(w))
            keep[0, 0] = 1e-8
            step = np.linalg.solve(_square(np.asarray(a, float), len(w)) + keep, np.asarray(b, float) - keep @ w)
            weights.append(w + step)
            moved.append(np.abs(step).max())
        yield frame[["_g", "fold"]].assign(w=weights, moved=moved)


def _ridge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ridge weights of each row's sums; without rows, the mean that stands in for them."""
    for frame in frames:
        weights = []
        for n, mean, a, b in zip(frame["n"], frame["mean"], frame["a"], frame["b"], strict=True):
            keep = RIDGE * np.eye(len(b))
            keep[0, 0] = 0
            weights.append(np.linalg.solve(_square(np.asarray(a, float), len(b)) + keep, np.asarray(b, float)) if n else np.array([mean] + [0.0] * (len(b) - 1)))
        yield frame[["_g", "fold", "arm"]].assign(w=weights)


def _others(sums: DataFrame, size: int, by: list[str]) -> DataFrame:
    """For each group and fold, the sums (n, sum_y, a, b) of all its other folds, by some more columns. A group has FOLDS rows for each of these."""
    each = sums.withColumn("_to", F.explode(F.array(*(F.lit(k) for k in range(FOLDS))))).filter(F.col("_to") != F.col("fold"))
    total = lambda name, n: F.array(*(F.sum(F.get(name, F.lit(k))) for k in range(n))).alias(name)
    return each.groupBy("_g", F.col("_to").alias("fold"), *by).agg(F.sum("n").alias("n"), F.sum("sum_y").alias("sum_y"), total("a", size * (size + 1) // 2), total("b", size))


def _propensity(data: _Rows) -> DataFrame:
    """The rows with p, the cross-fitted probability of treatment."""
    counts = data.rows.groupBy("_g", "fold").agg(F.count("*").alias("n"), F.sum("t").alias("s"))
    each = counts.withColumn("_to", F.explode(F.array(*(F.lit(k) for k in range(FOLDS))))).filter(F.col("_to") != F.col("fold"))
    rest = each.groupBy("_g", F.col("_to").alias("fold")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    zero = F.array(*[F.lit(0.0)] * (data.d + 1))
    models = materialise(rest.filter((F.col("s") > 0) & (F.col("s") < F.col("n"))).select("_g", "fold", zero.alias("w"), F.lit(1.0).alias("moved")), "models")
    by_group = lambda: models.groupBy("_g").agg(F.collect_list(F.struct("fold", "w")).alias("_models"))  # noqa: E731  FOLDS at most
    for _ in range(STEPS):
        if (models.agg(F.max("moved")).first()[0] or 0.0) < ENOUGH:
            break
        seen = data.of_group(data.rows, by_group()).withColumn("_m", F.explode(F.filter("_models", lambda m: m["fold"] != F.col("fold"))))
        q = 1 / (1 + F.exp(-F.least(F.greatest(data.dot(F.col("_m.w")), F.lit(-30.0)), F.lit(30.0))))
        seen = seen.withColumn("_q", q)
        sums = seen.groupBy("_g", F.col("_m.fold").alias("fold")).agg(*data.products(F.col("_q") * (1 - F.col("_q")), F.col("t") - F.col("_q")), F.first("_m.w").alias("w"))
        models = materialise(sums.mapInPandas(_newton, "_g long, fold int, w array<double>, moved double"), "models")
    own = F.get(F.filter("_models", lambda m: m["fold"] == F.col("fold")), F.lit(0))
    out = data.of_group(data.rows, by_group()).withColumn("_own", own)
    fitted = F.when(F.col("_own").isNull(), F.col("t_mean")).otherwise(1 / (1 + F.exp(-data.dot(F.col("_own.w")))))
    return out.withColumn("p", F.least(F.greatest(fitted, F.lit(1e-3)), F.lit(1 - 1e-3))).drop("_models", "_own")


def _outcomes(data: _Rows, rows: DataFrame) -> DataFrame:
    """rows with m1, m0 and m: the cross-fitted outcome of the treated, of the controls and of all."""
    one = data.rows.groupBy("_g", "fold", F.col("t").cast("int").alias("arm")).agg(F.count("*").alias("n"), F.sum("y").alias("sum_y"), *data.products(F.lit(1.0), F.col("y")))
    rest = _others(one, data.d + 1, ["arm"])
    every = _others(one, data.d + 1, []).withColumn("mean", F.col("sum_y") / F.col("n"))
    arms = every.select("_g", "fold", "mean", F.explode(F.array(F.lit(0), F.lit(1))).alias("arm")).join(rest, ["_g", "fold", "arm"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    blank = lambda n: F.array(*[F.lit(0.0)] * n)
    arms = arms.withColumn("b", F.coalesce("b", blank(data.d + 1))).withColumn("a", F.coalesce("a", blank((data.d + 1) * (data.d + 2) // 2)))
    names = ["_g", "fold", "arm", "n", "mean", "a", "b"]
    solved = arms.select(*names).unionByName(every.withColumn("arm", F.lit(2)).select(*names)).mapInPandas(_ridge, "_g long, fold int, arm int, w array<double>")
    table = materialise(solved.groupBy("_g").agg(F.collect_list(F.struct("fold", "arm", "w")).alias("_fits")), "fits")  # 3 * FOLDS at most
    out = data.of_group(rows, table)
    at = lambda arm: F.get(F.filter("_fits", lambda f: (f["fold"] == F.col("fold")) & (f["arm"] == arm)), F.lit(0))["w"]
    out = out.withColumns({f"_w{arm}": at(arm) for arm in range(3)})
    return out.withColumns({m: data.dot(F.col(f"_w{arm}")) for arm, m in ((1, "m1"), (0, "m0"), (2, "m"))}).drop("_fits", "_w0", "_w1", "_w2")


def _matched(rows: DataFrame, features: list[str]) -> DataFrame:
    """_g, cluster, gain of the treated: their outcome less that of the control nearest by propensity, with replacement. The one below wins a tie,
    and of equal propensities the first by cluster, features and outcome."""
    control = rows.filter("t = 0").groupBy("_g", F.col("p").alias("q")).agg(F.min_by("y", F.struct("cluster", *features, "y")).alias("held"))
    control = control.withColumn("up", -F.col("q"))
    asks = rows.filter("t = 1").select("_g", "cluster", "y", "p", (-F.col("p")).alias("_up"))
    low = control.select("_g", "q", F.col("q").alias("low"), F.col("held").alias("y_low"))
    high = control.select("_g", "up", F.col("q").alias("high"), F.col("held").alias("y_high"))
    both = asof_backward(asof_backward(asks, low, ["_g"], "p", "q", ["low", "y_low"]), high, ["_g"], "_up", "up", ["high", "y_high"])
    under = F.col("high").isNull() | (F.col("p") - F.col("low") <= F.col("high") - F.col("p"))
    return both.select("_g", "cluster", (F.col("y") - F.when(under & F.col("low").isNotNull(), F.col("y_low")).otherwise(F.col("y_high"))).alias("gain"))


def _spread(rows: DataFrame, names: list[str]) -> DataFrame:
    """_g and, by name, the root of the sum of squared cluster sums."""
    sums = rows.groupBy("_g", "cluster").agg(*(F.sum(n).alias(n) for n in names))
    return sums.groupBy("_g").agg(*(F.sqrt(F.sum(F.col(n) * F.col(n))).alias(n) for n in names))


def estimate_effects(df: DataFrame, keys: list[str], features: list[str], treated: str, outcome: str, cluster: str) -> DataFrame:
    """One row a group: arm sizes, overlap share, and effect and error of the three estimators.

    Groups with an arm of under 2 rows or clusters of one fold only have zeros. Errors are clustered.
    """
    with scratch() as keep:
        data = _Rows(df, keys, features, treated, outcome, cluster)
        t, y, p = F.col("t"), F.col("y"), F.col("p")
        rows = _outcomes(data, _propensity(data))
        score = F.col("m1") - F.col("m0") + t * (y - F.col("m1")) / p - (1 - t) * (y - F.col("m0")) / (1 - p)
        rows = materialise(rows.withColumn("score", score).withColumn("v", t - p).withColumn("u", y - F.col("m")), "fitted")
        v, u = F.col("v"), F.col("u")
        means = materialise(rows.groupBy("_g").agg(F.count("*").alias("_n"), F.avg(p.between(*OVERLAP).cast("double")).alias("overlap"), F.avg("score").alias("dr_effect"), (F.sum(v * u) / F.sum(v * v)).alias("dml_effect"), F.sum(v * v).alias("_vv")), "means")
        off = data.of_group(rows, means).withColumn("dr", F.col("score") - F.col("dr_effect")).withColumn("dml", v * (u - F.col("dml_effect") * v))
        spread = data.of_group(_spread(off, ["dr", "dml"]), means).select("_g", (F.col("dr") / F.col("_n")).alias("dr_se"), (F.col("dml") / F.col("_vv")).alias("dml_se"))
        pairs = materialise(_matched(rows, data.x), "pairs")
        gains = materialise(pairs.groupBy("_g").agg(F.avg("gain").alias("match_effect"), F.count("*").alias("_m")), "gains")
        match = data.of_group(_spread(data.of_group(pairs, gains).withColumn("off", F.col("gain") - F.col("match_effect")), ["off"]), gains).select("_g", "match_effect", (F.col("off") / F.col("_m")).alias("match_se"))
        out = data.groups
        for part in (means, spread, match):
            out = out.join(part, "_g", "left")
        names = ["overlap", *(f"{m}_{k}" for m in ("match", "dr", "dml") for k in ("effect", "se"))]
        named = [F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)]
        return keep(materialise(out.select(*named, "n_treated", (F.col("n") - F.col("n_treated")).alias("n_control"), *(F.coalesce(n, F.lit(0.0)).alias(n) for n in names)), "effects"))


def _t(effect: str, se: str) -> Column:
    return F.when(F.col(se) > 0, F.col(effect) / F.col(se)).otherwise(F.lit(0.0))


def agreement(effects: DataFrame) -> DataFrame:
    """verdict: thin, no_overlap, contradict, weak or accept. DR and DML alone vote."""
    a, b = _t("dr_effect", "dr_se"), _t("dml_effect", "dml_se")
    strong = (F.abs(a) > CRITICAL) & (F.abs(b) > CRITICAL) & (F.signum("dr_effect") != F.signum("dml_effect"))
    weak = F.greatest(F.abs(a), F.abs(b)) < CRITICAL
    verdict = F.when((F.col("n_treated") < MIN_ARM) | (F.col("n_control") < MIN_ARM), "thin").when(F.col("overlap") < MIN_OVERLAP, "no_overlap").when(strong, "contradict").when(weak, "weak").otherwise("accept")
    trust = (F.abs("dr_effect") + F.abs("dml_effect")) / (F.col("dr_se") + F.col("dml_se"))
    return effects.withColumn("verdict", verdict).withColumn("confidence", F.when(F.col("dr_se") + F.col("dml_se") > 0, trust).otherwise(F.lit(0.0)))


def gate(verdicts: DataFrame, kind: str, bands: str) -> DataFrame:
    """Counts by kind, and whether two bands or more were accepted."""
    return verdicts.groupBy(kind).agg(F.count_if(F.col("verdict") == "accept").alias("n_accepted"), F.count_if(F.col("verdict") != "accept").alias("n_rejected"), F.avg((F.col("verdict") == "no_overlap").cast("double")).alias("overlap_fail_rate"), F.count_distinct(F.when(F.col("verdict") == "accept", F.col(bands))).alias("n_bands")).withColumn("passes", F.col("n_bands") >= 2)
