"""Shallow probes of vectors for a rank band, and what they say about a model."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.operators.aggregates import roc_auc
from matchlake.operators.topk import balanced

LEAST_ROWS, TRAIN_SHARE, MOST_TRAIN, MOST_TEST = 100, 0.7, 2000, 500


def rank_probe(df: DataFrame, key: str, vector: str, band: str, seed: int = 0) -> float:
    """Macro one-against-rest AUC of a multinomial logistic fit on held-out rows; NaN with too few rows or bands.

    Rows are split by a hash of their key and balanced by band within each side.
    """
    rows = df.filter(F.col(band) >= 0).select(key, F.col(band).cast("int").alias("_y"), array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("_x"))
    held = rows.groupBy("_y").count().collect()
    if sum(r["count"] for r in held) < LEAST_ROWS or len(held) < 2:
        return math.nan
    share = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1000)) / 1000
    one = balanced(rows.filter(share < TRAIN_SHARE), "_y", key, seed, MOST_TRAIN)
    two = balanced(rows.filter(share >= TRAIN_SHARE), "_y", key, seed, MOST_TEST)
    if one.select("_y").distinct().count() < 2 or two.select("_y").distinct().count() < 2:
        return math.nan
    scaler = StandardScaler(inputCol="_x", outputCol="_z", withMean=True).fit(one)
    n = one.count()
    model = LogisticRegression(featuresCol="_z", labelCol="_y", family="multinomial", maxIter=200, regParam=1.0 / n).fit(scaler.transform(one))
    scored = model.transform(scaler.transform(two)).select("_y", vector_to_array("probability").alias("_p"))
    bands = sorted(r["_y"] for r in held)
    tall = scored.select("_y", F.explode(F.array(*(F.struct(F.lit(b).alias("b"), F.get("_p", F.lit(b)).alias("p")) for b in bands))).alias("s"))
    each = roc_auc(tall.select(F.col("s.b").alias("b"), F.col("s.p").alias("p"), (F.col("_y") == F.col("s.b")).cast("int").alias("is")), "p", "is", ["b"])
    return each.agg(F.avg("auc")).first()[0]


def classify_rank_use(probe_auc: dict[str, float], swap_delta: float) -> str:
    """under_use: readable in the embedding, not in the dynamics. over_leak: strong in dynamics and latent, and swapping moves outcomes."""
    emb, h, mu = (probe_auc.get(k, math.nan) for k in ("player_emb", "h_t", "post_mu"))
    if emb >= 0.70 and h < 0.60:
        return "under_use"
    if h >= 0.75 and mu >= 0.70 and swap_delta >= 0.05:
        return "over_leak"
    return "mixed_or_unclear"
