"""Aggregates: roll-ups, shares, modes, centroids, AUC, quantiles, whitening, fixed-domain tables."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share_of(df: DataFrame, keys: list[str], of: str) -> DataFrame:
    """Count of each value and its share of its keys' rows."""
    counts = df.groupBy(*keys, of).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def mode_of(df: DataFrame, keys: list[str], value: str, floor: int = 1) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the smallest.

    Keys with fewer than floor non-null values have none.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.sum("n").alias("_all"), F.min(F.struct((-F.col("n")).alias("_n"), F.col(value).alias("_v"))).alias("_best"))
    return best.select(*keys, F.when(F.col("_all") >= floor, F.col("_best._v")).alias("mode"), F.when(F.col("_all") >= floor, -F.col("_best._n")).alias("n"))


def dense_ranks(df: DataFrame, key: str, most: int) -> DataFrame:
    """The most frequent keys with ids 1 to most; ties by key (A13). The top rows only are ranked in one place."""
    top = df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(most)
    return top.withColumn("dense_id", F.row_number().over(Window.orderBy(F.desc("n"), key)))


def team_state(df: DataFrame, keys: list[str], sums: list[str], means: list[str], x: str, y: str) -> DataFrame:
    """Sums, means, and the root mean square distance from the mean position (A10)."""
    return df.groupBy(*keys).agg(*(F.sum(c).alias(f"sum_{c}") for c in sums), *(F.avg(c).alias(f"avg_{c}") for c in means), F.sqrt(F.var_pop(x) + F.var_pop(y)).alias("spread"))


def whitening(df: DataFrame, vector: str, floor: float = 1e-6) -> DataFrame:
    """dim, mean and population deviation with a floor, for each dimension (A15). As many rows as dimensions."""
    rows = df.select(F.posexplode(vector).alias("dim", "_x")).select("dim", F.col("_x").cast("double").alias("_x"))
    return rows.groupBy("dim").agg(F.avg("_x").alias("mean"), F.greatest(F.stddev_pop("_x"), F.lit(floor)).alias("sd"))


def over_domain(domain: DataFrame, df: DataFrame, key: str, aggs: list[Column]) -> DataFrame:
    """Aggregates for every key of a fixed domain, null where it has no rows."""
    return domain.join(df.groupBy(key).agg(*aggs), key, "left")


def heatmap(df: DataFrame, row: str, col: str) -> DataFrame:
    """Counts and row shares of a two-way table."""
    counts = df.groupBy(row, col).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(row)))


def roc_auc(df: DataFrame, score: str, label: str, keys: list[str] | None = None, one_class: float | None = None, cells: int = 256) -> DataFrame:
    """Area under the ROC curve from rank sums with mean ranks for ties (A21); one_class if a class is missing.

    Rows are first counted by score. Scores are then cut into cells at approximate quantiles: running counts are
    taken within a cell, and what lies in lower cells is added from a table of a row a cell, so no task holds
    all scores. Where the cuts lie changes no result.
    """
    keys = keys or []
    rows = df.filter(F.col(score).isNotNull())
    cuts = sorted(set(rows.approxQuantile(score, [k / cells for k in range(1, cells)], 0.01)))
    by = rows.groupBy(*keys, F.col(score).cast("double").alias("_score")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_pos"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("_neg"))
    by = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_score", outputCol="_cell", handleInvalid="keep").transform(by)
    lower = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = by.groupBy(*keys, "_cell").agg(F.sum("_neg").alias("_cell_neg")).withColumn("_before", F.coalesce(F.sum("_cell_neg").over(lower), F.lit(0))).drop("_cell_neg")
    over = Window.partitionBy(*keys, "_cell").orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("_below", F.coalesce(F.sum("_neg").over(over), F.lit(0))).join(sums, [*keys, "_cell"])
    out = by.groupBy(*keys).agg(F.sum(F.col("_pos") * (F.col("_before") + F.col("_below") + F.col("_neg") / 2.0)).alias("_u"), F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))
    area = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_u") / (F.col("n_pos") * F.col("n_neg")))
    return out.select(*keys, "n_pos", "n_neg", (area if one_class is None else F.coalesce(area, F.lit(one_class))).alias("auc"))


def macro_auc(df: DataFrame, score: str, label: str, classes: list) -> DataFrame:
    """Mean one-against-rest area over the classes that have both sides."""
    rows = df.select(F.col(score), F.explode(F.array(*(F.lit(c) for c in classes))).alias("_class"), F.col(label).alias("_label"))
    each = roc_auc(rows.withColumn("_is", (F.col("_label") == F.col("_class")).cast("int")), score, "_is", ["_class"])
    return each.agg(F.avg("auc").alias("macro_auc"))


def lower_median(value: str) -> Column:
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})")


def nearest_rank(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """The value at place round((n - 1) q), half to even.

    Values are counted first; the place is found on running counts, so ties cost one row.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*keys).orderBy(value)
    rows = counts.withColumn("_upto", F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    return rows.filter(F.col("_upto") > F.bround((F.col("_all") - 1) * q)).groupBy(*keys).agg(F.min(value).alias("quantile"))


def cluster_meat(df: DataFrame, cluster: str, score: str) -> DataFrame:
    """Sum over clusters of the squared sum of scores, and the number of clusters."""
    sums = df.groupBy(cluster).agg(F.sum(score).alias("_s"))
    return sums.agg(F.sum(F.col("_s") * F.col("_s")).alias("meat"), F.count("*").alias("n_clusters"))


def dimension_stats(df: DataFrame, vector: str, active: float) -> DataFrame:
    """Mean and population variance of each dimension, and whether the variance exceeds active."""
    rows = df.select(F.posexplode(vector).alias("dim", "_x")).select("dim", F.col("_x").cast("double").alias("_x"))
    return rows.groupBy("dim").agg(F.avg("_x").alias("mean"), F.var_pop("_x").alias("variance")).withColumn("is_active", F.col("variance") > active)


def hit_rate(df: DataFrame, query: list[str], order: list[Column], hit: Column, k: int, by: list[str]) -> DataFrame:
    """Share of queries with a hit among their first k rows, by group."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*query).orderBy(*order))).withColumn("_hit", hit)
    each = ranked.groupBy(*dict.fromkeys([*by, *query])).agg(F.max(F.when((F.col("_rn") <= k) & F.col("_hit"), 1).otherwise(0)).alias("_any"))
    return each.groupBy(*by).agg(F.avg("_any").alias("hit_rate"), F.count("*").alias("n_queries"))


def masked_mean(value: Column, mask: Column) -> Column:
    """Mean where the mask holds; 0 where it holds nowhere."""
    return F.coalesce(F.avg(F.when(mask, value)), F.lit(0.0))


def padding_efficiency(df: DataFrame, batch: list[str], size: str) -> DataFrame:
    """Share of a padded batch that is filled."""
    return df.groupBy(*batch).agg(F.count("*").alias("n"), (F.sum(size) / (F.count("*") * F.max(size))).alias("efficiency"))


def map_total(df: DataFrame, maps: str, keys: list[str]) -> DataFrame:
    """Sums of some keys of a map column over all rows; a missing key is 0."""
    return df.agg(*(F.sum(F.coalesce(F.try_element_at(F.col(maps), F.lit(k)), F.lit(0.0))).alias(k) for k in keys))

