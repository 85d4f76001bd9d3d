"""Top-k, capped and stratified selection. Each keyed order ends in a unique key, so results are stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.scalars import seeded
from matchlake.operators.splits import places_by


def recent_distinct(df: DataFrame, columns: list[str], order: str, n: int) -> DataFrame:
    """The n distinct rows of columns whose newest order value is largest."""
    return df.groupBy(*columns).agg(F.max(order).alias("newest")).orderBy(F.desc("newest"), *columns).limit(n)


def per_group(df: DataFrame, keys: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The first k rows of each group with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def weighted_count(df: DataFrame, keys: list[str], weight: str, n: int) -> DataFrame:
    """The n groups with the largest weight times row count."""
    out = df.groupBy(*keys, weight).agg(F.count("*").alias("n"))
    return out.withColumn("weighted", F.col(weight) * F.col("n")).orderBy(F.desc("weighted"), *keys).limit(n)


def hash_cap(df: DataFrame, group: str, key: str, cap: int) -> DataFrame:
    """At most cap rows a group, those whose keys have the smallest SHA-1."""
    return per_group(df, [group], [F.sha1(F.encode(F.col(key).cast("string"), "UTF-8")), F.col(key)], cap)


def best_by(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row of each key with the largest order."""
    held = F.max_by(F.struct(*df.columns), order).alias("_row")
    return df.groupBy(*keys).agg(held).select("_row.*")


def priority_bump(df: DataFrame, handled: DataFrame, key: str, tier: str, lp: str, least: int, n: int) -> DataFrame:
    """The n unhandled rows of a least tier with the most points."""
    return df.filter(F.col(tier) >= least).join(handled.select(key), key, "left_anti").orderBy(F.desc(lp), key).limit(n)


def random_per_query(queries: DataFrame, corpus: DataFrame, query: str, row: str, k: int, seed: int, exclude_same: bool = True) -> DataFrame:
    """k corpus rows a query without replacement, drawn from all rows by a hash of seed, query and draw.

    The corpus has dense places in a seeded order. A query draws distinct places one by one: the draw number j is a
    place up to j, or j itself where that is taken already, for the last k numbers j (Floyd's sampling). So there is
    nothing to redraw, and no query meets more rows than it takes. With exclude_same a query's own row is passed over. A
    corpus of fewer rows gives all of them. rank is the order of the draws.
    """
    places = places_by(corpus.select(row), row, seeded(seed, F.col(row)))
    n = corpus.count()
    asks = queries.select(query).distinct()
    asks = asks.join(places.select(F.col(row).alias(query), F.col("place").alias("_own")), query, "left") if exclude_same else asks.withColumn("_own", F.lit(None).cast("long"))
    pool = F.lit(n) - F.col("_own").isNotNull().cast("long")

    def draw(taken: Column, j: Column) -> Column:
        at = F.conv(F.right(seeded(seed, F.col(query), j), F.lit(15)), 16, 10).cast("long") % (j + 1)
        return F.array_append(taken, F.when(F.array_contains(taken, at), j).otherwise(at))

    last = F.when(pool > 0, F.sequence(F.greatest(F.lit(0).cast("long"), pool - k), pool - 1)).otherwise(F.array().cast("array<long>"))
    drawn = asks.withColumn("_taken", F.aggregate(last, F.array().cast("array<long>"), draw))
    drawn = drawn.select(query, "_own", F.posexplode("_taken").alias("_nth", "_at"))
    at = F.col("_at") + F.when(F.col("_at") >= F.col("_own"), 1).otherwise(0)
    return drawn.select(query, (F.col("_nth") + 1).alias("rank"), at.alias("place")).join(places, "place").select(query, row, "rank")


def balanced(df: DataFrame, label: str, key: str, seed: int, most: int | None = None) -> DataFrame:
    """As many rows of each class as the rarest has, or most if that is less."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    least = counts.agg(F.min("_n").alias("_least"))
    over = Window.partitionBy(label).orderBy(seeded(seed, F.col(key)), key)
    rows = df.withColumn("_rn", F.row_number().over(over)).crossJoin(F.broadcast(least))
    cap = F.col("_least") if most is None else F.least(F.col("_least"), F.lit(most))
    return rows.filter(F.col("_rn") <= cap).drop("_rn", "_least")


def band_keys(df: DataFrame, dim: DataFrame, on: str, band: str, key: str) -> DataFrame:
    """The distinct keys of each band, where a dimension gives the rows their bands."""
    return df.join(dim.select(on, band), on).select(band, key).distinct()


def stratified(df: DataFrame, bands: list[int], band: str, key: str, per_band: int) -> DataFrame:
    """per_band keys of each band, rarest band first, no key twice (T13). One pass for each of the few bands."""
    sizes = {r[band]: r["n"] for r in df.filter(F.col(band).isin(bands)).groupBy(band).agg(F.countDistinct(key).alias("n")).collect()}
    taken: DataFrame | None = None
    for b in sorted(bands, key=lambda x: (sizes.get(x, 0), x)):
        rows = df.filter(F.col(band) == b).select(key).distinct()
        if taken is not None:
            rows = rows.join(taken.select(key), key, "left_anti")
        rows = rows.orderBy(F.sha1(F.encode(F.col(key).cast("string"), "UTF-8")), key).limit(per_band).withColumn(band, F.lit(b))
        taken = rows if taken is None else taken.unionByName(rows)
    return taken


def strided(df: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """At most cap rows a key, evenly spaced: every stride-th row, stride = n // cap or 1."""
    over = Window.partitionBy(*keys)
    rows = df.withColumn("_rn", F.row_number().over(over.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(over))
    rows = rows.withColumn("_stride", F.greatest(F.lit(1), F.floor(F.col("_n") / cap)))
    return rows.filter((F.col("_rn") % F.col("_stride") == 0) & (F.floor(F.col("_rn") / F.col("_stride")) < cap)).drop("_rn", "_n", "_stride")


def rotating_stride(df: DataFrame, keys: list[str], order: list[str], stride: int, turn: int) -> DataFrame:
    """Every stride-th row from an offset that rotates with the turn."""
    rows = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return rows.filter(F.col("_rn") % stride == turn % stride).drop("_rn")
