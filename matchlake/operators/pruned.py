"""Exact nearest neighbours with blocks skipped by the triangle inequality.

Corpus rows are dealt to their nearest pivot, and a pivot's rows into blocks of bounded size, by a hash where there are many. A block keeps the
range of its rows' distances to every pivot; so does a block of queries. Two blocks whose ranges for some pivot lie further apart than the
query block's k-th distance so far can't have a neighbour of it, and never meet. That first distance comes from one block each, the nearest.

The rows are those of knn.nearest(), which lets every block meet every other; where nothing can be ruled out (far-apart directions, say) this
does what that does, and a little more. Pivots come from a bounded sample and change the speed only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.operators.knn import CORPUS_BLOCK, QUERY_BLOCK, _codes, _distances
from matchlake.sources.scratch import materialise, scratch

PIVOTS, SAMPLE = 16, 4096
#: Room for the last digits of distances that are computed in different orders.
SLACK = 1e-9


def choose_pivots(corpus: DataFrame, vector: str, n: int = PIVOTS) -> list[list[float]]:
    """Vectors far from each other, from a sample of the rows with the smallest hashes."""
    rows = corpus.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v")).orderBy(F.xxhash64("v")).limit(SAMPLE).collect()
    held = np.array([r["v"] for r in rows], float)
    if not len(held):
        return []
    chosen, away = [0], np.full(len(held), np.inf)
    while len(chosen) < min(n, len(held)):
        away = np.minimum(away, ((held - held[chosen[-1]]) ** 2).sum(axis=1))
        if away.max() <= 0:
            break
        chosen.append(int(away.argmax()))
    return held[chosen].tolist()


def _to_pivots(vector: Column, pivots: list[list[float]]) -> Column:
    """Distances of a vector to all pivots."""
    one = lambda p: F.sqrt(F.aggregate(F.zip_with(vector, F.array(*(F.lit(x) for x in p)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    return F.array(*(one(p) for p in pivots))


def _placed(rows: DataFrame, pivots: list[list[float]], size: int) -> DataFrame:
    """rows with _block, numbered from 0, and _d. A pivot's rows are cut by a hash of the id; the table of pivots has PIVOTS rows."""
    rows = materialise(rows.withColumn("_d", _to_pivots(F.col("_vec").cast("array<double>"), pivots)).withColumn("_cell", F.array_position("_d", F.array_min("_d"))), "placed")
    cells = rows.groupBy("_cell").agg(F.ceil(F.count("*") / size).cast("long").alias("_parts"))
    before = F.sum("_parts").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("_from", F.coalesce(before, F.lit(0)))
    salt = F.pmod(F.xxhash64("_id"), F.col("_parts"))
    return rows.join(F.broadcast(cells), "_cell").select(*rows.columns, (F.col("_from") + salt).alias("_block"), (salt == 0).alias("_first"))


def _ranges(blocks: DataFrame, pivots: int) -> DataFrame:
    ends = lambda f: F.array(*(f(F.get("_d", F.lit(k))) for k in range(pivots)))
    return blocks.groupBy("_block").agg(F.first("_cell").alias("_cell"), F.first("_first").alias("_first"), ends(F.min).alias("_low"), ends(F.max).alias("_high"))


def _meet(k: int):
    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": [], "r": [], "d": []})
        b = b.sort_values("_id")
        d = _distances(np.stack(a["_vec"]).astype(float), np.stack(b["_vec"]).astype(float))
        own, other = _codes(a["_x"], b["_x"])
        d[own[:, None] == other[None, :]] = np.inf
        d[d > a["_most"].to_numpy(float)[:, None] + SLACK] = np.inf
        best = np.argsort(d, axis=1, kind="stable")[:, :k]
        at = np.repeat(np.arange(len(a)), best.shape[1])
        out = pd.DataFrame({"q": a["_id"].to_numpy()[at], "r": b["_id"].to_numpy()[best.ravel()], "d": d[at, best.ravel()]})
        return out[np.isfinite(out["d"])]

    return meet


def nearest(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", row_id: str = "row_id", vector: str = "key", exclude: tuple[str, str] | None = None, query_block: int = QUERY_BLOCK, corpus_block: int = CORPUS_BLOCK, counts: dict[str, int] | None = None) -> DataFrame:
    """query_id, row_id, rank, distance of the k nearest corpus rows of each query; see knn.nearest(). Rows without a vector take no part.

    counts, if given, gets the number of pairs of blocks that met and that there are.
    """
    if exclude is None:
        queries, corpus, exclude = queries.withColumn("_qx", F.lit(0)), corpus.withColumn("_cx", F.lit(1)), ("_qx", "_cx")
    pivots = choose_pivots(corpus, vector)
    side = lambda df, i, x: df.filter(F.col(vector).isNotNull()).select(F.col(i).cast("long").alias("_id"), F.col(vector).alias("_vec"), F.col(x).alias("_x"))
    if not pivots:
        return queries.sparkSession.createDataFrame([], f"{query_id} long, {row_id} long, rank int, distance double")
    with scratch() as keep:
        q, c = _placed(side(queries, query_id, exclude[0]), pivots, query_block), _placed(side(corpus, row_id, exclude[1]), pivots, corpus_block)
        rows, heads = c.select("_block", "_id", "_vec", "_x"), materialise(_ranges(c, len(pivots)), "ranges")
        n = (heads.agg(F.max("_block")).first()[0] or 0) + 1
        pairs: list[tuple[int, int]] = []
        near = materialise(_pass(q.withColumn("_most", F.lit(float("inf"))), rows, heads, n, k, len(pivots), True, pairs), "near")
        # the k-th distance so far; without k rows nothing is known
        upto = near.groupBy("q").agg(F.sort_array(F.collect_list("d")).alias("_all")).select(F.col("q").alias("_id"), F.coalesce(F.get("_all", F.lit(k - 1)), F.lit(float("inf"))).alias("_most"))
        known = q.join(upto, "_id", "left").withColumn("_most", F.coalesce("_most", F.lit(float("inf"))))
        rest = _pass(known, rows, heads, n, k, len(pivots), False, pairs)
        if counts is not None:
            counts |= {"met": sum(m for m, _ in pairs), "every": pairs[0][1]}
        rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "r"))
        best = near.unionByName(rest).withColumn("rank", rank).filter(F.col("rank") <= k)
        return keep(materialise(best.select(F.col("q").alias(query_id), F.col("r").alias(row_id), "rank", F.col("d").alias("distance")), "nearest"))


def _pass(q: DataFrame, rows: DataFrame, heads: DataFrame, n: int, k: int, pivots: int, near: bool, met: list[tuple[int, int]]) -> DataFrame:
    """q, r, d of each query with the first block of its own pivot (near), or with all others that may hold one of its k."""
    asks = _ranges(q, pivots).join(q.groupBy("_block").agg(F.max("_most").alias("_most")), "_block")
    a = asks.select(F.col("_block").alias("_qb"), F.struct("_cell", "_low", "_high", "_most").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("_block"))
    pairs = a.join(heads.select("_block", F.struct("_cell", "_first", "_low", "_high").alias("b")), "_block")
    ends = F.arrays_zip(F.col("a._low").alias("al"), F.col("a._high").alias("ah"), F.col("b._low").alias("bl"), F.col("b._high").alias("bh"))
    gap = F.array_max(F.transform(ends, lambda e: F.greatest(e["al"] - e["bh"], e["bl"] - e["ah"])))
    own = (F.col("a._cell") == F.col("b._cell")) & F.col("b._first")
    pairs = materialise(pairs.filter(own if near else ~own & (gap <= F.col("a._most") + SLACK)).select("_qb", F.col("_block").alias("_cb")), "pairs")
    met.append((pairs.count(), asks.count() * n))
    left = q.select(F.col("_block").alias("_qb"), "_id", "_vec", "_x", "_most").join(pairs, "_qb")
    right = rows.withColumnRenamed("_block", "_cb").join(pairs, "_cb")
    return left.groupBy("_qb", "_cb").cogroup(right.groupBy("_qb", "_cb")).applyInPandas(_meet(k), "q long, r long, d double")
