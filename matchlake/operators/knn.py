"""Exact nearest neighbours over vectors, plain and band-aware.

Queries and corpus meet in blocks: a task holds one block of the corpus against one block of queries as two
matrices, keeps each query's best k of the block, and one more ranking merges the blocks' winners. Both sides are
cut in blocks of bounded rows, and distances are held for a strip of queries at a time, so memory is bounded whatever
their sizes, and no pair leaves its task but winners. A matrix product says which pairs can be among the best k, and
only those are computed by differences, so that rows, order and distances are those of all differences.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, CORPUS_BLOCK = 1024, 16384
#: Distances that a task holds at once.
STRIP_CELLS = 1 << 19
PENALTY, SHORT = 1.25, 32
#: Squared lengths from which products could overflow; what sums of squares may lose to underflow.
WILD, TINY = 1e290, 1e-300


def _blocks(df: DataFrame, id_col: str, rows: int, name: str) -> DataFrame:
    """df with a block number by hash of the id; blocks have about so many rows."""
    n = max(1, -(-df.count() // rows))
    return df.withColumn(name, F.pmod(F.xxhash64(id_col), F.lit(n))).withColumn("_n", F.lit(n))


def _strips(n: int, m: int) -> Iterator[slice]:
    """n rows in parts that make at most STRIP_CELLS pairs with m, one row at least."""
    step = max(1, STRIP_CELLS // max(1, m))
    return (slice(at, at + step) for at in range(0, n, step))


def _distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distances in doubles; differences, not products, so that equal rows are at 0 exactly."""
    out = np.empty((len(q), len(c)))
    for k in range(len(q)):
        d = c - q[k]
        out[k] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def _codes(a: pd.Series, b: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Equal values of two columns as equal numbers, whatever their type; a null is equal to nothing."""
    both = pd.factorize(pd.concat([a, b], ignore_index=True))[0]
    one, two = both[: len(a)], both[len(a) :]
    return np.where(one < 0, -1, one), np.where(two < 0, -2, two)


class _Side(NamedTuple):
    """Vectors as rows of doubles, their squared lengths (nan for those that a product may not hold), and the factor that they are in a product."""

    vectors: np.ndarray
    squares: np.ndarray
    factor: np.ndarray

    def part(self, rows: slice) -> _Side:
        return _Side(*(x[rows] for x in self))


def _off(dims: int) -> float:
    """More than a squared distance by product or by differences can be off, as a share of the sum of both squared lengths."""
    return 8 * (dims + 8) * np.finfo(float).eps


def _sides(queries: pd.Series, corpus: pd.Series) -> tuple[_Side, _Side]:
    """Both sides of a search; the product of their factors is squared distances, lowered by more than they can be off."""
    out = []
    for asks, column in ((True, queries), (False, corpus)):
        rows = np.stack(column).astype(float)
        with np.errstate(all="ignore"):
            squares = np.einsum("ij,ij->i", rows, rows)
            squares[~(squares < WILD)] = np.nan
            low, one = squares * (1 - _off(rows.shape[1])), np.ones(len(rows))
            out.append(_Side(rows, squares, np.column_stack([-2 * rows, low, one] if asks else [rows, one, low])))
    return out[0], out[1]


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """For each row a value that k of its values don't exceed, nan where none is known; near the least such where rows are long."""
    wide, n = 8 * k, values.shape[1]
    if n >= 2 * wide:  # the k-th of the least of wide groups; what is left over only could lower it
        least = values[:, :wide].copy()
        for at in range(wide, n - wide + 1, wide):
            np.minimum(least, values[:, at : at + wide], out=least)
        values = least
    return np.partition(values, k - 1, axis=1)[:, k - 1 : k] if values.shape[1] >= k else np.full((len(values), 1), np.nan)


def _best(q: _Side, c: _Side, k: int, free: np.ndarray | None, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of q, row of c and distance of the k nearest pairs of each row of q, by distance; ties go to the earlier row of c.

    free: pairs that count, or all. times: what their distances are multiplied by. Pairs without a finite distance don't count.
    Pairs that by the product lie beyond the k-th are dropped, all others are computed by differences.
    """
    with np.errstate(all="ignore"):
        low = q.factor @ c.factor.T
        slack = 2 * _off(q.vectors.shape[1]) * (q.squares + np.nanmax(c.squares, initial=0.0))[:, None] + TINY
        if times is not None:
            low, slack = low * times**2, slack * times.max(axis=1, keepdims=True) ** 2
        if free is not None:
            np.copyto(low, np.inf, where=~free)
        may = ~(low > _kth(low, k) + slack)  # true for nan
    if free is not None:
        may &= free
    at, to = np.divmod(np.flatnonzero(may), len(c.vectors))
    d = np.empty(len(at))
    with np.errstate(all="ignore"):
        for part in _strips(len(at), q.vectors.shape[1]):
            gap = c.vectors[to[part]] - q.vectors[at[part]]
            d[part] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        if times is not None:
            d *= times[at, to]
    at, to, d = (x[np.isfinite(d)] for x in (at, to, d))
    order = np.lexsort((d, at))
    at, to, d = at[order], to[order], d[order]
    first = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[first], to[first], d[first]


def nearest(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", row_id: str = "row_id", vector: str = "key", exclude: tuple[str, str] | None = None) -> DataFrame:
    """query_id, row_id, rank, distance of the k nearest corpus rows of each query.

    exclude: a column of the queries and one of the corpus; rows where they are equal are no candidates. They
    are dropped before ranking, so a query never runs short because of them. Ties go to the smaller row_id.
    """
    if exclude is None:
        queries, corpus, exclude = queries.withColumn("_qx", F.lit(0)), corpus.withColumn("_cx", F.lit(1)), ("_qx", "_cx")
    q = _blocks(queries.select(F.col(query_id).cast("long").alias("_id"), F.col(vector).alias("_vec"), F.col(exclude[0]).alias("_x")), "_id", QUERY_BLOCK, "_qb")
    c = _blocks(corpus.select(F.col(row_id).cast("long").alias("_id"), F.col(vector).alias("_vec"), F.col(exclude[1]).alias("_x")), "_id", CORPUS_BLOCK, "_cb")
    nq, nc = q.select("_n").first(), c.select("_n").first()
    if nq is None or nc is None:
        return queries.sparkSession.createDataFrame([], f"{query_id} long, {row_id} long, rank int, distance double")
    left = q.drop("_n").withColumn("_cb", F.explode(F.sequence(F.lit(0), F.lit(nc[0] - 1)))).withColumn("_cb", F.col("_cb").cast("long"))
    right = c.drop("_n").withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(nq[0] - 1)))).withColumn("_qb", F.col("_qb").cast("long"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": [], "r": [], "d": []})
        b, out = b.sort_values("_id"), []
        asks, rows = _sides(a["_vec"], b["_vec"])
        own, other = _codes(a["_x"], b["_x"])
        for part in _strips(len(a), len(b)):
            at, to, d = _best(asks.part(part), rows, k, own[part, None] != other[None, :])
            out.append(pd.DataFrame({"q": a["_id"].to_numpy()[part][at], "r": b["_id"].to_numpy()[to], "d": d}))
        return pd.concat(out)

    winners = left.groupBy("_qb", "_cb").cogroup(right.groupBy("_qb", "_cb")).applyInPandas(meet, "q long, r long, d double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "r"))
    return winners.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("r").alias(row_id), "rank", F.col("d").alias("distance"))


def nearest_in_bands(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", row_id: str = "row_id", vector: str = "key", band: str = "band", group: str = "grp") -> DataFrame:
    """Band-aware neighbours in stages (T5, J16): same band, then adjacent ones, then all with a distance penalty.

    An unranked query or row (band under 0) fits any band. Rows of the query's own group are excluded. A ranked
    query moves to the next stage when fewer than SHORT rows are kept. Unrestricted distances grow by PENALTY for each band
    apart, where both sides are ranked. Where even that leaves too few rows for k, the plain k nearest of all rows
    serve, without exclusion or penalty. effective_k counts same-band rows before exclusion, up to k.
    """
    pair_id = lambda df, name: df.select(F.col(name).cast("long").alias("_id"), F.col(vector).alias("_vec"), F.coalesce(F.col(band).cast("int"), F.lit(-1)).alias("_band"), F.col(group).alias("_grp"))
    q, c = _blocks(pair_id(queries, query_id), "_id", QUERY_BLOCK, "_qb"), _blocks(pair_id(corpus, row_id), "_id", CORPUS_BLOCK, "_cb")
    nq, nc = q.select("_n").first(), c.select("_n").first()
    if nq is None or nc is None:
        return queries.sparkSession.createDataFrame([], f"{query_id} long, {row_id} long, rank int, distance double, stage int, effective_k long, in_band boolean")
    chosen = _staged(q.drop("_n"), c, k)
    left = chosen.select(*q.drop("_n").columns, "stage").withColumn("_cb", F.explode(F.sequence(F.lit(0), F.lit(nc[0] - 1)))).withColumn("_cb", F.col("_cb").cast("long"))
    right = c.drop("_n").withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(nq[0] - 1)))).withColumn("_qb", F.col("_qb").cast("long"))
    rows = None
    for (stage,) in sorted(chosen.select("stage").distinct().collect()):  # at most four
        met = left.filter(F.col("stage") == stage).groupBy("_qb", "_cb").cogroup(right.groupBy("_qb", "_cb")).applyInPandas(_meet_in_bands(k, stage), "q long, r long, d double, same boolean")
        rows = met if rows is None else rows.unionByName(met)
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "r"))
    best = rows.withColumn("rank", rank).filter(F.col("rank") <= k).join(chosen.select(F.col("_id").alias("q"), "_band", "stage", "effective_k"), "q")
    return best.select(F.col("q").alias(query_id), F.col("r").alias(row_id), "rank", F.col("d").alias("distance"), "stage", "effective_k", F.when(F.col("_band") >= 0, F.col("same")).alias("in_band"))


def _meet_in_bands(k: int, stage: int):
    """What a block of queries of one stage (see nearest_in_bands(); 3: the plain search) does with a block of the corpus."""

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": [], "r": [], "d": [], "same": []})
        b, out = b.sort_values("_id"), []
        asks, rows = _sides(a["_vec"], b["_vec"])
        bands, others = a["_band"].to_numpy(int)[:, None], b["_band"].to_numpy(int)[None, :]
        own, other = _codes(a["_grp"], b["_grp"])
        for part in _strips(len(a), len(b)):
            mine, free, times = bands[part], None if stage == 3 else own[part, None] != other[None, :], None
            if stage < 2:
                free &= (np.abs(mine - others) <= stage) | (mine < 0) | (others < 0)
            elif stage == 2:
                times = np.where((mine >= 0) & (others >= 0), PENALTY ** np.abs(mine - others), 1.0)
            at, to, d = _best(asks.part(part), rows, k, free, times)
            out.append(pd.DataFrame({"q": a["_id"].to_numpy()[part][at], "r": b["_id"].to_numpy()[to], "d": d, "same": (mine[at, 0] >= 0) & (mine[at, 0] == others[0, to])}))
        return pd.concat(out)

    return meet


def _staged(q: DataFrame, c: DataFrame, k: int) -> DataFrame:
    """q with stage and effective_k, from the rows of each band, and of each band within a group, that c has: no pair is formed."""
    for keys, name in (([], "n"), (["_grp"], "own")):  # the second are those that the search excludes
        n = c.groupBy(*keys, "_band").agg(F.count("*").alias("_rows"))
        every = n.groupBy(*keys).agg(F.sum("_rows").alias("_all"), F.sum(F.when(F.col("_band") < 0, F.col("_rows"))).alias("_any"))
        band = F.col("_band").cast("long")
        near = n.filter("_band >= 0").withColumn("_at", F.explode(F.array(band - 1, band, band + 1)))
        near = near.groupBy(*keys, F.col("_at").alias("_band")).agg(F.sum(F.when(F.col("_at") == F.col("_band"), F.col("_rows"))).alias("_same"), F.sum("_rows").alias("_near"))
        q = (q.join(every, keys, "left") if keys else q.crossJoin(every)).join(near, [*keys, "_band"], "left")
        count = lambda c: F.coalesce(F.when(F.col("_band") < 0, F.col("_all")).otherwise(F.coalesce("_any", F.lit(0)) + F.coalesce(c, F.lit(0))), F.lit(0))
        q = q.withColumns({f"{name}0": count("_same"), f"{name}1": count("_near"), f"{name}2": F.coalesce("_all", F.lit(0))}).drop("_all", "_any", "_same", "_near")
    kept = [F.col(f"n{i}") - F.col(f"own{i}") for i in range(3)]
    enough = lambda n: n >= min(SHORT, k)
    stage = F.when((F.col("_band") < 0) | enough(kept[0]), 0).when(enough(kept[1]), 1).otherwise(2)
    n_kept = F.when(stage == 0, kept[0]).when(stage == 1, kept[1]).otherwise(kept[2])
    return q.withColumns({"stage": F.when(n_kept < k, 3).otherwise(stage), "effective_k": F.least("n0", F.lit(k))})


def whiten_vectors(df: DataFrame, vector: str, stats: DataFrame, out: str = "key") -> DataFrame:
    """df with its vectors whitened by a table (dim, mean, sd), which is as long as a vector."""
    one = stats.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "sd"))).alias("_s")).select(F.transform("_s", lambda s: s["mean"]).alias("_m"), F.transform("_s", lambda s: s["sd"]).alias("_sd"))
    from matchlake.functions.scalars import whitened

    return df.crossJoin(F.broadcast(one)).withColumn(out, whitened(F.col(vector), F.col("_m"), F.col("_sd"))).drop("_m", "_sd")

