"""Hard negatives by exact inner-product search over a pivot table.

A vector x gets one more component, sqrt(M - |x|^2), where M is the largest squared norm; a query gets a zero. Then
|q' - x'|^2 = M + |q|^2 - 2 <q, x>: the largest inner product is the smallest Euclidean distance, for which the triangle inequality
holds. The pivot table stores each row's distances to a few pivots. A query's own distances to these bracket its distance to any row,
|d(q, p) - d(x, p)| <= d(q, x) <= d(q, p) + d(x, p), and so its score. Rows whose bracket misses what is asked for are skipped,
and the rest are scored exactly, as integers.

Rows lie in blocks of bounded size, cut by nearest pivot and, where a pivot has more rows than a block holds (a vector of
which a third of all rows are copies), by a hash. Queries lie in blocks as well. A block keeps the range of its
distances to each pivot, so pairs of blocks are ruled out before their vectors meet: row blocks move once, query blocks move to
the row blocks that are left. Each query first meets the block nearest to it, and that search gives it bounds for all others.

Scores are inner products of floor(SCALE * x). Pivots are drawn from a sample of at most PIVOT_SAMPLE rows; they change the
speed, never the result.

Defined results: rows with a null id, label or vector, with a null or non-finite component, or with a floored component of
2 ** 27 or more take no part; vectors of another length than the query's are no candidates; of rows that repeat an anchor's id the one
with the smallest label, then vector, is the anchor, and none of them is its candidate; other repeated rows are candidates of their own; ties
go to the smaller id; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.shared import materialise, scratch, small_batches, tidied, widened

SCALE, PIVOTS, PIVOT_SAMPLE = 256, 24, 4096
#: Rows of a block of the pivot table, and of a block of queries: at most some 20 MB and 5 MB at 64 components.
ROW_BLOCK, QUERY_BLOCK = 32_768, 4_096
LARGEST = 1 << 27
#: Brackets are widened by this share of the squared distances, for the rounding of stored distances.
SLACK = 4e-6
#: Scores are taken in doubles below this bound, where they are exact; in 64-bit integers beyond it.
EXACT = 1 << 53


def quantised(rows: DataFrame, ident: str, label: str, vector: str) -> DataFrame:
    """id, label, v array<long>: the rows that take part, with floored components. The vector's length goes with it as n."""
    x = F.transform(vector, lambda c: F.floor(SCALE * c.cast("double")))
    fine = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) * SCALE < LARGEST))
    kept = rows.filter(F.col(ident).isNotNull() & F.col(label).isNotNull() & F.coalesce(fine, F.lit(False)))
    return kept.select(F.col(ident).cast("long").alias("id"), F.col(label).cast("long").alias("label"), x.alias("v"), F.size(vector).alias("n"))


def choose_pivots(rows: DataFrame) -> dict[int, np.ndarray]:
    """By length of the vectors: up to PIVOTS augmented vectors far from each other, from a sample of the rows with the smallest hashes; the
    last row of each is (M, 0, ...). Only these few are on the driver."""
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    top = {r["n"]: r["m"] for r in rows.groupBy("n").agg(F.max(norm).alias("m")).orderBy(F.desc("m")).limit(PIVOT_SAMPLE).collect()}
    sample = rows.orderBy(F.xxhash64("id", "v")).limit(PIVOT_SAMPLE).select("n", "v").collect()
    out = {}
    for n, m in top.items():
        held = [r["v"] for r in sample if r["n"] == n]
        held = np.array(held, float).reshape(len(held), n)
        full = np.column_stack([held, np.sqrt(np.maximum(0, m - (held**2).sum(axis=1)))])
        chosen = [0] if len(full) else []
        away = np.full(len(full), np.inf)
        while chosen and len(chosen) < PIVOTS:
            away = np.minimum(away, ((full - full[chosen[-1]]) ** 2).sum(axis=1))
            if away.max() <= 0:
                break
            chosen.append(int(away.argmax()))
        out[n] = np.vstack([full[chosen], np.concatenate([[m], np.zeros(n)])[None]])
    return out


def _distances(v: np.ndarray, table: np.ndarray, query: bool) -> np.ndarray:
    """Distances of rows, augmented or as queries, to the pivots of a table."""
    pivots, m = table[:-1], table[-1, 0]
    own = (v.astype(float) ** 2).sum(axis=1)
    more = np.zeros(len(v)) if query else np.sqrt(np.maximum(0, m - own))
    both = v.astype(float) @ pivots[:, :-1].T + more[:, None] * pivots[:, -1]
    square = (own + more**2)[:, None] + (pivots**2).sum(axis=1) - 2 * both
    return np.sqrt(np.maximum(0, square)).astype(np.float32)


def _place(pivots, query: bool):
    """Rows with the number of their nearest pivot as a last column."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            cell = np.full(len(n), -1, np.int32)
            flat, start = batch.column("v").flatten().to_numpy(), np.cumsum(n) - n
            for size in set(n.tolist()) & pivots.value.keys():
                at = np.flatnonzero(n == size)
                cell[at] = _distances(flat[start[at][:, None] + np.arange(size)], pivots.value[size], query).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], schema=batch.schema.append(pa.field("cell", pa.int32())))

    return tidied(place)


#: first: the block that queries of its cell meet first. low and high: range of its distances to each pivot. up and down: largest and smallest
#: M + |q|^2 of its queries; asks and upto: the scores that these ask for.
BLOCK = "block long, n int, cell int, first boolean, low array<float>, high array<float>, up double, down double, asks double, upto double, blob binary"
WIDE, NARROW = "<i8", "<i2"


def _pack(pivots, query: bool):
    """The rows of one block as one row of BLOCK."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        block, n, cell, salt = (k.as_py() for k in key)
        column = lambda name: table.column(name).combine_chunks()
        v = column("v").flatten().to_numpy().reshape(table.num_rows, n)
        pivot = pivots.value.get(n)
        d = np.zeros((len(v), 0), np.float32) if pivot is None else _distances(v, pivot, query)
        square = np.full(len(v), np.inf) if pivot is None else (v.astype(float) ** 2).sum(axis=1) + pivot[-1, 0]
        kind = NARROW if np.abs(v).max(initial=0) < 1 << 15 else WIDE
        parts = [column("id").to_numpy().astype("<i8"), column("label").to_numpy().astype("<i8"), v.astype(kind), d]
        bands = [column(c).flatten().to_numpy().astype("<i8").reshape(len(v), -1) for c in ("low", "high")] if query else []
        blob = np.array([len(v), n, d.shape[1], kind == WIDE], "<i8").tobytes() + b"".join(p.tobytes() for p in parts + bands)
        asks, upto = (float(bands[0].min()), float(bands[1].max())) if query else (0.0, 0.0)
        row = [block, n, cell, salt == 0, d.min(axis=0).tolist(), d.max(axis=0).tolist(), float(square.max()), float(square.min()), asks, upto, blob]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.list_(pa.float32())] * 2, *[pa.float64()] * 4, pa.binary()]
        return pa.table([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=[x.split(" ")[0] for x in BLOCK.split(", ")])

    return pack


def _unpack(blob: bytes, bands: int = 0) -> tuple[np.ndarray, ...]:
    rows, n, p, wide = np.frombuffer(blob, "<i8", 4).tolist()
    out, at = [], 32
    for kind, width in (("<i8", 1), ("<i8", 1), (WIDE if wide else NARROW, n), ("<f4", p), *([("<i8", bands)] * 2 if bands else ())):
        out.append(np.frombuffer(blob, kind, rows * width, at).reshape(rows, width))
        at += out[-1].nbytes
    return out[0][:, 0], out[1][:, 0], *out[2:]


def _blocks(rows: DataFrame, pivots, rows_of_block: int, query: bool) -> DataFrame:
    """rows, placed, as a written table of BLOCK, numbered from 0. A cell of many rows is cut by a hash. The table of cells that is
    broadcast has PIVOTS + 1 rows at most for each length of vectors."""
    cells = rows.groupBy("n", "cell").agg(F.ceil(F.count("*") / rows_of_block).cast("long").alias("_parts"))
    before = F.sum("_parts").over(Window.orderBy("n", "cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("n", "cell", "_parts", F.coalesce(before, F.lit(0)).alias("_from"))
    dealt = rows.join(F.broadcast(cells), ["n", "cell"]).withColumn("salt", F.pmod(F.xxhash64("id", "v", "label"), "_parts")).withColumn("block", F.col("_from") + F.col("salt"))
    kept = ["block", "n", "cell", "salt", "id", "label", "v", *(["low", "high"] if query else [])]
    return materialise(dealt.select(*kept).groupBy("block", "n", "cell", "salt").applyInArrow(_pack(pivots, query), BLOCK), "blocks")


def scores_of(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows as 64-bit integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[-1]
    return (q.astype(float) @ x.astype(float).T).astype(np.int64) if most < EXACT else q.astype(np.int64) @ x.astype(np.int64).T


def survivors(may: np.ndarray, d: np.ndarray, e: np.ndarray, base: float, least: int, most: int) -> np.ndarray:
    """Those of the rows `may` whose score can lie in least..most: d are the query's distances to the pivots, e the rows', and
    base is M + |q|^2. Pivots that rule out under a tenth of the rows end the search for more: exact scores are cheaper then."""
    for at in range(0, len(d), 8):
        own, other, before = d[at : at + 8], e[may, at : at + 8], len(may)
        near, far = np.abs(other - own).max(axis=1).astype(float), (other + own).min(axis=1).astype(float)
        may = may[((base - near**2) / 2 + SLACK * base >= least) & ((base - far**2) / 2 - SLACK * base <= most)]
        if len(may) > 0.9 * before:
            break
    return may


FOUND = "query long, band int, id long, score long"


def _meet(k: int, same: bool, bands: int, squares):
    """Each pair of blocks: the first k rows of each query's bands (low <= score <= high), by score and id; of the query's label, or of others."""
    names = [x.split(" ")[0] for x in FOUND.split(", ")]

    def of_pair(n: int, asked: bytes, held: bytes) -> list[tuple]:
        ids, labels, v, d, low, high = _unpack(asked, bands)
        row_ids, row_labels, x, e = _unpack(held)
        found = []
        for j in range(len(ids)):
            may = np.flatnonzero(((row_labels == labels[j]) == same) & (row_ids != ids[j]))
            if d.shape[1] and len(may):
                base = squares.value[n] + float((v[j].astype(float) ** 2).sum())
                may = survivors(may, d[j], e, base, low[j].min(), high[j].max())
            if not len(may):
                continue
            score = scores_of(v[j : j + 1], x[may])[0]
            order = np.lexsort((row_ids[may], -score))
            score, may = score[order], may[order]
            for b in range(bands):  # scores fall: a band is a stretch of them
                first, last = np.searchsorted(-score, -high[j, b], "left"), np.searchsorted(-score, -low[j, b], "right")
                last = min(last, first + k)
                if last > first:
                    found.append((np.full(last - first, ids[j]), np.full(last - first, b), row_ids[may[first:last]], score[first:last]))
        return found

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = of_pair(*(batch.column(c)[i].as_py() for c in range(3)))
                if found:
                    query, band, row, score = (np.concatenate([f[c] for f in found]) for c in range(4))
                    for at in range(0, len(query), 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000], t) for x, t in ((query, pa.int64()), (band.astype(np.int32), pa.int32()), (row, pa.int64()), (score, pa.int64()))], names)

    return tidied(meet)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query", "band").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def may_meet() -> Column:
    """Whether the brackets of two blocks, structs q and r of BLOCK, leave a score that q asks for. Ranges of distances that lie apart
    bound the distance from below, their upper ends from above."""
    wide = lambda side, end: F.transform(f"{side}.{end}", lambda c: c.cast("double"))
    ends = F.arrays_zip(wide("q", "low").alias("ql"), wide("q", "high").alias("qh"), wide("r", "low").alias("rl"), wide("r", "high").alias("rh"))
    gap = F.array_max(F.transform(ends, lambda e: F.greatest(F.lit(0.0), e["ql"] - e["rh"], e["rl"] - e["qh"])))
    far = F.array_min(F.transform(ends, lambda e: e["qh"] + e["rh"]))
    up = (F.col("q.up") - gap * gap) / 2 + SLACK * F.col("q.up")
    down = (F.col("q.down") - far * far) / 2 - SLACK * F.col("q.up")
    return F.coalesce((up >= F.col("q.asks")) & (down <= F.col("q.upto")), F.lit(True))  # no pivots, no brackets


class PivotTable:
    """Rows (id, label, v, n) in blocks with their stored pivot distances. Searches are exact, whatever the pivots."""

    def __init__(self, rows: DataFrame, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK):
        spark = rows.sparkSession
        small_batches(spark)
        self.query_block = query_block
        tables = choose_pivots(rows)
        self.pivots = spark.sparkContext.broadcast(tables)
        self.squares = spark.sparkContext.broadcast({n: float(t[-1, 0]) for n, t in tables.items()})
        rows = rows.select("id", "label", "v", "n")
        self.rows = _blocks(rows.mapInArrow(_place(self.pivots, False), widened(rows, "cell int")), self.pivots, row_block, False)
        self.n_blocks = (self.rows.agg(F.max("block")).first()[0] or 0) + 1
        #: Pairs of blocks that the last search() met, and all that there are: in the pass of the nearest blocks, and in the other.
        self.met: list[tuple[int, int]] = []

    def search(self, queries: DataFrame, k: int, same: bool, bands: int) -> DataFrame:
        """query, band, id, score, rank of the first k rows of each band of each query: queries has id, label, v, n and
        arrays low and high of `bands` longs each. Rows of the query's own id don't count."""
        queries = queries.select("id", "label", "v", "n", "low", "high")
        placed = materialise(queries.mapInArrow(_place(self.pivots, True), widened(queries, "cell int")), "queries")
        self.met = []
        near = materialise(_ranked(self._pass(placed, k, same, bands, True), k), "near")
        # a band that the nearest blocks have filled asks for nothing below its last score
        full = near.filter(F.col("rank") == k).groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("band", "score"))).alias("_full"))
        raised = F.transform("low", lambda x, b: F.greatest(x, F.coalesce(F.try_element_at("_full", b), x)))
        again = placed.join(full.withColumnRenamed("query", "id"), "id", "left").withColumn("low", raised).drop("_full")
        rest = self._pass(again, k, same, bands, False)
        return _ranked(near.select("query", "band", "id", "score").unionByName(rest), k)

    def _pass(self, queries: DataFrame, k: int, same: bool, bands: int, near: bool) -> DataFrame:
        """FOUND of the first block of each query's own cell (near), or of all others whose brackets leave something."""
        asked = _blocks(queries, self.pivots, self.query_block, True)
        head = lambda t, name: t.select("block", F.struct(*[c for c in t.columns if c not in ("block", "blob")]).alias(name))
        heads = head(asked, "q").select(F.col("block").alias("asked"), "q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.n_blocks - 1).cast("long"))).alias("block"))
        pairs = heads.join(head(self.rows, "r"), "block").filter(F.col("q.n") == F.col("r.n"))
        nearest = (F.col("q.cell") == F.col("r.cell")) & F.col("r.first")
        pairs = materialise(pairs.filter(nearest if near else ~nearest & may_meet()).select("asked", "block"), "pairs")
        self.met.append((pairs.count(), asked.count() * self.n_blocks))
        sides = pairs.join(asked.select(F.col("block").alias("asked"), "n", F.col("blob").alias("_asked")), "asked").join(self.rows.select("block", F.col("blob").alias("_held")), "block")
        return sides.select("n", "_asked", "_held").mapInArrow(_meet(k, same, bands, self.squares), FOUND)


def _four_fifths(p: Column) -> Column:
    """The smallest whole number that is 80 % of p at least; p is not negative."""
    return F.call_function("div", p * 4 + 4, F.lit(5).cast("long"))


def hard_negatives(rows: DataFrame, ident: str = "vec_id", label: Column | str = "label", vector: str = "embedding", every: int = 100, k: int = 5, row_block: int = ROW_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Anchors are rows whose id is a multiple of every; positives
    the first k other rows of an anchor's label; negatives, for each of these, the first k rows of other labels that score from 80 % of
    the positive's score up to the whole."""
    with scratch() as keep:
        rows = rows.withColumn("_label", label if isinstance(label, Column) else F.col(label))
        held = materialise(quantised(rows, ident, "_label", vector), "rows")
        table = PivotTable(held, row_block)
        lone = held.filter(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "v", "n")).alias("_a")).select("id", "_a.label", "_a.v", "_a.n")
        anchors = materialise(lone, "anchors")
        far = 1 << 62
        ends = lambda low, high: {"low": F.array(F.lit(low).cast("long")), "high": F.array(F.lit(high).cast("long"))}
        positives = materialise(table.search(anchors.withColumns(ends(-far, far)), k, True, 1), "positives")
        # n >= 80 % of p in whole numbers; a negative p has no scores from 80 % of it up to it
        at = F.map_from_entries(F.collect_list(F.struct("rank", "score")))
        scores = positives.filter("score >= 0").groupBy("query").agg(at.alias("_p"))
        each = F.sequence(F.lit(1), F.lit(k))
        p = lambda r: F.try_element_at("_p", r)
        low = F.transform(each, lambda r: F.coalesce(_four_fifths(p(r)), F.lit(far)))
        high = F.transform(each, lambda r: F.coalesce(p(r), F.lit(-far)))
        bands = anchors.join(scores.withColumnRenamed("query", "id"), "id").withColumn("low", low).withColumn("high", high).drop("_p")
        negatives = table.search(bands, k, False, k)
        of = positives.select("query", (F.col("rank") - 1).alias("band"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        out = negatives.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score").join(of, ["query", "band"])
        return keep(materialise(out.select(F.col("query").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "negatives"))

