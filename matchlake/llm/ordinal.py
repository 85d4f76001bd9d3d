"""Cumulative-link (proportional odds) regression over hashed text features.

P(grade > k) = sigmoid(w.x - theta_k): one weight vector is shared by all thresholds, and the thresholds
are ordered by construction. x marks which hashed features a text has. The model is fitted on a bounded
sample of labelled rows and scores every row.

Defined results: null text is empty; labels without id, with a null grade or with one outside the scale are left out,
as are labels of absent documents; of several grades of one id the largest counts, of several texts of one id the
smallest; without labels, or with one grade only, no feature has weight and every document gets the same score;
repeated rows give repeated results; an empty table gives an empty result. Ties in the sample go by hash, then id.
Scored rows come boxed, so that names of the documents' columns can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.shared import bounded_sample, boxed, small_batches, text_or_empty, tidied, widened

BITS = 20
#: Labelled documents that a model is fitted on, at most.
FIT_ROWS = 20_000
#: A feature takes part when this many fitted documents have it, and their mean grade is so many standard errors off.
#: Both are parameters of the fit; 1 and 0 let every feature in and leave the choice to the penalty.
MIN_DOCS, MIN_Z = 5, 4.5
L2 = 1.0
STEPS, RATE = 400, 0.1

Features = Callable[[str], set[str]]


@dataclass(frozen=True)
class OrdinalModel:
    buckets: np.ndarray  # sorted
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    @property
    def table(self) -> dict[int, float]:
        return dict(zip(self.buckets.tolist(), self.weights.tolist(), strict=True))

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def bucket_of(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) >> (32 - BITS)


def fit_model(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, min_docs: int = MIN_DOCS, min_z: float = MIN_Z) -> OrdinalModel:
    """rows: the distinct buckets of each document. With fewer than two grades seen, no feature has weight."""
    n = len(rows)
    sizes = np.fromiter(map(len, rows), np.int64, n)
    cols = np.concatenate(rows) if n else np.empty(0, np.int64)
    at = np.repeat(np.arange(n), sizes)
    share = np.array([((grades > k).sum() + 0.5) / (n + 1) for k in range(n_grades - 1)])
    theta = -np.log(share / (1 - share))
    spread = grades.std() if n else 0.0
    if not spread:
        return OrdinalModel(np.empty(0, np.int64), np.empty(0), theta)
    have = np.bincount(cols, minlength=1 << BITS)
    mean = np.bincount(cols, weights=grades[at], minlength=1 << BITS) / np.maximum(have, 1)
    z = (mean - grades.mean()) / (spread / np.sqrt(np.maximum(have, 1)))
    buckets = np.flatnonzero((have >= max(1, min_docs)) & (np.abs(z) >= min_z))
    if not len(buckets):
        return OrdinalModel(buckets, np.empty(0), theta)
    place = np.searchsorted(buckets, cols)
    place[place == len(buckets)] = 0
    known = buckets[place] == cols
    col, row = place[known], at[known]
    # theta_0 free, then the logarithm of each gap; Adam on the penalised likelihood
    free = np.concatenate([np.zeros(len(buckets)), theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))])
    m, v, d = np.zeros_like(free), np.zeros_like(free), len(buckets)
    for step in range(1, STEPS + 1):
        theta = np.cumsum(np.concatenate([free[d : d + 1], np.exp(free[d + 1 :])]))
        score = np.bincount(row, weights=free[:d][col], minlength=n)
        tail = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -500, 500)))
        edge = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
        p = np.maximum(np.take_along_axis(edge, grades[:, None], 1) - np.take_along_axis(edge, grades[:, None] + 1, 1), 1e-12)[:, 0]
        slope = np.concatenate([np.zeros((n, 1)), tail * (1 - tail), np.zeros((n, 1))], axis=1)
        low, high = np.take_along_axis(slope, grades[:, None], 1)[:, 0], np.take_along_axis(slope, grades[:, None] + 1, 1)[:, 0]
        g_score = (low - high) / p
        g_theta = np.zeros(n_grades - 1)
        np.add.at(g_theta, grades[grades > 0] - 1, -(low / p)[grades > 0])
        np.add.at(g_theta, grades[grades < n_grades - 1], (high / p)[grades < n_grades - 1])
        later = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([np.bincount(col, weights=g_score[row], minlength=d) - L2 * free[:d], later[:1], later[1:] * np.exp(free[d + 1 :])]) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        free = free + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return OrdinalModel(buckets, free[:d], np.cumsum(np.concatenate([free[d : d + 1], np.exp(free[d + 1 :])])))


def fit_on_labels(docs: DataFrame, grades: DataFrame, features: Features, n_grades: int, fit_rows: int = FIT_ROWS, min_docs: int = MIN_DOCS, min_z: float = MIN_Z) -> OrdinalModel:
    """grades: doc_id, grade (0 to n_grades - 1); a document with several grades counts with the largest."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({bucket_of(f) for f in features(t.as_py())}) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], ["buckets", "grade"])

    usable = grades.filter(F.col("grade").between(0, n_grades - 1))
    sample = bounded_sample(usable, "doc_id", fit_rows)
    graded = usable.join(F.broadcast(sample), F.col("doc_id") == F.col("_key"), "left_semi").groupBy(F.col("doc_id").alias("_key")).agg(F.max("grade").cast("int").alias("_grade"))
    rows = docs.select("doc_id", text_or_empty().alias("_text")).join(F.broadcast(graded), F.col("doc_id") == F.col("_key"))
    rows = rows.groupBy("doc_id").agg(F.min("_text").alias("_text"), F.min("_grade").alias("_grade"))  # one text an id
    held = rows.select("_text", "_grade").mapInArrow(tidied(extract), "buckets array<int>, grade int").toArrow()
    lists, found = held.column("buckets").combine_chunks(), held.column("grade").to_numpy()
    values, ends = lists.flatten().to_numpy().astype(np.int64), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(int)
    return fit_model(np.split(values, ends[:-1]) if len(ends) else [], found.astype(np.int64), n_grades, min_docs, min_z)


def score_rows(docs: DataFrame, model: OrdinalModel, features: Features) -> DataFrame:
    """docs boxed as _row, expected_grade double, and tails array<double>: P(grade > 0), P(grade > 1), ..."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = boxed(docs, _text=text_or_empty())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        weights = _Weights(model.table)
        for batch in batches:
            scores = np.array([sum(map(weights.__getitem__, features(t.as_py()))) for t in batch.column(batch.num_columns - 1)], float)
            tails = model.tails(scores)
            arrays = [pa.array(tails.sum(axis=1)), pa.array(list(tails), pa.list_(pa.float64()))]
            schema = pa.schema([*list(batch.schema)[:-1], ("expected_grade", pa.float64()), ("tails", pa.list_(pa.float64()))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], schema=schema)

    return rows.mapInArrow(tidied(score), widened(rows.drop("_text"), "expected_grade double, tails array<double>"))


class _Weights(dict):
    """Feature to weight, looked up once for each feature it holds. Two features of one bucket both count."""

    def __init__(self, table: dict[int, float]):
        super().__init__()
        self.table = table

    def __missing__(self, feature: str) -> float:
        if len(self) > 200_000:
            self.clear()
        self[feature] = value = self.table.get(bucket_of(feature), 0.0)
        return value
