"""Quality rules: counted text rules, then a hashed n-gram log-likelihood ratio for every document.

The ratio compares two multinomials over hashed unigrams and bigrams: one of documents that are trusted
(labelled good), one of the whole raw corpus. A document's score is the mean over its n-grams of
log p_target - log p_raw; a document below the fixed threshold is rejected, so a verdict depends on the
text and the two multinomials only.

Defined results: null and empty text count nothing and fail the base rules; repeated rows give repeated
results; an empty table gives an empty result; an empty target or raw table gives ratio 0 for all, so that
only the base rules decide. Extra columns of the documents pass through untouched; one that has the name of an
output column gives way to it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.shared import boxed, small_batches, text_or_empty, tidied, unboxed, widened

BUCKETS = 1 << 16
#: Mean log ratio per n-gram under which a document is rejected.
MIN_LLR = -0.35
#: Pseudo-count of each bucket of either multinomial, as a share of that multinomial's mean bucket.
SMOOTH = 0.1
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = re.compile(r"[#*$%&|<>]")
PIECES = re.compile(r"\w+|[^\w\s]+")
#: Trusted ids that are broadcast, at most; beyond, Spark joins by id.
BROADCAST_IDS = 500_000
_DISTINCT_KEPT = 200_000
_GRAMS_HELD = 1_000_000

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


class _Hashes(dict):
    """Token to 32-bit hash, computed once for each token it holds."""

    def __missing__(self, token: str) -> int:
        if len(self) > _DISTINCT_KEPT:
            self.clear()
        self[token] = value = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        return value


def ngram_buckets(text: str, hashes: _Hashes, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of each unigram and each bigram of the text."""
    pieces = PIECES.findall(text.lower())
    if not pieces:
        return np.empty(0, np.int64)
    one = np.fromiter(map(hashes.__getitem__, pieces), np.uint64, len(pieces))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64(1)
    both = np.concatenate([one * np.uint64(0xD6E8FEB86659FD93), two])
    both ^= both >> np.uint64(32)
    both *= np.uint64(0xD6E8FEB86659FD93)
    return ((both >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def measure(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # ASCII white space only, as the rules ask for
    chars = sum(len(w) for w in words)
    if chars and not raw.isascii():
        chars = sum(len(w.decode("utf-8", "surrogatepass")) for w in words)
    seen: set[bytes] = set()
    lines = dup = 0
    for line in raw.split(b"\n"):
        if line.strip(b" \t\n\r\x0b\x0c"):
            lines += 1
            seen.add(line)
    dup = lines - len(seen)
    return len(words), chars, len(SYMBOLS.findall(text)), dup, _repeated(words)


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which occurs twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    row = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    pair = np.unique(row[:-1] * len(ids) + row[1:], return_inverse=True)[1]
    _, which, times = np.unique(pair[:-1] * len(ids) + row[2:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    if not again.any():
        return 0
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : k + len(again)] |= again
    return int(inside.sum())


def ngram_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Counts of each n-gram bucket over all rows, and over those with _trusted true: a row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = _Hashes(), np.zeros((2, buckets), np.int64)
        held: list[list[np.ndarray]] = [[], []]
        waiting = 0

        def add() -> None:
            for k in (0, 1):
                if held[k]:
                    total[k] += np.bincount(np.concatenate(held[k]), minlength=buckets)
                    held[k].clear()

        for batch in batches:
            for text, trusted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = ngram_buckets(text.as_py() or "", hashes, buckets)
                held[0].append(found)
                if trusted:
                    held[1].append(found)
                waiting += len(found)
                if waiting > _GRAMS_HELD:
                    add()
                    waiting = 0
        add()
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0][used]), pa.array(total[1][used])], ["bucket", "n_raw", "n_target"])

    small_batches(docs.sparkSession)
    rows = docs.select(text_or_empty().alias("_text"), F.coalesce(F.col("_trusted"), F.lit(False)).alias("_trusted"))
    parts = rows.mapInArrow(tidied(count), "bucket long, n_raw long, n_target long")
    return parts.groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target"))


def fit_ratio(docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log p_target - log p_raw of each bucket. trusted_ids: doc_id of the trusted documents.

    The raw multinomial covers all documents, the target one all trusted documents. The driver gets one row for each bucket, whatever the size of the corpus.
    """
    ids = trusted_ids.select(F.col("doc_id").alias("_key")).filter(F.col("_key").isNotNull()).distinct().withColumn("_trusted", F.lit(True))
    small = ids.count() <= BROADCAST_IDS  # a join by id would shuffle all texts
    marked = docs.select("doc_id", "text").join(F.broadcast(ids) if small else ids, F.col("doc_id") == F.col("_key"), "left")
    table = ngram_counts(marked, buckets).toPandas()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[table["bucket"]], target[table["bucket"]] = table["n_raw"], table["n_target"]
    if not raw.sum() or not target.sum():
        return np.zeros(buckets)
    share = lambda x: (x + SMOOTH * x.sum() / buckets) / (x.sum() * (1 + SMOOTH))
    return np.log(share(target)) - np.log(share(raw))


def judge(docs: DataFrame, ratio: np.ndarray, min_llr: float = MIN_LLR) -> DataFrame:
    """docs with the five measures, llr double, base_failed and kept boolean."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(ratio)
    rows = boxed(docs, _text=text_or_empty())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table = _Hashes(), sent.value
        for batch in batches:
            found = []
            for cell in batch.column(batch.num_columns - 1):
                text = cell.as_py()
                grams = ngram_buckets(text, hashes, len(table))
                found.append((*measure(text), float(table[grams].mean()) if len(grams) else 0.0))
            columns = list(zip(*found, strict=True)) or [()] * 6
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], schema=pa.schema([*list(batch.schema)[:-1], *((n, a.type) for n, a in zip(names, arrays, strict=True))]))

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr"]
    out = rows.mapInArrow(tidied(score), widened(rows.drop("_text"), f"{MEASURES}, llr double"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= min_llr))
    return unboxed(out, *names, "base_failed", "kept")


def quality_rules(docs: DataFrame, labels: DataFrame, min_llr: float = MIN_LLR) -> DataFrame:
    """Every document with its measures and verdict; trusted documents are those labelled quality 1."""
    trusted = labels.filter(F.col("quality") == 1).select("doc_id")
    return judge(docs, fit_ratio(docs, trusted), min_llr)
