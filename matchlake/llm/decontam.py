"""Benchmark decontamination by size-partitioned MinHash containment search, with DataFrame functions only.

A test item is inside a document when the document holds at least THRESHOLD percent of the item's distinct
word shingles. Items are partitioned by size, in powers of two. The sketch of an item is the k smallest of its
shingle hashes, where k is so large for its partition that a document with too few of the item's shingles to
miss them all cannot be one that contains it: of n shingles a containing document lacks floor(n / 5) at most,
so among any floor(n / 5) + 1 of them it holds one. The search therefore loses nothing. A document's hashes
probe the sketches, documents too short for an item's partition fall out, and what is left is verified by
the shingles themselves.

Words are runs of letters and digits, lower-cased. An item with fewer words than a shingle is one shingle of its own
width, its whole sequence of words; documents are cut to such widths only where there are such items.
Defined results: null and empty texts hold nothing, and an item without words is found nowhere; repeated rows and
items give one pair, with the largest count; null ids stay null; empty tables give an empty result. Other columns of
documents pass through decontaminate(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.llm.shared import boxed, materialise, once, scratch, text_or_empty, unboxed

WIDTH = 5
#: Percent of an item's distinct shingles that a document holds when the item counts as contained.
THRESHOLD = 80


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _at(words: Column, k: Column, ahead: int) -> Column:
    return F.get(words, k + ahead)


def _starts(words: Column, width: int) -> Column:
    last = F.size(words) - width
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(words: Column, width: int = WIDTH) -> Column:
    """Distinct 64-bit hashes of the shingles; those of different widths differ."""
    return once(words, lambda w: F.array_distinct(F.transform(_starts(w, width), lambda k: F.xxhash64(F.lit(width), *(_at(w, k, a) for a in range(width))))))


def shingles(words: Column, width: int = WIDTH) -> Column:
    """The distinct shingles themselves."""
    return once(words, lambda w: F.array_distinct(F.transform(_starts(w, width), lambda k: F.concat_ws(" ", *(_at(w, k, a) for a in range(width))))))


def _by_width(make: Callable[[Column, int], Column], words: Column, width: Column, widths: list[int]) -> Column:
    """make(words, width) for a column of widths that holds these only."""
    out = make(words, widths[-1])
    for w in widths[:-1]:
        out = F.when(width == w, make(words, w)).otherwise(out)
    return out


def item_sketches(items: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """item_id, width, size (distinct shingles), partition, item_shingles, sketch."""
    rows = items.select("item_id", words_of(text_or_empty()).alias("_words")).withColumn("width", F.least(F.size("_words"), F.lit(WIDTH))).filter("width > 0")
    widths = list(range(1, WIDTH + 1))
    rows = rows.select("item_id", "width", _by_width(shingle_hashes, F.col("_words"), F.col("width"), widths).alias("_hashes"), _by_width(shingles, F.col("_words"), F.col("width"), widths).alias("item_shingles"))
    rows = rows.withColumn("size", F.size("item_shingles")).withColumn("partition", F.floor(F.log2("size")).cast("int"))
    largest = F.expr("shiftleft(2, partition)") - 1
    kept = (largest * (100 - threshold) / 100).cast("int") + 1
    return rows.withColumn("sketch", F.slice(F.sort_array("_hashes"), F.lit(1), kept)).drop("_hashes")


def candidate_pairs(docs: DataFrame, sketches: DataFrame, widths: list[int], threshold: int = THRESHOLD) -> DataFrame:
    """Distinct (doc_id, _text_hash, item) of documents that share a sketch hash with an item of fitting size."""
    probes = sketches.select("item", "partition", F.explode("sketch").alias("hash"))
    every = once(words_of(text_or_empty()), lambda w: F.concat(*(shingle_hashes(w, n) for n in widths)))
    rows = docs.select("doc_id", F.xxhash64("text").alias("_text_hash"), every.alias("_hashes"))
    rows = rows.select("doc_id", "_text_hash", F.size("_hashes").alias("_size"), F.explode("_hashes").alias("hash"))
    fits = 100 * F.col("_size") >= threshold * F.expr("shiftleft(1, partition)")
    return rows.join(probes, "hash").filter(fits).select("doc_id", "_text_hash", "item").distinct()


def contained_items(docs: DataFrame, items: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Written table doc_id, _text_hash, item_id, n_item_shingles, n_shared: the verified pairs."""
    with scratch() as keep:
        sketches = materialise(item_sketches(items, threshold).withColumn("item", F.monotonically_increasing_id()), "sketches")
        widths = sorted(r.width for r in sketches.select("width").distinct().collect()) or [WIDTH]  # five at most
        found = materialise(candidate_pairs(docs.select("doc_id", "text"), sketches, widths, threshold), "candidates")
        texts = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), text_or_empty().alias("_text"))
        pairs = found.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")))
        pairs = pairs.join(sketches.select("item", "item_id", "width", "size", "item_shingles"), "item")
        own = _by_width(shingles, words_of(F.col("_text")), F.col("width"), widths)
        pairs = pairs.withColumn("n_shared", F.size(F.array_intersect(own, "item_shingles")))
        pairs = pairs.filter(100 * F.col("n_shared") >= threshold * F.col("size"))
        best = pairs.groupBy("doc_id", "_text_hash", "item_id").agg(F.max(F.struct("n_shared", "size")).alias("_best"))
        best = best.select("doc_id", "_text_hash", "item_id", F.col("_best.size").cast("long").alias("n_item_shingles"), F.col("_best.n_shared").cast("long").alias("n_shared"))
        return keep(materialise(best, "contained"))


def leaks(docs: DataFrame, items: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared: one row for each document and item it contains."""
    best = contained_items(docs, items, threshold).groupBy("doc_id", "item_id").agg(F.max(F.struct("n_shared", "n_item_shingles")).alias("_best"))
    return best.select("doc_id", "item_id", "_best.n_item_shingles", "_best.n_shared")


def decontaminate(docs: DataFrame, items: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The documents that contain no item."""
    dirty = contained_items(docs, items, threshold).select(F.col("doc_id").alias("_id"), F.col("_text_hash").alias("_hash")).distinct()
    rows = boxed(docs, _own=F.col("doc_id"), _text_hash=F.xxhash64("text"))
    return unboxed(rows.join(dirty, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left_anti"))
