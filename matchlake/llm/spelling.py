"""Spelling variants: words one edit apart, found by integer keys of their deletions.

A word with one code point left out is a *deletion*. Two words that differ by one replaced code point have the same deletion at
the same place; a word that another has one code point more than is itself a deletion of that one. Deletions are not built: a
word's code points are hashed by polynomials from the front and from the back, and the hash of a deletion is a sum of two of these,
for all places of all words of a batch at once. So a word of n code points costs 2n + 1 numbers, whatever its length.

Keys are dealt out by their value (each partition is one radix of them, and their number sets the number of partitions), and
sorted there as numbers. Keys that stand alone go; for the rest the deletions themselves are compared, so that equal hashes of
different strings join nothing. A key's words number at most the letters of the alphabet (a replacement), or letters times places
(an insertion), as words are distinct; what a word gains from a key is a count and its best neighbour, so no pairs are written.

Defined results: a null text has no words; a null id is an empty text in the hash of the damage; repeated rows count as often as
they occur; ties in frequency go to the smaller word in code-point order; an empty table gives no words. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.shared import materialise, scratch, small_batches, tidied

#: The letters of a run, fixed values.
LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT, TIMES, DAMAGE = 7, 2, 10, 31
#: Keys of a partition, about: two arrays of 16 MB in the worker that sorts them.
PART_KEYS = 2_000_000
BASE = 0x9E3779B97F4A7C15  # odd, so that its powers never vanish
WORD, INSERTED = -1, -2  # places: the word itself; INSERTED - i is a deletion at i, to be met by a whole word


def damaged(key: Column, run: Column) -> Column:
    """run, without one code point where the checksum of key and run is a multiple of DAMAGE: a planted misspelling."""
    h = F.crc32(F.encode(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (h % F.length(run)).cast("int")
    short = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % DAMAGE == 0, short).otherwise(run)


def count_words(docs: DataFrame, key: str = "doc_id", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: bool = True) -> DataFrame:
    """word, n: the runs of letters of all whole texts, A-Z lower-cased, of min_length code points that occur min_count times.

    Maximal runs under min_length can't give a word, so the pattern itself leaves them out.
    """
    runs = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(f"{LETTERS}{{{min_length},}}"), F.lit(0))
    words = F.transform(runs, lambda r: F.translate(r, UPPER, LOWER))
    words = F.transform(words, lambda w: damaged(F.col(key), w)) if damage else words
    rows = docs.select(F.explode(words).alias("word")).filter(F.length("word") >= min_length)
    return rows.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers: sums of powers alone have weak low bits, and the low bits deal the keys out."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, number of the word, place: of each word itself (place WORD), of its deletions met by a whole word (INSERTED - i, at the first place
    of equal letters in a row) and of its deletions at the same place (i). All arithmetic is modulo 2 ** 64."""
    code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    of = np.repeat(np.arange(len(words)), size)
    start = np.cumsum(size) - size
    place = np.arange(len(code)) - start[of]
    power = np.full(int(size.max(initial=0)) + 1, BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    letter = _mix(code + np.uint64(1))
    zero = np.zeros(1, np.uint64)
    front = np.concatenate([zero, np.cumsum(letter * power[place + 1], dtype=np.uint64)])  # letters before a place, as they stand
    back = np.concatenate([zero, np.cumsum(letter * power[place], dtype=np.uint64)])  # letters behind it, moved up by one
    end = start + size
    at = np.arange(len(code))
    gone = (front[at] - front[start[of]]) + (back[end[of]] - back[at + 1])
    whole = front[end] - front[start]
    first = (place == 0) | (code != np.concatenate([zero, code[:-1]]))
    keys = np.concatenate([_mix(whole), _mix(gone[first]), _mix(gone + _mix(place.astype(np.uint64) + np.uint64(1 << 40)))])
    return keys.view(np.int64), np.concatenate([np.arange(len(words)), of[first], of]), np.concatenate([np.full(len(words), WORD), INSERTED - place[first], place])


KEYS = "key long, id long, place int"


def _batch(key: np.ndarray, ident: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(ident, pa.int64()), pa.array(place.astype(np.int32), pa.int32())], ["key", "id", "place"])


def _make_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        key, of, place = deletion_keys(batch.column(1).to_pylist())
        for at in range(0, len(key), 500_000):
            here = slice(at, at + 500_000)
            yield _batch(key[here], ids[of[here]], place[here])


def shared_keys(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Positions, in the order of key, of what may have a partner: a place that another word shares, or a word and a deletion that equals it."""
    order = np.argsort(key, kind="stable")
    key, place = key[order], place[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    count = lambda which: np.add.reduceat(which.astype(np.int64), head) if len(head) else np.empty(0, np.int64)
    useful = (count(place >= 0) > 1) | ((count(place == WORD) > 0) & (count(place < WORD) > 0))
    return order[np.repeat(useful, np.diff(np.append(head, len(key))))]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of one partition, sorted as numbers."""
    parts = [[batch.column(k).to_numpy() for k in range(3)] for batch in batches if batch.num_rows]
    if parts:
        key, ident, place = (np.concatenate([p[k] for p in parts]) for k in range(3))
        del parts
        kept = shared_keys(key, place)
        for at in range(0, len(kept), 100_000):
            here = kept[at : at + 100_000]
            yield _batch(key[here], ident[here], place[here])


def near_words(words: DataFrame) -> DataFrame:
    """id, n_near, best struct<less long, word string> of every row of words (id, word, n) with a word one edit apart. words is read
    three times: it should be a written table, so that its ids stay."""
    spark = words.sparkSession
    small_batches(spark)
    numbers = words.agg(F.sum(2 * F.length("word") + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-numbers // PART_KEYS))
    keys = words.select("id", "word").mapInArrow(tidied(_make_keys), KEYS)
    met = keys.repartition(parts, "key").mapInArrow(tidied(_meet), KEYS)
    # the strings come to the few keys that are left, and decide
    gone = F.when(F.col("place") >= 0, F.col("place")).when(F.col("place") < WORD, F.lit(INSERTED) - F.col("place"))
    left = F.when(gone.isNull(), F.col("word")).otherwise(F.concat(F.substring("word", F.lit(1), gone), F.substring(F.col("word"), gone + 2, F.length("word"))))
    # a word and the deletions that equal it are one space, each place of replacements another
    space = F.when(F.col("place") < 0, F.lit(-1)).otherwise(F.col("place"))
    members = met.join(words, "id").select("id", "place", "key", space.alias("_space"), left.alias("left"), F.struct((-F.col("n")).alias("less"), "word").alias("me"))
    group = Window.partitionBy("key", "_space", "left")
    ranked = group.orderBy("me").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole, longer = F.col("place") == WORD, F.col("place") < WORD
    first, second = F.first("me").over(ranked), F.nth_value("me", 2).over(ranked)
    best = F.when(whole, F.min(F.when(longer, F.col("me"))).over(group)).when(longer, F.min(F.when(whole, F.col("me"))).over(group)).otherwise(F.when(first == F.col("me"), second).otherwise(first))
    n = F.when(whole, F.count(F.when(longer, 1)).over(group)).when(longer, F.count(F.when(whole, 1)).over(group)).otherwise(F.count("*").over(group) - 1)
    return members.select("id", best.alias("best"), n.alias("n")).groupBy("id").agg(F.sum("n").alias("n_near"), F.min("best").alias("best")).filter("n_near > 0")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, form, form_n, root, n_near of every row of words (id, word, n): form is the most frequent word one edit apart, if it is
    times as frequent at least; root is the last of a chain of forms. Frequency grows by times along a chain, so it ends,
    and its length has a bound; pointers double their reach in each round."""
    near = near_words(words)
    n, word = -F.col("best.less"), F.col("best.word")
    clear = n >= times * F.col("n")
    out = materialise(words.join(near, "id", "left").select("word", "n", F.when(clear, word).alias("form"), F.when(clear, n).alias("form_n"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near")), "near")
    chain = out.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    high = words.agg(F.max("n"), F.min("n")).first()
    reach, longest = 1, 0
    while high[0] is not None and high[1] * times ** (longest + 1) <= high[0]:
        longest += 1
    while reach < longest:
        chain = materialise(chain, "chain")
        onward = chain.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        chain = chain.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
        reach *= 2
    return out.join(chain, "word", "left").withColumn("root", F.coalesce("root", "word")).select("word", "n", "form", "form_n", "root", "n_near")


def spelling_variants(docs: DataFrame, key: str = "doc_id", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, times: int = TIMES, damage: bool = True) -> DataFrame:
    """variants() of the words of docs' texts. damage plants misspellings of its own; leave it out for real texts' own."""
    with scratch() as keep:
        words = materialise(count_words(docs, key, min_length, min_count, damage).withColumn("id", F.monotonically_increasing_id()), "words")
        return keep(materialise(variants(words, times), "variants"))
