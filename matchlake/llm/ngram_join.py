"""N-gram Jaccard join: grouped prefix join over word shingles, and the components of its links.

A document's set is its distinct five-word shingles as 64-bit hashes. Texts with equal sets form a class.
Two sets x, y with 100 |x & y| >= 80 |x | y| share a shingle among the first n - ceil(0.8 n) + 1 of each, under
any one order of all shingles. The order here is: shingles that are not known to be frequent by hash, then the
frequent ones by hash. So lists of a passage that many documents share do not arise, and a prefix tells near copies
apart by what is their own; the frequent set is counted over all classes, bounded in size, and changes no result.

Classes with the same prefix and size are one group. Groups that share a prefix shingle meet in its list.
Entries travel in blobs by buckets of their hashes, of which there are more the larger the corpus is; beyond COARSE_BITS they
are dealt out twice, so that a blob always holds many entries. Lists of more than BLOCK members are worked on in blocks, and
blocks meet in pairs, so no list is one task's.
Pairs of groups in short lists are filtered by size, by position, and by how many prefix shingles they share:
two prefixes under one order show every common shingle up to where the first of them ends, so similar sets
share at least the needed overlap less what stands behind the prefixes. What is left expands to the groups'
members, and pairs of members are verified by their whole sets. Long lists, which large groups of near copies make,
are not paired off: pairs within a component need no verification, so each round links a list's members to a few
pivots, and only pairs that are then still apart are taken in full. No link is lost.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; fewer than five
words make one shingle; repeated rows are linked with one another; the smallest id passes over null ids, and
a row with a null id takes the id of its component; an empty table gives an empty result. Other columns
pass through keep_one(), whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm.shared import boxed, drop_path, drop_table, fresh_path, lookup_hot_safe, materialise, pack, scratch, small_batches, text_or_empty, tidied, unboxed, unpack

WIDTH, PERCENT = 5, 80
#: A shingle that more classes have than this is frequent; at most so many shingles count as frequent.
FREQUENT, FREQUENT_HELD = 32, 1 << 18
#: A list of more groups than this is long; one of more members than that is worked on in blocks of so many.
LONG, BLOCK = 32, 1024
#: Lists of several blocks that are looked up by broadcast, at most; beyond, Spark joins and splits what is skewed.
BROADCAST_LISTS = 200_000
#: Bits of the filter that says of which classes the sets are wanted, at least and at most.
FILTER_BITS = (16, 27)
#: Prefix entries that one partition is planned to hold, and that a task holds before it sends them on.
PART_ENTRIES, HELD_ENTRIES = 2_000_000, 1_000_000
#: Buckets that a task sends to at once, in bits; entries of more buckets are dealt out by these first, then by all.
COARSE_BITS = 12
#: Rounds in which members meet pivots only, and random pivots of a list beside its best linked member.
ROUNDS, PIVOTS = 3, 2

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingle_sets(column: pa.Array, hashes: _Hashes, rows: int = 256) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each whole text, some texts at a time. A-Z count as a-z; ASCII white space parts words."""
    for at in range(0, len(column), rows):
        words = [t.lower().split() for t in column.slice(at, rows).cast(pa.binary()).to_pylist()]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        total = int(sizes.sum())
        one = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), np.uint64, total)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        mixed = np.zeros(total, np.uint64)
        if total >= WIDTH:
            mixed[: total - 4] = one[: total - 4] * _ODD[0]
            for k in range(1, WIDTH):
                mixed[: total - 4] += one[k : total - 4 + k] * _ODD[k]
        for k in np.flatnonzero((sizes > 0) & (sizes < WIDTH)):  # the whole sequence as one
            a, n = starts[k], int(sizes[k])
            mixed[a : a + 1] = (one[a : a + n] * _ODD[:n]).sum(keepdims=True) + np.full(1, n, np.uint64) * _ODD[4] + np.uint64(1)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _ODD[3]
        mixed ^= mixed >> np.uint64(32)
        for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
            own = mixed[a : a + (n - WIDTH + 1 if n >= WIDTH else min(n, 1))]
            own.sort()
            yield own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own.copy()


def _key(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Rows of one bucket together, bucket after bucket."""
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket")


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    now, held = 0, []
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append(blob.as_py())
    if held:
        yield now, held


def _runs(home: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each value of a sorted array with its place; values that don't occur cost nothing."""
    cuts = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1], [True]])) if len(home) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(home[a]), slice(a, b)


def _batch(blobs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in blobs], pa.int32()), pa.array([b for _, b in blobs], pa.binary())], ["bucket", "blob"])


def _dealt_again(rows: DataFrame, parts: int, bits: int, split: Callable[[list[np.ndarray], int], list[tuple[int, bytes]]]) -> DataFrame:
    """Blobs by bucket, one bucket after the other. Those of coarse buckets are split into all 1 << bits on their way.

    split: the columns of some blobs, and the number of bits, to blobs by bucket.
    """
    if bits <= COARSE_BITS:
        return _dealt(rows, parts)

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0
        whole = lambda: _batch(split([np.concatenate(c) for c in zip(*held, strict=True)], bits))
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and (bucket != now or size >= HELD_ENTRIES):
                    yield whole()
                    held, size = [], 0
                now = bucket
                held.append(unpack(blob.as_py()))
                size += len(held[-1][0])
        if held:
            yield whole()

    return _dealt(_dealt(rows, parts).mapInArrow(tidied(refine), "bucket int, blob binary"), parts)


def _split_values(columns: list[np.ndarray], bits: int, buckets: int | None = None) -> list[tuple[int, bytes]]:
    """Hashes to blobs by their first bits, or fewer (buckets). A blob of all bits holds the 32 bits that follow them: so the
    more buckets there are, the more bits tell hashes apart. One of fewer buckets holds whole hashes, to be split again."""
    buckets, values = buckets or bits, np.sort(columns[0])
    own = values if buckets < bits else (values >> np.uint64(32 - bits)).astype(np.uint32)
    return [(k, pack(own[at])) for k, at in _runs((values >> np.uint64(64 - buckets)).astype(np.int64))]


def describe(docs: DataFrame, parts: int, bits: int) -> tuple[DataFrame, np.ndarray]:
    """Written table, of which the rows with a null bucket are one for each document: doc_id, _text_hash, n_shingles, cls (null
    without shingles); and the upper 32 + bits bits of shingles that more than FREQUENT classes have, sorted."""

    coarse = min(bits, COARSE_BITS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, held, size = _Hashes(), set(), [], 0
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        names = ["doc_id", "_text_hash", "n_shingles", "cls", "bucket", "blob"]

        def flush() -> pa.RecordBatch:
            blobs = _split_values([np.concatenate(held)], bits, coarse)
            none = [None] * len(blobs)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip([none, none, none, none, [k for k, _ in blobs], [b for _, b in blobs]], types, strict=True)], names)

        for batch in batches:
            sizes, classes = [], []
            for found in shingle_sets(batch.column(2), hashes):
                sizes.append(len(found))
                classes.append(_key(found.tobytes()) if len(found) else None)
                if len(found) and classes[-1] not in seen:
                    seen.add(classes[-1])
                    held.append(found)
                    size += len(found)
                if size >= HELD_ENTRIES:
                    yield flush()
                    held, size = [], 0
            none = pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), *none], names)
        if held:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in _by_bucket(batches):
            value, times = np.unique(np.concatenate([unpack(b)[0] for b in blobs]), return_counts=True)
            many = times > FREQUENT
            upper = value[many].astype(np.int64) | (bucket << 32)
            yield pa.RecordBatch.from_arrays([pa.array(upper), pa.array(times[many].astype(np.int64))], ["value", "times"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_text_hash"), text_or_empty().alias("_text"))
    both = materialise(rows.mapInArrow(tidied(send), "doc_id long, _text_hash long, n_shingles long, cls long, bucket int, blob binary"), "described")
    sent = both.filter("bucket IS NOT NULL").select("bucket", "blob")
    found = _dealt_again(sent, parts, bits, _split_values).mapInArrow(tidied(count), "value long, times long")
    top = found.orderBy(F.desc("times"), "value").limit(FREQUENT_HELD).toArrow()
    return both, np.sort(top.column("value").to_numpy().astype(np.uint64))


def _split_entries(columns: list[np.ndarray], bits: int) -> list[tuple[int, bytes]]:
    """Prefix entries (entry, place in the prefix, group, size) and members (group, class, size) to blobs by bucket."""
    entry, pos, grp, n, m_grp, m_cls, m_n = columns
    order = np.argsort(entry, kind="stable")
    entry, pos, grp, n = entry[order], pos[order], grp[order], n[order]
    home = m_grp >> np.uint64(64 - bits)
    by_home = np.argsort(home, kind="stable")
    empty = slice(0, 0)
    here = dict(_runs((entry >> np.uint64(64 - bits)).astype(np.int64)))
    mine = dict(_runs(home[by_home].astype(np.int64)))
    out = []
    for k in sorted(here.keys() | mine.keys()):
        at, own = here.get(k, empty), by_home[mine.get(k, empty)]
        out.append((k, pack(entry[at], pos[at], grp[at], n[at], m_grp[own], m_cls[own], m_n[own])))
    return out


def prefix_lists(docs: DataFrame, frequent: np.ndarray, parts: int, bits: int) -> DataFrame:
    """Written table. kind 0: group grp has the long list at position pos of its prefix. kind 1: class cls is a
    member of group grp of size n. kind 2: groups grp and cls of fitting size share n short lists; pos is 1 if they pass the position filter in one."""
    sent, coarse = docs.sparkSession.sparkContext.broadcast(frequent), min(bits, COARSE_BITS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, often, seen, known = _Hashes(), sent.value, set(), set()
        prefixes, groups, members, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            lens = np.array([len(p) for p in prefixes], np.int64)
            entry = np.concatenate(prefixes) if prefixes else np.empty(0, np.uint64)
            pos = (np.arange(len(entry)) - np.repeat(np.cumsum(lens) - lens, lens) + 1).astype(np.uint32)
            grp, n = (np.repeat(np.array([g[k] for g in groups], d), lens) for k, d in ((0, np.int64), (1, np.uint32)))
            m_grp, m_cls, m_n = (np.array([m[k] for m in members], d) for k, d in ((0, np.int64), (1, np.int64), (2, np.uint32)))
            return _batch(_split_entries([entry, pos, grp.view(np.uint64), n, m_grp.view(np.uint64), m_cls.view(np.uint64), m_n], coarse))

        for batch in batches:
            for found in shingle_sets(batch.column(0), hashes):
                n = len(found)
                if not n or (key := _key(found.tobytes())) in seen:
                    continue
                seen.add(key)
                if len(often):
                    upper = found >> np.uint64(32 - bits)
                    place = np.searchsorted(often, upper)
                    place[place == len(often)] = 0
                    late = often[place] == upper
                    found = np.concatenate([found[~late], found[late]])
                prefix = found[: prefix_length(n)]
                group = _key(prefix.tobytes() + n.to_bytes(8, "little"))
                members.append((group, key, n))
                if group not in known:
                    known.add(group)
                    groups.append((group, n))
                    prefixes.append(prefix)
                    size += len(prefix)
                if size >= HELD_ENTRIES:
                    yield flush()
                    prefixes, groups, members, size = [], [], [], 0
        if members:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "list", "grp", "cls", "n", "pos"]
        for _, blobs in _by_bucket(batches):
            parts = [unpack(b) for b in blobs]
            entry, pos, grp, n = (np.concatenate([p[k] for p in parts]) for k in range(4))
            n = n.astype(np.int64)
            order = np.lexsort((grp, n, entry))
            entry, grp, n, pos = entry[order], grp[order], n[order], pos[order]
            new = np.ones(len(entry), bool)
            new[1:] = (entry[1:] != entry[:-1]) | (grp[1:] != grp[:-1])
            entry, grp, n, pos = entry[new], grp[new], n[new], pos[new]
            first = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]])) if len(entry) else np.empty(0, np.int64)
            held = np.diff(np.concatenate([first, [len(entry)]]))
            many = np.repeat(held > LONG, held)
            both = _short_pairs(*(x[~many] for x in (entry, grp, n, pos)))
            entry, grp, n, pos = (x[many] for x in (entry, grp, n, pos))
            m = [np.concatenate([p[k] for p in parts]) for k in (4, 5, 6)]
            one = np.unique(np.stack([m[0], m[1], m[2].astype(np.uint64)]), axis=1) if len(m[0]) else np.empty((3, 0), np.uint64)
            a, b, c = len(entry), one.shape[1], both.shape[1]
            signed = lambda *x: pa.array(np.concatenate([y.astype(np.uint64).view(np.int64) for y in x]))
            zero = [np.zeros(k, np.uint64) for k in (a, b, c)]
            kinds = [z + np.uint64(k) for k, z in enumerate(zero)]
            for at in range(0, a + b + c, 100_000):
                yield pa.RecordBatch.from_arrays([signed(*kinds), signed(entry, *zero[1:]), signed(grp, one[0], both[0]), signed(zero[0], one[1], both[1]), signed(n, one[2], both[2]), signed(pos, zero[1], both[3])], names).slice(at, 100_000)

    rows = docs.select(text_or_empty().alias("_text")).mapInArrow(tidied(send), "bucket int, blob binary")
    return materialise(_dealt_again(rows, parts, bits, _split_entries).mapInArrow(tidied(meet), "kind long, list long, grp long, cls long, n long, pos long"), "lists")


def _short_pairs(entry: np.ndarray, grp: np.ndarray, n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Pairs of groups of fitting size with the number of lists they share, and whether one passes the position filter."""
    found = []
    for ahead in range(1, LONG):
        if len(entry) <= ahead:
            break
        same = entry[ahead:] == entry[:-ahead]
        if not same.any():
            break
        a, b = np.flatnonzero(same), np.flatnonzero(same) + ahead
        low, high = n[a], n[b]  # in order of size
        need = -(-PERCENT * (low + high) // (100 + PERCENT))
        fine = 100 * low >= PERCENT * high
        early = 1 + np.minimum(low - pos[a].astype(np.int64), high - pos[b].astype(np.int64)) >= need
        x, y = grp[a[fine]], grp[b[fine]]
        found.append(np.stack([np.minimum(x, y), np.maximum(x, y), early[fine].astype(np.uint64)]))
    if not found or not sum(f.shape[1] for f in found):
        return np.empty((4, 0), np.uint64)
    pairs = np.concatenate(found, axis=1)
    pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
    new = np.flatnonzero(np.concatenate([[True], (pairs[:2, 1:] != pairs[:2, :-1]).any(axis=0)]))
    times = np.diff(np.concatenate([new, [pairs.shape[1]]])).astype(np.uint64)
    return np.stack([pairs[0, new], pairs[1, new], times, np.maximum.reduceat(pairs[2], new)])


def candidate_groups(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of classes whose groups have no other members, and lists (list, cls, n, pos, long: in how many, blocks)
    of classes: the long ones, the groups of several members, and pairs of groups one of which is such."""
    members = lists.filter("kind = 1").select("grp", "cls", "n").distinct()
    groups = members.groupBy("grp").agg(F.count("*").alias("held"), F.min("cls").alias("cls"), F.min("n").alias("n"))
    entries = lists.filter("kind = 0").select("list", "grp", "pos")
    long_of = entries.groupBy("grp").agg(F.count("*").alias("long"))
    groups = materialise(groups.join(long_of, "grp", "left").withColumn("long", F.coalesce("long", F.lit(0))), "groups")
    pairs = lists.filter("kind = 2").groupBy(F.col("grp").alias("g"), F.col("cls").alias("h")).agg(F.sum("n").alias("common"), F.max("pos").alias("early"))
    side = lambda k: groups.select(*(F.col(c).alias(f"{c}_{k}") for c in groups.columns))
    pairs = pairs.join(side("a"), F.col("g") == F.col("grp_a")).join(side("b"), F.col("h") == F.col("grp_b"))
    behind = F.greatest(*(F.ceil(F.lit(PERCENT) * F.col(f"n_{k}") / F.lit(100)) - 1 for k in "ab"))
    need = F.ceil(F.lit(PERCENT) * (F.col("n_a") + F.col("n_b")) / F.lit(100 + PERCENT))
    long = F.least("long_a", "long_b")
    pairs = materialise(pairs.filter(((F.col("early") == 1) | (long > 0)) & (F.col("common") + long + behind >= need)), "pairs")
    alone = (F.col("held_a") == 1) & (F.col("held_b") == 1)
    single = pairs.filter(alone).select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"))
    wide = pairs.filter(~alone).select(F.xxhash64("g", "h").alias("list"), F.explode(F.array("g", "h")).alias("grp"), F.lit(1).cast("long").alias("pos"))
    own = groups.filter("held > 1").select(F.col("grp").alias("list"), "grp", F.lit(1).cast("long").alias("pos"))
    # pairs that share a short list are among the pairs; the rest share long lists only, of which a set has so many
    every = entries.join(long_of, "grp").unionByName(wide.unionByName(own).withColumn("long", F.lit(1 << 40)))
    return single, in_blocks(materialise(every.join(members, "grp").select("list", "cls", "n", "pos", "long").distinct(), "classes"))


def in_blocks(lists: DataFrame) -> DataFrame:
    """lists with blocks, in how many blocks each is worked on, and block, the row's own."""
    large = materialise(lists.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).filter("blocks > 1"), "large_lists")
    large = F.broadcast(large) if large.count() <= BROADCAST_LISTS else large
    rows = lists.join(large, "list", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    return rows.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))


def may_link(x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
    """Size, position and count filter of two sets that have a list in common and share long lists only."""
    low, high = F.least(x("n"), y("n")), F.greatest(x("n"), y("n"))
    need = F.ceil(F.lit(PERCENT) * (low + high) / F.lit(100 + PERCENT))
    behind = F.ceil(F.lit(PERCENT) * high / F.lit(100)) - 1
    return (100 * low >= PERCENT * high) & (1 + F.least(x("n") - x("pos"), y("n") - y("pos")) >= need) & (F.least(x("long"), y("long")) + behind >= need)


def whole_sets(docs: DataFrame, wanted: DataFrame, parts: int) -> tuple[str, str]:
    """Name and path of a written table cls, shingles (binary, sorted 64-bit hashes), bucketed by cls so that joins on it
    move its partner only. It has the classes in wanted, and the few that a filter of bounded size mistakes for one."""
    n = wanted.count()
    bits = min(max((16 * n).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    place = F.col("cls").bitwiseAND((1 << bits) - 1)
    words = wanted.select(F.shiftrightunsigned(place, 5).alias("word"), F.expr("shiftleft(1L, CAST(cls & 31 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("held")).toArrow()
    table = np.zeros(1 << (bits - 5), np.uint32)
    table[words.column("word").to_numpy()] = words.column("held").to_numpy().astype(np.uint32)
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, known, mask = _Hashes(), set(), sent.value, (1 << bits) - 1
        for batch in batches:
            keys, found = [], []
            for own in shingle_sets(batch.column(0), hashes):
                if len(own) and (key := _key(own.tobytes())) not in seen and int(known[(key & mask) >> 5]) >> (key & 31) & 1:
                    seen.add(key)
                    keys.append(key)
                    found.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.binary())], ["cls", "shingles"])

    name = f"matchlake_sets_{uuid.uuid4().hex}"
    rows = docs.select(text_or_empty().alias("_text")).mapInArrow(tidied(sets), "cls long, shingles binary")
    path = fresh_path(docs.sparkSession, "sets")
    rows.repartition(parts, "cls").dropDuplicates(["cls"]).write.bucketBy(parts, "cls").option("path", path).saveAsTable(name)
    return name, path


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Written table of the pairs (a, b) whose sets are similar."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                place = np.searchsorted(two, one)
                place[place == len(two)] = 0
                both = int((two[place] == one).sum())
                fine.append(100 * both >= PERCENT * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fine)), batch.column(1).filter(pa.array(fine))], ["a", "b"])

    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("_x"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("_y"))
    return materialise(pairs.join(right, "b").join(left, "a").select("a", "b", "_x", "_y").mapInArrow(tidied(check), "a long, b long"), "links")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of edges (u, v): alternating stars."""
    now = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        # large star: neighbours above a node go to the smallest of its neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialise(large, "large")
        # small star: neighbours below a node, and the node itself, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        before, small = now, large.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = materialise(small, "small")
        drop_table(large)
        drop_table(before)
        # a fixed point leaves every node one edge, to its root
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen


def _merged(state: DataFrame, links: DataFrame) -> DataFrame:
    """state (cls, comp, degree) after links (a, b) between classes."""
    one = links.join(state.select(F.col("cls").alias("a"), F.col("comp").alias("u")), "a").join(state.select(F.col("cls").alias("b"), F.col("comp").alias("v")), "b").select("u", "v")
    roots = components(one)
    more = links.select(F.col("a").alias("cls")).unionByName(links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("more"))
    out = state.join(roots, F.col("comp") == F.col("node"), "left").join(more, "cls", "left")
    return materialise(out.select("cls", F.coalesce("root", "comp").alias("comp"), (F.col("degree") + F.coalesce("more", F.lit(0))).alias("degree")), "state")


def _apart(held: DataFrame, *more: Column) -> DataFrame:
    """The lists whose members are not all in one component."""
    return held.groupBy("list").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("blocks").alias("blocks"), *more).filter("low <> high")


def _every_block(lists: DataFrame) -> DataFrame:
    return lists.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")


def _with_pivots(held: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each list's pivots with its members in other components. Pivots go to all blocks of their list."""
    member = F.struct("cls", "n", "pos", "long", "comp")
    best = F.max(F.struct("degree", "long", member.alias("m"))).alias("best")
    # members with much in common with others are likely to link with many
    more = [F.max(F.struct("long", F.xxhash64("cls", F.lit(turn), F.lit(k)).alias("h"), member.alias("m"))).alias(f"p{k}") for k in range(PIVOTS)]
    pivots = _apart(held, best, *more).select("list", "blocks", F.explode(F.array("best.m", *(f"p{k}.m" for k in range(PIVOTS)))).alias("p")).distinct()
    meets = held.join(_every_block(pivots), ["list", "block"]).filter((F.col("comp") != F.col("p.comp")) & may_link(F.col, lambda c: F.col(f"p.{c}")))
    return meets.select(F.col("p.cls").alias("a"), F.col("cls").alias("b"))


def _all_apart(held: DataFrame) -> DataFrame:
    """Pairs (a, b) of each list's members in different components, by pairs of blocks."""
    rest = held.join(_every_block(_apart(held).select("list", "blocks")), ["list", "block"])
    side = lambda s: rest.select("list", F.col("block").alias(f"block_{s}"), "blocks", *(F.col(c).alias(f"{c}_{s}") for c in ("cls", "n", "pos", "long", "comp")))
    # a block meets itself and those after it
    x = side("x").withColumn("block_y", F.explode(F.sequence("block_x", F.col("blocks") - 1))).drop("blocks")
    y = side("y").withColumn("block_x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block_y")))).drop("blocks")
    fits = (F.col("comp_x") != F.col("comp_y")) & ((F.col("block_x") != F.col("block_y")) | (F.col("cls_x") < F.col("cls_y")))
    meets = x.join(y, ["list", "block_x", "block_y"]).filter(fits & may_link(lambda c: F.col(f"{c}_x"), lambda c: F.col(f"{c}_y")))
    return meets.select(F.col("cls_x").alias("a"), F.col("cls_y").alias("b"))


def linked_classes(docs: DataFrame, frequent: np.ndarray, parts: int, bits: int) -> DataFrame:
    """cls, comp for the classes that meet any other in a list."""
    spark: SparkSession = docs.sparkSession
    prefixes = prefix_lists(docs, frequent, parts, bits)
    pairs, lists = candidate_groups(prefixes)
    drop_table(prefixes)
    nodes = materialise(lists.select("cls").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("cls"))).distinct(), "nodes")
    name, path = whole_sets(docs, nodes, parts)
    sets = spark.table(name)
    try:
        state = materialise(nodes.select("cls", F.col("cls").alias("comp"), F.lit(0).cast("long").alias("degree")), "state")
        links = verified(pairs, sets)
        if not links.isEmpty():
            state = _merged(state, links)
        tested = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        turn = 0 if not lists.isEmpty() else ROUNDS + 1
        while turn <= ROUNDS:
            held = lists.join(state, "cls")
            meets = _with_pivots(held, turn) if turn < ROUNDS else _all_apart(held)
            meets = materialise(meets.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"), "meets")
            if meets.isEmpty():
                turn = turn + 1 if turn == ROUNDS else ROUNDS
                continue
            links = verified(meets, sets)
            tested = tested.unionByName(meets)
            if not links.isEmpty():
                state = _merged(state, links)
            turn += 1
    finally:
        spark.sql(f"DROP TABLE {name}")
        drop_path(spark, path)
    return state.select("cls", "comp")


def ngram_components(docs: DataFrame) -> DataFrame:
    """doc_id, _text_hash, n_shingles, component_id for each row of docs, and keeper: the component's first row key."""
    spark = docs.sparkSession
    small_batches(spark)
    # a word has six bytes or so, and a fifth of the shingles are prefix entries
    size = docs.agg(F.sum(F.octet_length(text_or_empty()))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size) // 30 // PART_ENTRIES + 1)
    bits = min(24, max(8, (2 * parts - 1).bit_length()))
    with scratch() as keep:
        table, frequent = describe(docs, parts, bits)
        described = keep(table).filter("bucket IS NULL").drop("bucket", "blob")
        classes = described.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("low"), F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("_text_hash").alias("hash"))).alias("first"), F.count("*").alias("held"))
        state = linked_classes(docs, frequent, parts, bits)
        joined = classes.join(state, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        tops = joined.groupBy("comp").agg(F.min("low").alias("component_id"), F.min("first").alias("keeper"))
        known = keep(materialise(joined.join(tops, "comp").select("cls", "held", "component_id", "keeper"), "known"))
    out = lookup_hot_safe(described, known, "cls", "held", described.count())
    return out.select("doc_id", "_text_hash", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "keeper")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, the one with the smallest id; rows without words all stay. Of rows with the
    same id and text but other values elsewhere that with the smallest hash of all its columns stays."""
    found = materialise(ngram_components(docs), "components")
    # one key for id and text, null id included: the join and the removal of repeats share its partitioning
    at = lambda own, text: F.concat_ws(":", F.coalesce(own.cast("string"), F.lit("null")), text.cast("string"))
    keys = found.filter(F.col("keeper").isNotNull()).select(at(F.col("keeper.id"), F.col("keeper.hash")).alias("_at")).distinct()
    # texts without words are told by a look at them, so that only the others are shuffled
    rows = boxed(docs, _at=at(F.col("doc_id").cast("long"), F.xxhash64("text")), _words=text_or_empty().rlike(r"[^\x20\x09-\x0D]"))
    fields = [F.col("_row").getField(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    one = rows.filter("_words").join(keys, "_at", "left_semi").groupBy("_at").agg(F.min_by("_row", F.xxhash64(*fields)).alias("_row"))
    return unboxed(one.select("_row").unionByName(rows.filter("NOT _words").select("_row")))
