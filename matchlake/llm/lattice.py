"""Language-model scores of texts by the likelihood of their subword lattices.

The model draws pieces of an existing subword vocabulary independently, until it draws the end. A word can be cut into pieces in many
ways; its probability is the sum over all of them, taken by a forward recursion in log space over the lattice of its pieces,

    log a(e) = log sum over pieces s..e of exp(log a(s) + log w(piece)),

and a text's is the product over its words and the end. Words are bytes behind the vocabulary's word mark, and every single byte is a piece,
so no text has probability zero.

Weights start from the vocabulary's own scores: a piece of score -r, the r-th merge, weighs 1 / (1 + r); single bytes and what has no
merge weigh as the last. These weigh all segmentations of the training words, whose expected counts of pieces (forward and
backward recursion) give the corpus's weights, ROUNDS times; the scores' own shares stay in as PRIOR draws. The pieces themselves never change.

Texts stay in place: chunks of documents number their distinct words, and a word leaves a chunk once, with its count. Words
are counted and scored once for the corpus; counts and scores go back to the chunks, where documents add them up. What a task holds is
a chunk (CHUNK_TOKENS words, or one longer text); what the driver holds is one number a piece.

Defined results: a null text is empty, an empty text is the end alone; a null id counts as an empty text for the split;
repeated rows count and are scored each; without training rows all counts are 0 and the weights are the vocabulary's; an empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm.shared import materialise, pack, scratch, small_batches, tidied, unpack

#: Word mark of the vocabulary, fixed value.
MARK = "▁".encode()
CHUNK_TOKENS, CHUNK_BYTES = 2_000_000, 32 << 20
ROUNDS, PRIOR = 2, 1000.0
#: Words that a worker scores at a time, by bytes; expected counts are added as whole numbers of this share, so that their order doesn't matter.
BATCH_BYTES, UNIT = 400_000, 1 << 20
LN10 = log(10)


class Pieces:
    """A vocabulary as a trie in two sorted arrays, and the first weights of its pieces. Piece 0 is the end."""

    def __init__(self, shares: dict[bytes, float], end: float):
        self.surfaces = sorted(shares)
        self.first = np.array([end, *(shares[s] for s in self.surfaces)])
        self.first /= self.first.sum()
        node, edges, piece = {b"": 0}, {}, {}
        for number, surface in enumerate(self.surfaces, 1):
            for k in range(len(surface)):
                here, there = surface[:k], surface[: k + 1]
                edges.setdefault(node[here] << 8 | surface[k], node.setdefault(there, len(node)))
            piece[node[surface]] = number
        self.edges = np.array(sorted(edges), np.int64)
        self.child = np.array([edges[e] for e in self.edges.tolist()], np.int64)
        self.piece = np.zeros(len(node), np.int32)
        self.piece[list(piece)] = list(piece.values())

    def lattice(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """word, start, end, piece of every piece that fits, by start within its word; and the lengths of the words, with their marks."""
        size = np.fromiter((len(w) + len(MARK) for w in words), np.int64, len(words))
        data = np.frombuffer(b"".join(MARK + w for w in words), np.uint8).astype(np.int64)
        of = np.repeat(np.arange(len(words), dtype=np.int32), size)
        upto = np.cumsum(size)
        at, node, reach, found = np.arange(len(data)), np.zeros(len(data), np.int64), 0, []
        while len(at):
            key = node << 8 | data[at + reach]
            j = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            on = self.edges[j] == key
            at, node, reach = at[on], self.child[j[on]], reach + 1
            whole = self.piece[node] > 0
            found.append((at[whole], np.full(whole.sum(), reach, np.int32), self.piece[node[whole]]))
            on = at + reach < upto[of[at]]
            at, node = at[on], node[on]
        at, reach, piece = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int32) for k in range(3))
        word = of[at]
        start = at - (upto - size)[word]
        order = np.argsort(start, kind="stable")
        return word[order], start[order], (start + reach)[order], piece[order], size

    def forward(self, words: list[bytes], weight: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log of each word's probability, the sum over all segmentations; and, given counts of the words, the expected counts of the pieces."""
        word, start, end, piece, size = self.lattice(words)
        base = np.concatenate([[0], np.cumsum(size + 1)])
        source, target = base[word] + start, base[word] + end
        last = base[1:] - 1
        gain = np.log(weight)[piece]
        a = np.full(base[-1], -np.inf)
        a[base[:-1]] = 0
        cuts = np.searchsorted(start, np.arange(int(size.max(initial=0)) + 1))
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            # the pieces that begin at one place of each word end at different ones
            t = target[low:high]
            a[t] = np.logaddexp(a[t], a[source[low:high]] + gain[low:high])
        if count is None:
            return a[last], None
        b = np.full(base[-1], -np.inf)
        b[last] = 0
        width = (target - source).astype(np.int64)
        for low, high in zip(cuts[-2::-1].tolist(), cuts[:0:-1].tolist(), strict=True):
            onward = gain[low:high] + b[target[low:high]]
            # several pieces begin at one place: those of one width at a time
            for w in np.unique(width[low:high]).tolist():
                of = np.flatnonzero(width[low:high] == w)
                s = source[low:high][of]
                b[s] = np.logaddexp(b[s], onward[of])
        share = np.exp(a[source] + gain + b[target] - a[last][word]) * count[word]
        return a[last], np.bincount(piece, share, minlength=len(weight))


def read_pieces(path: str) -> Pieces:
    """The pieces of a sentencepiece model with byte fallback, their scores as shares."""
    from sentencepiece import SentencePieceProcessor

    with open(path, "rb") as f:
        model = SentencePieceProcessor(model_proto=f.read())
    least = 1 / (1 + model.get_piece_size())
    shares = {bytes([k]): least for k in range(256)}
    for k in range(model.get_piece_size()):
        if model.is_control(k) or model.is_unknown(k) or model.is_unused(k) or model.is_byte(k):
            continue
        surface = model.id_to_piece(k).encode()
        shares[surface] = shares.get(surface, 0.0) + max(least, 1 / (1 - model.get_score(k)))
    return Pieces(shares, least)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


_SPACE = re.compile(rb"[ \t-\r]")


def tokens(data: bytes, step: int = 4 << 20) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased: what bytes.split() takes for white space is what the pattern of a word leaves out. A long
    text comes in parts."""
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + step)
        end = cut.start() if cut else len(data)
        yield data[at:end].lower().split()
        at = end


SPLIT = "chunk long, keys array<long>, sizes array<int>, held array<boolean>, payload binary, word binary, number int, c long"
_KINDS = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.int32(), pa.int64()]


def _rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
    names = [x.split(" ")[0] for x in SPLIT.split(", ")]
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, k)) for c, k in zip(names, _KINDS, strict=True)], names)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks: rows of documents, with the numbers of their words; and a row a distinct word, with its count in training rows."""
    from pyspark import TaskContext

    chunk, numbers, rows, n_tokens, n_bytes = TaskContext.get().partitionId() << 32, _Numbers(), [], 0, 0

    def flush() -> Iterator[pa.RecordBatch]:
        at = 0
        while at < len(rows):
            upto, n = at, 0
            while upto < len(rows) and (upto == at or n + len(rows[upto][2]) <= 500_000):
                n += len(rows[upto][2])
                upto += 1
            here = rows[at:upto]
            column = lambda k, kind: pa.array([[r[k] for r in here]], pa.list_(kind))  # noqa: B023, E731
            yield _rows(1, chunk=pa.array([chunk]), keys=column(0, pa.int64()), held=column(1, pa.bool_()), sizes=pa.array([[len(r[2]) for r in here]], pa.list_(pa.int32())), payload=pa.array([pack(np.concatenate([r[2] for r in here]))], pa.binary()))
            at = upto
        count = np.zeros(len(numbers), np.int64)
        for _, held, ids in rows:
            if not held:
                np.add.at(count, ids, 1) if len(ids) < 1000 else np.add(count, np.bincount(ids, minlength=len(count)), out=count)
        words = list(numbers)
        for at in range(0, len(words), 20_000):
            here = words[at : at + 20_000]
            yield _rows(len(here), chunk=pa.array(np.full(len(here), chunk)), word=pa.array(here, pa.binary()), number=pa.array(np.arange(at, at + len(here)), pa.int32()), c=pa.array(count[at : at + len(here)], pa.int64()))

    for batch in batches:
        for key, held, text in zip(*(batch.column(k) for k in range(3)), strict=True):
            text = text.as_py()
            parts = [np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)) for words in tokens(text)]
            rows.append((key.as_py(), held.as_py(), np.concatenate(parts) if parts else np.empty(0, np.uint32)))
            n_tokens, n_bytes = n_tokens + len(rows[-1][2]), n_bytes + len(text)
            if n_tokens >= CHUNK_TOKENS or n_bytes >= CHUNK_BYTES:
                yield from flush()
                chunk, numbers, rows, n_tokens, n_bytes = chunk + 1, _Numbers(), [], 0, 0
    if rows:
        yield from flush()


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words and counts, BATCH_BYTES at a time or one longer word."""
    words, counts, size = [], [], 0
    for batch in batches:
        for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if words and size + len(word) > BATCH_BYTES:
                yield words, np.array(counts, np.int64)
                words, counts, size = [], [], 0
            words.append(word)
            counts.append(c)
            size += len(word) + len(MARK)
    if words:
        yield words, np.array(counts, np.int64)


def learn(words: DataFrame, pieces: Pieces, n_ends: int, rounds: int = ROUNDS, prior: float = PRIOR) -> np.ndarray:
    """Weights of the pieces after some rounds of expected counts over all words (word, c) of the training rows. A round sends the driver one number a piece."""
    sent = words.sparkSession.sparkContext.broadcast(pieces)
    weight = pieces.first
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], weight: np.ndarray = weight) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(weight))
            for some, count in _some(batches):
                total += sent.value.forward(some, weight, count)[1]
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.rint(total[at] * UNIT).astype(np.int64), pa.int64())], ["piece", "n"])

        counted = words.filter("c > 0").select("word", "c").mapInArrow(tidied(expect), "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))
        counts = np.zeros(len(weight))
        for r in counted.collect():
            counts[r["piece"]] = r["n"] / UNIT
        counts[0] = n_ends
        weight = (counts + prior * pieces.first) / (counts.sum() + prior)
    return weight


SCORED = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out_rows(key: str) -> Column:
    """The rows that the model doesn't learn from: those whose checksum leaves 2 by division by 7."""
    return F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")) % 7 == 2


def score_documents(docs: DataFrame, path: str, key: str = "doc_id", held: Column | None = None, rounds: int = ROUNDS, prior: float = PRIOR) -> DataFrame:
    """key and SCORED of every row: base_score by smoothed counts of the training rows' words, score by the lattice; both are log10."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    pieces = read_pieces(path)
    held = held_out_rows(key) if held is None else held
    with scratch() as keep:
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        table = materialise(docs.select(F.col(key).cast("long"), F.coalesce(held, F.lit(False)), F.encode(text, "UTF-8")).mapInArrow(tidied(_split), SPLIT), "chunks")
        rows = table.filter(F.col("payload").isNotNull()).select(F.col("chunk").alias("at"), "keys", "sizes", "held", "payload")
        words = table.filter(F.col("word").isNotNull()).select("chunk", "number", "word", "c")
        every = materialise(words.groupBy("word").agg(F.sum("c").alias("c")), "words")
        ends = rows.agg(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
        seen = every.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
        n, v = (seen[0] or 0) + ends, seen[1] + (ends > 0)
        weight = learn(every, pieces, ends, rounds, prior)
        sent = spark.sparkContext.broadcast(pieces)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for some, count in _some(batches):
                value = sent.value.forward(some, weight)[0] / LN10
                for at in range(0, len(some), 20_000):
                    here = slice(at, at + 20_000)
                    yield pa.RecordBatch.from_arrays([pa.array(some[here], pa.binary()), pa.array(count[here], pa.int64()), pa.array(value[here], pa.float64())], ["word", "c", "p"])

        def fold(words: pa.Table, rows: pa.Table) -> pa.Table:
            number = words.column("number").to_numpy()
            c, p = np.zeros(len(number), np.int64), np.zeros(len(number))
            c[number], p[number] = words.column("c").to_numpy(), words.column("p").to_numpy()
            base = np.log10((c + 1) / (n + v + 1))
            keys, apart, sums = [], [], []
            for row in rows.select(["keys", "sizes", "held", "payload"]).to_pylist():
                (ids,) = unpack(row["payload"])
                size = np.array(row["sizes"], np.int64)
                full = np.flatnonzero(size)
                total = np.zeros((4, len(size)))
                total[0] = size
                if len(full):
                    start = (np.cumsum(size) - size)[full]
                    for k, x in enumerate((c > 0, base, p), 1):
                        total[k, full] = np.add.reduceat(x[ids].astype(float), start)
                keys += row["keys"]
                apart += row["held"]
                sums.append(total)
            total = np.concatenate(sums, axis=1) if sums else np.zeros((4, 0))
            total += np.array([1, ends > 0, np.log10((ends + 1) / (n + v + 1)), log(weight[0]) / LN10])[:, None]
            whole = [pa.array(total[k].astype(np.int64)) for k in range(2)]
            columns = [pa.array(keys, pa.int64()), pa.array(apart, pa.bool_()), *whole, pa.array(np.full(len(keys), n, np.int64)), pa.array(total[2]), pa.array(total[3])]
            return pa.table(columns, names=["key", *(x.split(" ")[0] for x in SCORED.split(", "))])

        scored = every.select("word", "c").mapInArrow(tidied(score), "word binary, c long, p double")
        back = words.drop("c").join(scored, "word").select("chunk", "number", "c", "p")
        out = back.groupBy("chunk").cogroup(rows.groupBy("at")).applyInArrow(fold, f"key long, {SCORED}")
        return keep(materialise(out.withColumn("key", F.col("key").cast(docs.schema[key].dataType)).withColumnRenamed("key", key), "scores"))
