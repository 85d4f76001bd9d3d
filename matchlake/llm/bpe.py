"""Byte-level BPE over a global table of distinct words.

1. Texts are split into pre-tokens. A chunk of texts keeps its distinct words, and for each position of each
   text the number of the word there, so a word leaves its chunk once however often the chunk has it.
2. The chunks' words are shuffled by word, packed by buckets of their hashes; each distinct word of the corpus
   is encoded once, in the one place where all chunks that have it meet.
3. The ids go back to the chunks, and every text is reassembled by position.
Decoding joins ids to the table of token bytes, which is as long as the vocabulary and no longer.

Vocabulary and pattern are parameters; special tokens are ordinary text.

Defined results: null and empty text has no ids and decodes to no bytes; null keys stay; repeated rows give
repeated results; an empty table gives an empty result. Columns other than key and text are not read.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm.shared import fresh_path, pack, small_batches, text_or_empty, tidied, unpack, widened

#: Characters of text after which a chunk ends.
CHUNK_CHARS = 8 << 20
#: bucket -1: a chunk's texts: keys, words in each, and word numbers by position. Other buckets: its words of one bucket.
CHUNKS = "chunk long, bucket int, keys array<long>, n_words array<int>, payload binary"


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A rank file's tokens, read on the driver: its size is the vocabulary's."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def split_chunks(docs: DataFrame, pattern: str, key: str = "doc_id", buckets: int = 64) -> DataFrame:
    """The chunks of step 1, as in CHUNKS."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import regex
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        keys: list[int | None] = []
        sizes: list[int] = []
        places: list[np.ndarray] = []
        numbers: dict[str, int] = {}
        # the partition's number makes chunks of equal texts differ; a retried task makes the same ones
        name, chars = hashlib.blake2b(b"%d" % TaskContext.get().partitionId(), digest_size=8), 0

        def chunk() -> pa.RecordBatch:
            words = [w.encode() for w in numbers]
            size = np.fromiter(map(len, words), np.uint32, len(words))
            home = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            order = np.argsort(home, kind="stable")
            cuts = np.searchsorted(home[order], np.arange(buckets + 1))
            here, payloads = [-1], [pack(np.concatenate(places).astype("<u4"))]
            for b in np.flatnonzero(np.diff(cuts)):
                mine = order[cuts[b] : cuts[b + 1]]
                here.append(int(b))
                payloads.append(pack(np.diff(mine, prepend=0).astype("<u4"), size[mine], np.frombuffer(b"".join(words[k] for k in mine), "u1")))
            n = len(here)
            row = [[int.from_bytes(name.digest(), "little", signed=True)] * n, here, [keys, *[None] * (n - 1)], [sizes, *[None] * (n - 1)], payloads]
            types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["chunk", "bucket", "keys", "n_words", "payload"])

        for batch in batches:
            for at, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = cell.as_py()
                found = find(text)
                places.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.uint32, len(found)))
                keys.append(at)
                sizes.append(len(found))
                name.update(f"{at} {len(text)} {zlib.crc32(text.encode())};".encode())
                chars += len(text)
                if chars >= CHUNK_CHARS:
                    yield chunk()
                    keys, sizes, places, numbers, chars = [], [], [], {}, 0
        if keys:
            yield chunk()

    return docs.select(F.col(key).cast("long"), text_or_empty()).mapInArrow(tidied(split), CHUNKS)


@cache
def _encoding(name: str, pattern: str, ranks: tuple) -> object:
    import tiktoken

    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=dict(ranks), special_tokens={})


def encode_words(words: DataFrame, ranks: dict[bytes, int], pattern: str, parts: int) -> DataFrame:
    """chunk, payload: steps between the numbers of a chunk's words, ids of each, and the ids. words: bucket, chunk, payload."""
    sent = words.sparkSession.sparkContext.broadcast(tuple(ranks.items()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _encoding("byte_bpe", pattern, sent.value)._encode_single_piece
        now, known = None, {}
        for batch in batches:
            for bucket, chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if bucket != now:
                    now, known = bucket, {}
                number, size, raw = unpack(blob.as_py())
                data, ends = raw.tobytes(), np.cumsum(size.astype(np.int64)).tolist()
                ids = []
                for a, b in zip([0, *ends[:-1]], ends, strict=True):
                    word = data[a:b]
                    if (found := known.get(word)) is None:
                        known[word] = found = one(word)
                    ids.append(found)
                flat = np.fromiter((x for f in ids for x in f), np.uint32)
                out = pack(number, np.fromiter(map(len, ids), np.uint32, len(ids)), flat)
                yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()], pa.int64()), pa.array([out], pa.binary())], ["chunk", "payload"])

    return words.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidied(encode), "chunk long, payload binary")


def token_bytes(ranks: dict[bytes, int]) -> list[bytes | None]:
    """Bytes of each token id."""
    table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, at in ranks.items():
        table[at] = token
    return table


def decoded(lists: pa.ListArray, table: list[bytes | None]) -> pa.Array:
    """The bytes that each list of ids stands for; null for null."""
    token = table.__getitem__
    return pa.array([None if (ids := x.values) is None else b"".join(map(token, ids.to_numpy())) for x in lists], pa.binary())


def encode_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", decode: bool = False) -> DataFrame:
    """key, ids array<int> of every row's whole text; with decode also decoded binary, the bytes of the ids.

    Decoding in the same pass keeps the ids in one worker. The places of the words are in a table of the shared folder,
    in the catalog as matchlake_chunks_<id>, which the result reads; its files go when the driver ends.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ranks = read_ranks(spark, path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # bucketed by chunk, so that the ids come to the texts' places and these stay where they are
    name = f"matchlake_chunks_{uuid.uuid4().hex}"
    split_chunks(docs, pattern, key, max(64, 4 * parts)).write.bucketBy(parts, "chunk").option("path", fresh_path(spark, "chunks")).saveAsTable(name)
    chunks = spark.table(name)
    encoded = encode_words(chunks.filter("bucket >= 0").select("bucket", "chunk", "payload"), ranks, pattern, parts)
    tables = encoded.groupBy("chunk").agg(F.collect_list("payload").alias("tables"))
    rows = chunks.filter("bucket < 0").select("chunk", "keys", "n_words", "payload").join(tables, "chunk", "left").select("keys", "n_words", "payload", "tables")

    sent = spark.sparkContext.broadcast(token_bytes(ranks) if decode else [])

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                every, sizes, packed, blobs = (batch.column(k)[i] for k in range(4))
                every = every.values
                tables = [unpack(b) for b in blobs.as_py() or ()]
                tables = [(np.cumsum(t[0], dtype=np.int64), t[1], t[2]) for t in tables]
                number, size, flat = (np.concatenate([t[k] for t in tables]) if tables else np.empty(0, np.uint32) for k in range(3))
                order = np.argsort(number)
                length = size.astype(np.int64)
                start = (np.cumsum(length) - length)[order]
                length = length[order]
                (places,) = unpack(packed.as_py())
                ends = np.cumsum(sizes.values.to_numpy(), dtype=np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                at = 0
                while at < len(ends):  # rows of some hundred thousand words at a time
                    upto = max(at + 1, int(np.searchsorted(ends, begins[at] + 200_000, "right")))
                    here = places[begins[at] : ends[upto - 1]]
                    n = length[here]
                    heads = np.cumsum(n) - n
                    ids = flat[np.repeat(start[here] - heads, n) + np.arange(n.sum())] if len(here) else flat[:0]
                    cuts = np.concatenate([[0], np.cumsum(n)])[np.concatenate([begins[at : at + 1], ends[at:upto]]) - begins[at]]
                    lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32)))
                    out = [every.slice(at, upto - at), lists, *([decoded(lists, sent.value)] if decode else [])]
                    yield pa.RecordBatch.from_arrays(out, ["key", "ids", "decoded"][: len(out)])
                    at = upto

    return rows.mapInArrow(tidied(reassemble), "key long, ids array<int>" + ", decoded binary" * decode).withColumnRenamed("key", key)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with decoded binary, the bytes of its ids."""
    spark = encoded.sparkSession
    sent = spark.sparkContext.broadcast(token_bytes(read_ranks(spark, path)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            whole = decoded(batch.column(batch.schema.get_field_index("ids")), sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, whole], schema=batch.schema.append(pa.field("decoded", pa.binary())))

    return encoded.mapInArrow(tidied(decode), widened(encoded, "decoded binary"))
