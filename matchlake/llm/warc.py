"""WARC archives without repeated payloads, and their resolution back to whole records.

Writing: only headers (id, digest, length) are shuffled, by payload digest; the smallest id of each
digest keeps its payload as a response record, every other record becomes a revisit record that names it.
Reading: archives are parsed by Content-Length, digests are recomputed from the bytes, and revisit records are
joined to the responses that they refer to, by id and digest. A record whose bytes don't have the digest that its header
claims, or a revisit without its response, makes resolve() fail; read_archives() itself only marks them.

Archives are written by Spark's own text sink, gzip-compressed, with the record terminator as the line
separator: task commits, retries and any Hadoop file system come with it. They are read by Spark's text source with
the same separator, so a file streams through a task piece by piece, whatever its size. A file is one gzip member and
has no warcinfo record; archives of one member a record are read too. A payload is the UTF-8 text of the html column.

Defined results: null html is an empty payload; null ids, urls and dates are written as absent headers;
a record whose id is null is a response only if no id of that digest is known; rows that repeat the
smallest id of a digest are all responses; payloads under min_bytes are all responses; an empty table
writes an archive without records. Other columns of the pages are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm.shared import drop_path, drop_table, fresh_path, lookup_hot_safe, materialise, once, small_batches, tidied

END = "\r\n\r\n"
#: RFC 4648, fixed values.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD = "record_type string, record_id long, url string, digest string, refers_to long, payload binary, own_digest string, digest_ok boolean"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: eight groups of twenty bits, four letters each. The bytes are hashed
    once; within the lambda they would be hashed for each group."""
    letter = lambda g, shift: F.substring(F.lit(BASE32), F.shiftright(g, shift).bitwiseAND(31).cast("int") + 1, F.lit(1))

    def letters(digest: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.conv(F.substring(digest, k * 5 + 1, F.lit(5)), 16, 10).cast("long"))
        return F.array_join(F.transform(groups, lambda g: F.concat(*(letter(g, s) for s in (15, 10, 5, 0)))), "")

    return once(F.sha1(payload), letters)


def plan_records(pages: DataFrame, min_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """The written table of headers; and page_id, url, payload string, payload_bytes, payload_digest, refers_to (null for
    a response) of every page."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.encode("payload", "UTF-8")))
    heads = materialise(rows.select("page_id", "payload_digest", "payload_bytes"), "heads")
    total = heads.count()
    first = heads.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("held"))
    rows = lookup_hot_safe(rows, first.filter(F.col("held") > 1), "payload_digest", "held", total)
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return heads, rows.withColumn("refers_to", F.when(again, F.col("first_id"))).drop("first_id")


def record_text(date: str) -> Column:
    """One whole record without its terminator, from the columns of plan_records()."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))
    clean = F.regexp_replace("url", r"[\r\n]+", " ")  # a header ends with its line
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Target-URI", clean),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.encode(block, "UTF-8")))),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Refers-To", urn(F.col("refers_to"))),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
        block,
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> int:
    """Write deduplicated archives under path, and return the number of records. A file holds one shuffle partition."""
    heads, plan = plan_records(pages, min_bytes)
    # the join has dealt the rows out by digest already; a file is what one of its partitions holds
    records = plan.select(record_text(date).alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").text(path)
    n = heads.count()
    drop_table(heads)
    return n


def _parse(pieces: Iterator[tuple[str, bytes]]) -> Iterator[dict]:
    """Records of (file, piece) pairs: a file's pieces follow each other, and a terminator stood between two of them. Whether one
    stood at the file's end is not known, as the reader leaves out an empty last piece; so a last record may lack it."""
    for _, of_file in groupby(pieces, itemgetter(0)):
        chunks = (END.encode() * (k > 0) + piece for k, (_, piece) in enumerate(of_file))
        held, more = b"", True
        while held or more:
            while more and END.encode() not in held.lstrip(b"\r\n"):
                piece = next(chunks, None)
                more = piece is not None
                held += piece or b""
            held = held.lstrip(b"\r\n")  # what is left of a terminator
            if not held:
                continue
            if not held.startswith(b"WARC/"):
                raise ValueError("an archive record does not begin with its version line")
            head, _, held = held.partition(END.encode())
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            need = int(fields["Content-Length"])
            parts, have = [held], len(held)
            while more and have < need + len(END):
                piece = next(chunks, None)
                more = piece is not None
                parts.append(piece or b"")
                have += len(parts[-1])
            held = b"".join(parts)
            if len(held) < need:
                raise ValueError("an archive file ends within a record")
            yield {"fields": fields, "block": held[:need]}
            held = held[need:]


def _id(urn: str | None) -> int | None:
    return None if urn is None else int(urn.removeprefix("<urn:page:").removesuffix(">"))


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _row(record: dict) -> tuple:
    fields, block = record["fields"], record["block"]
    kind, claimed = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    own = None if payload is None else _sha1(payload)
    fine = _sha1(block) == fields["WARC-Block-Digest"].removeprefix("sha1:") and own in (None, claimed)
    return kind, _id(fields.get("WARC-Record-ID")), fields.get("WARC-Target-URI"), claimed, _id(fields.get("WARC-Refers-To")), payload, own, fine


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record: type, id, url, the digest that its header claims, refers_to, payload and the digest of
    its bytes (both null for a revisit), and whether the record's own digests hold."""
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.bool_()]
    names = [x.split(" ")[0] for x in RECORD.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((of.as_py(), cell.as_py()) for batch in batches for of, cell in zip(batch.column(0), batch.column(1), strict=True))
        rows, size = [], 0
        for record in _parse(pieces):
            rows.append(_row(record))
            size += len(record["block"])
            if size > (8 << 20) or len(rows) >= 1000:
                yield batch_of(rows)
                rows, size = [], 0
        if rows:
            yield batch_of(rows)

    small_batches(spark)
    lines = spark.read.option("lineSep", END).option("pathGlobFilter", "part-*").text(path)
    return lines.select("_metadata.file_path", F.col("value").cast("binary")).mapInArrow(tidied(records), RECORD)


def resolve(records: DataFrame) -> DataFrame:
    """Headers of all records, each with the length and digest of its full payload: a revisit has those of the response
    that it refers to, which must have the digest that the revisit claims. A damaged or dangling record is an error.

    The payloads themselves do not move; full_records() joins them in where they are wanted.
    """
    own = F.octet_length("payload").cast("long").alias("own_bytes")
    heads = materialise(records.select("record_type", "record_id", "url", "digest", "refers_to", "digest_ok", "own_digest", own), "records")
    at = lambda i, digest: F.concat_ws(":", F.col(i).cast("string"), F.col(digest))
    again = F.col("record_type") == "revisit"
    uses = heads.filter(again).select(at("refers_to", "digest").alias("_at")).groupBy("_at").agg(F.count("*").alias("uses"))
    # repeated rows of one id are one response each, with the same bytes
    originals = heads.filter(F.col("record_id").isNotNull() & ~again).select(at("record_id", "own_digest").alias("_at"), F.col("own_bytes").alias("_bytes"), F.col("own_digest").alias("_digest")).dropDuplicates(["_at"])
    out = lookup_hot_safe(heads.withColumn("_at", F.when(again, at("refers_to", "digest"))), originals.join(uses, "_at"), "_at", "uses", heads.count())
    whole = out.withColumn("payload_bytes", F.coalesce("own_bytes", "_bytes")).withColumn("payload_digest", F.coalesce("own_digest", "_digest"))
    error = F.raise_error(F.concat(F.lit("damaged or dangling archive record "), F.coalesce(F.col("record_id").cast("string"), F.lit("without id"))))
    checked = F.when(F.col("digest_ok") & F.col("payload_bytes").isNotNull(), F.col("payload_bytes")).otherwise(error.cast("long"))
    return whole.withColumn("payload_bytes", checked).drop("own_bytes", "own_digest", "_bytes", "_digest", "_at")


def full_records(records: DataFrame) -> DataFrame:
    """Every record with its full payload; a revisit takes that of the response which it refers to."""
    held = records.filter(F.col("record_type") == "response").select(F.col("digest").alias("_digest"), F.col("record_id").alias("_id"), F.col("payload").alias("_payload")).dropDuplicates(["_digest", "_id"])
    joined = records.join(held, (F.col("digest") == F.col("_digest")) & (F.col("refers_to") == F.col("_id")), "left")
    return joined.select(*[c for c in records.columns if c != "payload"], F.coalesce("payload", "_payload").alias("payload"))


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages as archives in the shared folder, read them back and resolve the revisits. It is an error if the archives
    give back another number of records than went in."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    written = write_archives(pages, path, min_bytes)
    out = resolve(read_archives(spark, path))  # reads the archives once, and keeps the records' headers
    read = out.count()
    if read != written:
        raise RuntimeError(f"{written} records were written, {read} read back")
    drop_path(spark, path)
    return out
