"""Blobs, line lists, cached JSON, content-addressed tables, atomic artifacts."""

from __future__ import annotations

import gzip
import hashlib
import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def gunzipped(df: DataFrame, blobs: list[str]) -> DataFrame:
    """df with gzip blobs as text; a blob that is null or no gzip is null (S3, F21). Other columns pass through."""

    def one(blob: bytes | None) -> str | None:
        try:
            return None if blob is None else gzip.decompress(blob).decode()
        except (OSError, EOFError, UnicodeDecodeError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(one, c.to_pylist()), pa.string()) if n in blobs else c for n, c in zip(b.schema.names, b.columns, strict=True)], b.schema.names)

    return df.mapInArrow(run, ", ".join(f"`{n}` {'string' if n in blobs else t}" for n, t in df.dtypes))


def gzipped(df: DataFrame, texts: list[str]) -> DataFrame:
    """df with texts as gzip blobs whose bytes depend on the text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([None if t is None else gzip.compress(t.encode(), mtime=0) for t in c.to_pylist()], pa.binary()) if n in texts else c for n, c in zip(b.schema.names, b.columns, strict=True)], b.schema.names)

    return df.mapInArrow(run, ", ".join(f"`{n}` {'binary' if n in texts else t}" for n, t in df.dtypes))


def lines(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """Trimmed lines that are not blank."""
    return spark.read.text(path).select(F.trim("value").alias(name)).filter(F.col(name) != "")


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """Sorted lines."""
    df.select(F.col(column).cast("string").alias("value")).orderBy("value").write.mode("overwrite").text(path)


def links(html: Column, until: str | None = None) -> Column:
    """Targets of anchors, up to a marker where there is one."""
    text = html if until is None else F.substring_index(html, until, 1)
    return F.regexp_extract_all(text, F.lit('<a[^>]*href="([^"]*)"'), F.lit(1))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, where, _ = _fs(spark, path)
    return fs.exists(where)


def write_artifact(spark: SparkSession, path: str, value: object) -> None:
    """A JSON file that readers see whole or not at all: written beside its place, then renamed."""
    fs, where, jvm = _fs(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(value, sort_keys=True, indent=1).encode()))
    out.close()
    if fs.exists(where):
        fs.delete(where, False)
    fs.rename(beside, where)


def read_artifact(spark: SparkSession, path: str) -> object:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def cached_json(spark: SparkSession, path: str, fetch: Callable[[], object], ttl_s: float = 7 * 86400, now: float | None = None) -> object:
    """The file's value while it is younger than the limit; else a fetched one, which is stored."""
    fs, where, _ = _fs(spark, path)
    now = time.time() if now is None else now
    if fs.exists(where) and now - fs.getFileStatus(where).getModificationTime() / 1000 < ttl_s:
        return read_artifact(spark, path)
    value = fetch()
    write_artifact(spark, path, value)
    return value


def stable_key(*parts: object) -> str:
    """First 16 hex digits of SHA-256 over the parts with a NUL after each."""
    return hashlib.sha256(b"".join(str(p).encode() + b"\x00" for p in parts)).hexdigest()[:16]


class SampleStore:
    """Parquet results under a key of what they depend on.

    off: always compute. readonly: use what is there, store nothing. readwrite: store what is missing.
    refresh: compute and overwrite.
    """

    MODES = ("off", "readonly", "readwrite", "refresh")

    def __init__(self, spark: SparkSession, root: str, mode: str = "readwrite"):
        if mode not in self.MODES:
            raise ValueError(f"mode is one of {self.MODES}")
        self.spark, self.root, self.mode = spark, root.rstrip("/"), mode

    def path(self, *depends_on: object) -> str:
        return f"{self.root}/{stable_key(*depends_on)}"

    def get(self, compute: Callable[[], DataFrame], *depends_on: object) -> DataFrame:
        path = self.path(*depends_on)
        if self.mode in ("readonly", "readwrite") and exists(self.spark, f"{path}/_SUCCESS"):
            return self.spark.read.parquet(path)
        df = compute()
        if self.mode in ("readwrite", "refresh"):
            df.write.mode("overwrite").parquet(path)
            return self.spark.read.parquet(path)
        return df

    def drop(self, *depends_on: object) -> None:
        fs, where, _ = _fs(self.spark, self.path(*depends_on))
        fs.delete(where, True)


def save_index(df: DataFrame, stats: DataFrame, path: str, manifest: dict) -> None:
    """Vectors, whitening statistics and a manifest; the manifest comes last."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    stats.write.mode("overwrite").parquet(f"{path}/whitening")
    write_artifact(df.sparkSession, f"{path}/manifest.json", manifest)


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """What save_index() wrote."""
    return spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/whitening"), read_artifact(spark, f"{path}/manifest.json")


def markdown(rows: list[dict], columns: list[str], digits: int = 3) -> str:
    """A Markdown table of a small aggregate."""
    show = lambda x: "-" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    body = [" | ".join(show(r[c]) for c in columns) for r in rows]
    return "\n".join(f"| {x} |" for x in [" | ".join(columns), " | ".join("---" for _ in columns), *body])
