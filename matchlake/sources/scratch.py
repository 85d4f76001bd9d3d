"""Tables in the folder that driver and executors share, and their removal."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tables made within each open scratch(), the innermost last.
_open: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or the session's checkpoint folder.

    Where neither is set and the session runs in one process (tests), a temporary folder
    becomes the checkpoint folder. On a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="matchlake-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that is nobody else's; what is written there goes when the driver's JVM ends."""
    root = f"{shared_dir(spark).rstrip('/')}/matchlake-{uuid.uuid4().hex}"
    fs, where = _file_system(spark, root)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return f"{root}/{tag}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete what fresh_path() gave a place to."""
    fs, where = _file_system(spark, path.rsplit("/", 1)[0])
    fs.delete(where, True)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, outlives executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.__dict__["_scratch_path"] = path
    if _open:
        _open[-1].append(table)
    return table


def drop_table(table: DataFrame) -> None:
    """Delete the files of a table that materialise() made; any other DataFrame is left alone."""
    path = table.__dict__.get("_scratch_path")
    if path:
        drop_path(table.sparkSession, path)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that materialise() makes within are deleted at the end, but for those given to the function that this yields."""
    kept: list[DataFrame] = []
    _open.append([])

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    try:
        yield keep
    finally:
        made = _open.pop()
        for table in made:
            if not any(table is k for k in kept):
                drop_table(table)
        if _open:  # what outlives this scope belongs to the one around it
            _open[-1].extend(t for t in made if any(t is k for k in kept))
