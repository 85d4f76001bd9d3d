"""Tables with a key, dealt into partitions by a hash of it, and merges that touch only the partitions a batch touches (K1 to K8).

A merge finds the partitions of the batch's keys, reads these alone (the scan is pruned) and overwrites these alone (Spark's dynamic
partition overwrite: new files are staged, and take the old ones' places when the job commits). All others keep their files. A key
is always in the same partition, so a merge is a join of few partitions, however large the table.

Tasks and executors may be lost at any time: their files are staged. The commit itself removes a partition's old files and then moves the new
ones in; a driver that dies between the two leaves that partition in the staging folder (.spark-staging-*) of the table, from which it must be moved.

The number of partitions is part of the folder's layout (_of=64/_part=7), so a table knows its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from matchlake.sources.scratch import drop_table, materialise

#: What a merge gives from the old and the new rows of the partitions it touches.
Merge = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], parts: int = 64):
        self.spark, self.path, self.keys, self.parts = spark, path.rstrip("/"), keys, parts
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    @classmethod
    def create(cls, df: DataFrame, path: str, keys: list[str], parts: int = 64) -> KeyedTable:
        """Write df, which has one row a key, as a new table."""
        table = cls(df.sparkSession, path, df.schema, keys, parts)
        table._write(df, "errorifexists", -1)
        return table

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def _write(self, df: DataFrame, mode: str, batch: int) -> None:
        rows = df.select(*self.schema.names, F.lit(batch).cast("long").alias("_batch"), F.lit(self.parts).alias("_of"), self._part().alias("_part"))
        # rebalanced: a large partition is written by several tasks, small ones share one
        rows = rows.hint("rebalance", "_part")
        rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("_of", "_part").parquet(self.path)

    def _read(self, parts: list[int] | None) -> DataFrame:
        kinds = StructType([*self.schema.fields, StructField("_batch", LongType()), StructField("_of", IntegerType()), StructField("_part", IntegerType())])
        df = self.spark.read.schema(kinds).parquet(self.path)
        return df if parts is None else df.filter(F.col("_part").isin(parts))

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """All rows, or those of some partitions, whose files alone are listed for the scan."""
        return self._read(parts).select(*self.schema.names)

    def touched(self, new: DataFrame) -> list[int]:
        """The partitions of new's keys: at most as many numbers as there are partitions."""
        return sorted(r["_part"] for r in new.select(self._part().alias("_part")).distinct().collect())

    def merge(self, new: DataFrame, how: Merge, batch: int | None = None) -> list[int]:
        """Merge rows in: how(old, new) over the touched partitions replaces them. The partitions that were written.

        The rows are written down first, so that what changes while it is read is one batch. With a batch number each partition keeps the
        number of the last batch that it took: a batch that comes again, after a crash even between two partitions, leaves those that have it
        as they are. Numbers must grow, and a table that takes numbered batches takes no others; without a number a repeated merge
        does what `how` does.
        """
        held = materialise(new, "batch")
        parts = self.touched(held)
        if parts and batch is not None:
            last = self._read(parts).groupBy("_part").agg(F.max("_batch").alias("_last"))
            have = {r["_part"] for r in last.filter(F.col("_last") >= batch).collect()}
            parts = [p for p in parts if p not in have]
        if parts:
            rows = held.filter(self._part().isin(parts))
            self._write(how(self.read(parts), rows), "overwrite", -1 if batch is None else batch)
        drop_table(held)
        return parts


def merge_sink(table: KeyedTable, how: Merge) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that takes each batch of one stream into a table exactly once."""

    def take(df: DataFrame, batch: int) -> None:
        table.merge(df, how, batch)

    return take
