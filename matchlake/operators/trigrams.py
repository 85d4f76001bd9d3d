"""Substring search by posting lists of trigrams: LIKE '%text%' that reads candidate rows only.

An index has a row a distinct trigram and key, dealt into folders by a hash of the trigram and sorted there, and the rows themselves, sorted
by key. A pattern's literal stretches give trigrams that a match must hold. Their folders alone are read, the keys that hold all of
them are candidates, and the candidates' rows are fetched and compared with the pattern itself, in which % and _ keep their
meaning. A pattern without a stretch of three characters has no trigrams; it scans the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Candidates that are looked up by a list in the scan's own filter; more are joined.
FEW = 10_000


def grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case."""
    low = F.lower(text)
    each = F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1)))
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(each, lambda k: F.substring(low, k, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def stretches(pattern: str) -> list[str]:
    """The literal parts of a LIKE pattern: what stands between % and _, and what a backslash keeps."""
    out, at = [""], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            out[-1] += pattern[at + 1]
            at += 1
        elif c in "%_":
            out.append("")
        else:
            out[-1] += c
        at += 1
    return [s for s in out if s]


def pattern_grams(pattern: str) -> list[str]:
    return sorted({s[k : k + 3] for s in (x.lower() for x in stretches(pattern)) for k in range(len(s) - 2)})


class TrigramIndex:
    """df's rows under a path, found by substrings of a column. key is one of df's columns, and unique."""

    def __init__(self, spark: SparkSession, path: str, key: str, name: str, parts: int = 64):
        self.spark, self.path, self.key, self.name, self.parts = spark, path.rstrip("/"), key, name, parts

    def _part(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.parts)).cast("int")

    def add(self, df: DataFrame) -> None:
        """Write rows and their postings beside what is there."""
        rows = df.repartitionByRange(self.key).sortWithinPartitions(self.key)
        rows.write.mode("append").parquet(f"{self.path}/rows")
        posts = df.select(F.explode(grams(F.col(self.name))).alias("gram"), F.col(self.key).alias("key")).withColumn("part", self._part(F.col("gram")))
        # a gram that most names have is many tasks' work: rebalanced partitions are split by size
        posts.hint("rebalance", "part").sortWithinPartitions("part", "gram", "key").write.mode("append").partitionBy("part").parquet(f"{self.path}/postings")

    def candidates(self, pattern: str) -> DataFrame | None:
        """Keys that hold all trigrams of the pattern; None if it has none."""
        wanted = pattern_grams(pattern)
        if not wanted:
            return None
        known = self.spark.createDataFrame([(g,) for g in wanted], "gram string").select(F.collect_set(self._part(F.col("gram")))).first()[0]
        posts = self.spark.read.parquet(f"{self.path}/postings").filter(F.col("part").isin(sorted(known)) & F.col("gram").isin(wanted))
        return posts.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select("key")

    def matching(self, pattern: str) -> DataFrame:
        """The rows whose name is like the pattern, whatever its case."""
        rows = self.spark.read.parquet(f"{self.path}/rows")
        keys = self.candidates(pattern)
        if keys is not None:
            some = [r["key"] for r in keys.limit(FEW + 1).collect()]
            rows = rows.filter(F.col(self.key).isin(some)) if len(some) <= FEW else rows.join(keys, rows[self.key] == keys["key"], "left_semi")
        return rows.filter(F.col(self.name).ilike(pattern))

    def search(self, text: str, columns: list[str], n: int = 20) -> DataFrame:
        """The first n rows whose name holds the text, by name and key."""
        return self.matching(f"%{text}%").orderBy(self.name, self.key).limit(n).select(*columns)
