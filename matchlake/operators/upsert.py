"""Writes as snapshots: each takes the old table and the new rows and returns the next table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """First row of each key wins, the old ones before all (K1)."""
    first = new.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(seq))).filter("_rn = 1").drop("_rn", seq)
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti"))


def insert_or_replace(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Last row of each key wins (K3)."""
    both = old.withColumn("_new", F.lit(0)).withColumn(seq, F.lit(None).cast(new.schema[seq].dataType)).unionByName(new.withColumn("_new", F.lit(1)))
    over = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(seq))
    return both.withColumn("_rn", F.row_number().over(over)).filter("_rn = 1").drop("_rn", "_new", seq)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rule: dict[str, str]) -> DataFrame:
    """Full outer merge by a rule a column (K2, K5, K7). new has one row a key.

    take: the new value even if null, where there is a new row; keep: the new value unless null;
    greatest: the larger, null if either is null where both rows exist, as SQLite's scalar MAX has it.
    """
    n = new.withColumn("_has_new", F.lit(True)).alias("n")
    held = old.withColumn("_has_old", F.lit(True)).alias("o")
    joined = held.join(n, keys, "full_outer")

    def pick(name: str) -> Column:
        a, b = F.col(f"o.{name}"), F.col(f"n.{name}")
        kind = rule[name]
        if kind == "take":
            return F.when(F.col("_has_new"), b).otherwise(a)
        if kind == "keep":
            return F.coalesce(b, a)
        both = F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))
        return F.when(F.col("_has_new") & F.col("_has_old"), both).when(F.col("_has_new"), b).otherwise(a)

    return joined.select(*keys, *(pick(c).alias(c) for c in old.columns if c not in keys))


def count_upsert(rows: DataFrame, key: str, ts: str, source: str, tie: str) -> DataFrame:
    """A counter row a key: submissions, first and last time, the last source (K8)."""
    return rows.groupBy(key).agg(F.count("*").alias("submissions"), F.min(ts).alias("created_at"), F.max(ts).alias("updated_at"), F.max_by(source, F.struct(ts, tie)).alias("source"))


def count_into(old: DataFrame, rows: DataFrame, key: str, ts: str, source: str, tie: str) -> DataFrame:
    """Counter rows with more rows counted in (K8): sums of submissions, first and last time, the source of
    the last; of equal times the new row's."""
    both = old.withColumn("_new", F.lit(0)).unionByName(count_upsert(rows, key, ts, source, tie).withColumn("_new", F.lit(1)))
    out = both.groupBy(key).agg(F.sum("submissions").alias("submissions"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"), F.max_by("source", F.struct("updated_at", "_new")).alias("source"))
    return out.select(*old.columns)


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """No key: rows that come twice are there twice (K4)."""
    return old.unionByName(new)


def merge_report(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What a merge would do, without doing it (K6): rows, rows with new keys, rows with known keys."""
    marked = new.join(old.select(*keys).distinct().withColumn("_known", F.lit(1)), keys, "left")
    return marked.agg(F.count("*").alias("n_rows"), F.count_if(F.col("_known").isNull()).alias("n_new"), F.count_if(F.col("_known").isNotNull()).alias("n_known"))


def update_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with new's values in the rows that new has, unless they are null; new's other keys add no row (K5)."""
    n = new.select(key, *(F.col(c).alias(f"_new_{c}") for c in new.columns if c != key))
    cells = [F.coalesce(f"_new_{c}", c).alias(c) if c in new.columns and c != key else F.col(c) for c in old.columns]
    return old.join(n, key, "left").select(*cells)


#: How two databases merge, by table (K6): the key of ignored repeats, or the rules of an upsert. Events have no key.
MERGE_KEYS = {"games": ["match_id"], "frames": ["match_id", "participant_slot", "timestamp_ms"], "raw_matches": ["match_id"]}
PLAYER_RULE = {"riot_id": "keep", "rank_tier": "keep", "rank_division": "keep", "lp": "keep", "last_updated": "greatest"}


def merge_databases(main: dict[str, DataFrame], other: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The five tables of two databases as one (K6). Games, frames and raw documents that main has stay as they are;
    players take what is new and not null; events are appended, so merging twice doubles them, as it does in the original."""
    out = {}
    for name, table in main.items():
        if name in MERGE_KEYS:
            out[name] = insert_or_ignore(table, other[name].withColumn("_seq", F.lit(0)), MERGE_KEYS[name], "_seq")
        elif name == "players":
            out[name] = upsert(table, other[name], ["puuid"], PLAYER_RULE)
        else:
            out[name] = append(table, other[name])
    return out
