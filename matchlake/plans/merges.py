"""Merges into keyed tables: only the partitions that a batch touches are read and written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.operators import upsert as u
from matchlake.plans.registry import Tables, query
from matchlake.sources.keyed import KeyedTable, merge_sink
from matchlake.sources.scratch import fresh_path


def _customers(x: Tables) -> tuple[DataFrame, DataFrame]:
    """Three of four customers, and a batch of a third of all with changed values, some of them null."""
    rows = x.customer.select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    new = rows.filter("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).alias("c_name"), (F.col("c_acctbal") - 100 * (F.col("c_custkey") % 5)).alias("c_acctbal"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_nationkey")).alias("c_nationkey"))
    return rows.filter("c_custkey % 4 > 0"), new


_O = "o AS (SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM customer WHERE c_custkey % 4 > 0)"
_N = "n AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) END AS c_name, c_acctbal - 100 * (c_custkey % 5) AS c_acctbal, CASE WHEN c_custkey % 7 > 0 THEN c_nationkey END AS c_nationkey FROM customer WHERE c_custkey % 3 = 0)"


@query(f"""WITH {_O}, {_N} SELECT c_custkey, coalesce(n.c_name, o.c_name) AS c_name,
 CASE WHEN o.c_custkey IS NULL THEN n.c_acctbal WHEN n.c_custkey IS NULL THEN o.c_acctbal WHEN n.c_acctbal > o.c_acctbal THEN n.c_acctbal ELSE o.c_acctbal END AS c_acctbal,
 CASE WHEN n.c_custkey IS NULL THEN o.c_nationkey ELSE n.c_nationkey END AS c_nationkey FROM o FULL JOIN n USING (c_custkey)""")
def k2_k7_partition_merge(x: Tables) -> DataFrame:
    """An upsert by a rule a column into a table of 16 partitions."""
    old, new = _customers(x)
    table = KeyedTable.create(old, fresh_path(x.spark, "customers"), ["c_custkey"], 16)
    table.merge(new, lambda a, b: u.upsert(a, b, ["c_custkey"], {"c_name": "keep", "c_acctbal": "greatest", "c_nationkey": "take"}))
    return table.read()


@query(f"WITH {_O}, {_N} SELECT * FROM o UNION ALL SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM o)")
def k1_partition_merge(x: Tables) -> DataFrame:
    """Only new keys enter; the batch comes twice."""
    old, new = _customers(x)
    table = KeyedTable.create(old, fresh_path(x.spark, "customers"), ["c_custkey"], 16)
    for _ in range(2):
        table.merge(new, lambda a, b: u.insert_or_ignore(a, b.withColumn("seq", F.lit(0)), ["c_custkey"], "seq"))
    return table.read()


@query("SELECT user_id, count(*) AS submissions, min(epoch_us(ts)) AS created_at, max(epoch_us(ts)) AS updated_at, arg_max(event_type, (epoch_us(ts), event_id)) AS source FROM events GROUP BY user_id")
def k8_r3_stream_merge(x: Tables) -> DataFrame:
    """Counters of a stream's users; each batch is handed to the sink twice, as after a crash."""
    from matchlake.streaming.workers import drain

    root = fresh_path(x.spark, "counters")
    none = x.spark.createDataFrame([], "user_id long, submissions long, created_at long, updated_at long, source string")
    table = KeyedTable.create(none, f"{root}/table", ["user_id"], 16)
    sink = merge_sink(table, lambda old, rows: u.count_into(old, rows, "user_id", "us", "event_type", "event_id"))

    def twice(df: DataFrame, n: int) -> None:
        sink(df, n)
        sink(df, n)

    kinds = x.events.schema
    source = x.spark.readStream.schema(kinds).option("pathGlobFilter", "*.parquet").parquet(f"{x.sf_dir}/events.parquet*")
    drain(source.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))), twice, f"{root}/state")
    return table.read()
