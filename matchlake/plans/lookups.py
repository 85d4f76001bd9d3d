"""Queries of substring search by trigrams and of membership by bitmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.operators import bitmaps
from matchlake.operators.trigrams import TrigramIndex
from matchlake.plans.registry import Tables, query
from matchlake.sources.scratch import fresh_path


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%MER#0_0000%1_%' ORDER BY c_name, c_custkey LIMIT 20")
def p4_c34_search_index(x: Tables) -> DataFrame:
    """The first twenty customers whose name holds a pattern, by an index of trigrams."""
    index = TrigramIndex(x.spark, fresh_path(x.spark, "names"), "c_custkey", "c_name")
    index.add(x.customer.select("c_custkey", "c_name"))
    return index.search("MER#0_0000%1_", ["c_custkey", "c_name"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def s20_o3_bitmap_anti(x: Tables) -> DataFrame:
    """Orders without a large line: a work list less what is done."""
    done = x.lineitem.filter("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"))
    return bitmaps.missing_from(x.orders.select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000)")
def j4_bitmap_semi(x: Tables) -> DataFrame:
    """Lines of dear orders; most lines go before the join."""
    dear = x.orders.filter("o_totalprice > 300000").select(F.col("o_orderkey").alias("l_orderkey"))
    return bitmaps.present_in(x.lineitem.select("l_orderkey", "l_linenumber"), dear, ["l_orderkey"])


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id FROM events WHERE event_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1) UNION ALL SELECT user_id, event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 3 = 0) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def k1_bitmap_insert(x: Tables) -> DataFrame:
    """Users with their first event of one part of the stream, then those of the whole whom that part lacks."""
    first = lambda df: df.groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    rows = x.events.select("user_id", "event_id")
    return bitmaps.insert_or_ignore(first(rows.filter("event_id % 3 = 0")), rows.withColumn("seq", F.col("event_id")), ["user_id"], "seq")
