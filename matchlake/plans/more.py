"""Queries of counts, remaining scalar functions, blobs, and an incremental roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.functions import scalars as s
from matchlake.operators import topk
from matchlake.plans.registry import Tables, query


@query("SELECT l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders, count(DISTINCT l_suppkey) FILTER (l_quantity > 30) AS n_big FROM lineitem GROUP BY ALL")
def a1_a4_counts(x: Tables) -> DataFrame:
    return x.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("n_orders"), F.count_distinct(F.when(F.col("l_quantity") > 30, F.col("l_suppkey"))).alias("n_big"))


@query("""WITH o AS (SELECT o_custkey, o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY ALL)
SELECT o_orderpriority, count(*) FILTER (n >= 3) AS n_accepted, count(*) FILTER (n < 3) AS n_rejected, round(avg((top < 100000)::INT), 8) AS fail_rate, count(DISTINCT CASE WHEN n >= 3 THEN o_custkey % 10 END) AS n_bands, sum(n)::BIGINT AS total FROM o GROUP BY ALL""")
def a31_a32_gate_counts(x: Tables) -> DataFrame:
    per = x.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    return per.groupBy("o_orderpriority").agg(F.count_if(F.col("n") >= 3).alias("n_accepted"), F.count_if(F.col("n") < 3).alias("n_rejected"), F.round(F.avg((F.col("top") < 100000).cast("int")), 8).alias("fail_rate"), F.count_distinct(F.when(F.col("n") >= 3, F.col("o_custkey") % 10)).alias("n_bands"), F.sum("n").alias("total"))


@query("""WITH m AS (SELECT s_suppkey, CASE s_nationkey % 5 WHEN 0 THEN 'NA1_' WHEN 1 THEN 'KR_' WHEN 2 THEN 'EUW1_' WHEN 3 THEN 'oc1_' ELSE 'XX_' END || s_suppkey AS id, s_name || CASE WHEN s_suppkey % 2 = 0 THEN '#T#' || s_nationkey ELSE '' END AS name FROM supplier)
SELECT s_suppkey, CASE lower(string_split(id, '_')[1]) WHEN 'na1' THEN 'americas' WHEN 'kr' THEN 'asia' WHEN 'euw1' THEN 'europe' WHEN 'oc1' THEN 'sea' ELSE 'americas' END AS route,
 string_split(name, '#')[1] AS game_name, contains(name, '#') AS tagged, CASE WHEN contains(name, '#') THEN substr(name, instr(name, '#') + 1) END AS tag FROM m""")
def f4_f5_ids(x: Tables) -> DataFrame:
    k = F.col("s_nationkey") % 5
    match = F.concat(F.when(k == 0, "NA1_").when(k == 1, "KR_").when(k == 2, "EUW1_").when(k == 3, "oc1_").otherwise("XX_"), F.col("s_suppkey").cast("string"))
    name = F.when(F.col("s_suppkey") % 2 == 0, F.concat_ws("#", "s_name", F.lit("T"), F.col("s_nationkey").cast("string"))).otherwise(F.col("s_name"))
    parts = F.split(name, "#", 2)
    return x.supplier.select("s_suppkey", s.route_of(match).alias("route"), parts[0].alias("game_name"), F.contains(name, F.lit("#")).alias("tagged"), F.get(parts, F.lit(1)).alias("tag"))


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity * 1000 / 60000.0, 8) AS minutes, least(greatest(l_quantity, 5), 40) AS kept, CASE WHEN l_quantity::INT BETWEEN 5 AND 40 THEN l_quantity::INT ELSE 0 END AS zeroed,
 round(ln(1 + l_quantity), 8) AS logged, round(sqrt(l_quantity) * pow(1.25, abs(l_linenumber - 4)), 8) AS penal, sign(l_discount - 0.05)::DOUBLE AS side, (l_quantity - 20) * (l_quantity - 20) + (l_linenumber - 3) * (l_linenumber - 3) <= 225 AS inside FROM lineitem""")
def f7_f16_arithmetic(x: Tables) -> DataFrame:
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return x.lineitem.select("l_orderkey", "l_linenumber", F.round(s.minutes(q * 1000), 8).alias("minutes"), s.clamp(q, 5, 40).alias("kept"), s.in_range_or_zero(q.cast("int"), 5, 40).alias("zeroed"), F.round(F.log1p(q), 8).alias("logged"), F.round(F.sqrt(q) * F.pow(F.lit(1.25), F.abs(n - 4)), 8).alias("penal"), F.signum(F.col("l_discount") - 0.05).alias("side"), ((q - 20) * (q - 20) + (n - 3) * (n - 3) <= 225).alias("inside"))


@query("""SELECT c_custkey, '[' || c_nationkey || ',' || c_custkey || ']' AS encoded, CASE WHEN c_nationkey >= 8 THEN c_nationkey - 7 ELSE 0 END AS label, c_nationkey * 10000 AS threshold,
 CASE WHEN c_nationkey > 0 THEN c_acctbal / c_nationkey ELSE 0 END AS t, list_value(c_acctbal, c_nationkey::DOUBLE)[2] AS picked FROM customer""")
def f20_f33_encodings(x: Tables) -> DataFrame:
    table = F.create_map(F.lit("bal"), F.col("c_acctbal"), F.lit("nation"), F.col("c_nationkey").cast("double"))
    picked = F.transform(F.array(F.lit("bal"), F.lit("nation")), lambda k: F.element_at(table, k))[1]
    return x.customer.select("c_custkey", F.to_json(F.array(F.col("c_nationkey").cast("bigint"), F.col("c_custkey"))).alias("encoded"), s.shifted_label(F.col("c_nationkey")).alias("label"), s.rank_threshold(F.col("c_nationkey")).alias("threshold"), s.t_stat(F.col("c_acctbal"), F.col("c_nationkey")).alias("t"), picked.alias("picked"))


@query("SELECT page_id, html AS back, encode(html) IS NOT NULL AS zipped FROM pages")
def f21_s3_gzip_round_trip(x: Tables) -> DataFrame:
    from matchlake.sources.files import gzipped, gunzipped

    rows = x.pages.select("page_id", F.col("html").alias("back"))
    return gunzipped(gzipped(rows, ["back"]), ["back"]).withColumn("zipped", F.col("back").isNotNull())


@query("""WITH h AS (SELECT o_custkey, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS ids FROM orders GROUP BY ALL) SELECT o_custkey, array_to_string(ids[1:8], ',') AS preview FROM h""")
def t16_preview(x: Tables) -> DataFrame:
    first = topk.per_group(x.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 8)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "o_orderkey"))), lambda t: t["o_orderkey"].cast("string"))
    return first.groupBy("o_custkey").agg(F.array_join(ids, ",").alias("preview"))


@query("""WITH v AS (SELECT p_partkey, p_size, p_size || '.' || (p_partkey % 4) || '.7' AS v FROM part) SELECT p_partkey, p_size FROM v WHERE string_split(v, '.')[1] || '.' || string_split(v, '.')[2] = '15.1' OR p_size BETWEEN 10 AND 12""")
def p9_p10_gates(x: Tables) -> DataFrame:
    v = F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 4).cast("string"), F.lit(".7"))
    return x.part.filter((s.major_minor(v) == "15.1") | F.col("p_size").between(10, 12)).select("p_partkey", "p_size")


@query("SELECT l_orderkey, array_to_string(list(l_linenumber % 5 ORDER BY l_linenumber) FILTER (l_returnflag <> 'R'), ',') AS items FROM lineitem GROUP BY ALL HAVING count(*) FILTER (l_returnflag <> 'R') > 0")
def f26_purchases(x: Tables) -> DataFrame:
    """The inventory fold over buys alone keeps every item in order."""
    move = F.struct(F.col("l_linenumber").alias("at"), F.lit("buy").alias("kind"), (F.col("l_linenumber") % 5).cast("int").alias("item"), F.lit(0).alias("before"), F.lit(0).alias("after"))
    moves = x.lineitem.filter("l_returnflag <> 'R'").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(move)).alias("moves"))
    return moves.select("l_orderkey", F.array_join(s.inventory(F.col("moves")), ",").alias("items"))
