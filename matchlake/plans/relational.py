"""Queries of joins, sets, writes and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.operators import joins as j
from matchlake.operators import topk as k
from matchlake.operators import upsert as u
from matchlake.plans.registry import Tables, query


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def j1_j2_star_join(x: Tables) -> DataFrame:
    rows = x.orders.join(x.customer, F.col("o_custkey") == F.col("c_custkey")).join(x.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("o_orderkey", "c_name", "n_name")


@query("""SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def j3_fan_out_count(x: Tables) -> DataFrame:
    rows = x.customer.join(x.orders, F.col("c_custkey") == F.col("o_custkey")).join(x.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def j4_semi_join(x: Tables) -> DataFrame:
    big = x.lineitem.filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return j.present_in(x.orders, big, ["o_orderkey"]).select("o_orderkey")


@query("""SELECT c_custkey, false AS with_null FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT c_custkey, true FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END FROM orders)""")
def j7_not_in(x: Tables) -> DataFrame:
    """Customers outside a list; and outside one that holds a null, which are none."""
    some = x.orders.filter("o_orderstatus = 'P'")
    odd = x.orders.select(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("o_custkey"))
    out = lambda other, flag: j.not_in(x.customer, "c_custkey", other, "o_custkey").select("c_custkey", F.lit(flag).alias("with_null"))
    return out(some, False).unionByName(out(odd, True))


@query("SELECT user_id, event_id FROM events e WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'error' AND f.ts::DATE = e.ts::DATE)")
def j8_correlated_anti(x: Tables) -> DataFrame:
    day = F.to_date("ts")
    bad = x.events.filter("event_type = 'error'").select("user_id", day.alias("day"))
    return j.missing_from(x.events.filter("event_type = 'view'").withColumn("day", day), bad, ["user_id", "day"]).select("user_id", "event_id")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
def j9_any_one(x: Tables) -> DataFrame:
    return j.any_one(x.orders, ["o_custkey"], "o_orderkey")


@query("""WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
SELECT a.vec_id, count(*) FILTER (a.vec_id <> b.vec_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1.0) AS n_near FROM e a JOIN e b ON a.label = b.label WHERE a.vec_id % 50 = 0 GROUP BY ALL""")
def j14_within_radius(x: Tables) -> DataFrame:
    rows = x.embeddings.select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    others = rows.select("label", F.col("vec_id").alias("_id"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    points = rows.filter("vec_id % 50 = 0")  # a search takes these ids as its queries
    return j.count_within(points, others, ["label"], "x", "y", 1.0, {"n_near": F.col("vec_id") != F.col("_id")}).select("vec_id", "n_near")


@query("""WITH c AS (SELECT c_acctbal, min(c_custkey) AS id FROM customer GROUP BY ALL)
SELECT s_suppkey, arg_min(id, (abs(c_acctbal - s_acctbal), id)) AS nearest_id FROM supplier, c GROUP BY s_suppkey""")
def j18_nearest_scalar(x: Tables) -> DataFrame:
    return j.nearest_scalar(x.supplier, x.customer, "s_acctbal", "c_acctbal", "c_custkey", low=-1000.0, high=10000.0).select("s_suppkey", "nearest_id")


@query("""WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL ORDER BY n DESC, o_custkey LIMIT 100), r AS (SELECT o_custkey, row_number() OVER (ORDER BY n DESC, o_custkey) AS dense_id FROM t)
SELECT o_orderkey, coalesce(dense_id, 0)::INT AS dense_id FROM orders LEFT JOIN r USING (o_custkey)""")
def a13_j20_dense_ids(x: Tables) -> DataFrame:
    from matchlake.operators.aggregates import dense_ranks

    return j.lookup_or(x.orders, dense_ranks(x.orders, "o_custkey", 100), ["o_custkey"], "dense_id", 0).select("o_orderkey", "dense_id")


@query("SELECT vec_id, label, slot::INT AS slot, embedding[slot + 1] AS v FROM embeddings, range(0, 10) r(slot)")
def j21_positions(x: Tables) -> DataFrame:
    return j.positions(x.embeddings, "embedding", 10, "v").select("vec_id", "label", "slot", "v")


@query("SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem WHERE l_linenumber BETWEEN 1 AND 10 EXCEPT SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def o1_except(x: Tables) -> DataFrame:
    keys = lambda df: df.select("l_suppkey", "l_orderkey").distinct()
    return keys(x.lineitem.filter(F.col("l_linenumber").between(1, 10))).subtract(keys(x.lineitem.filter("l_returnflag = 'R'")))


@query("""SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE (o_custkey, o_orderpriority) NOT IN (SELECT (o_custkey, o_orderpriority) FROM orders WHERE o_orderstatus = 'F') AND (o_custkey, o_orderpriority) NOT IN (SELECT (o_custkey, o_orderpriority) FROM orders WHERE o_totalprice > 200000)""")
def o2_set_difference(x: Tables) -> DataFrame:
    keys = ["o_custkey", "o_orderpriority"]
    of = lambda where: x.orders.filter(where).select(*keys).distinct()
    return j.missing_from(j.missing_from(of("true"), of("o_orderstatus = 'F'"), keys), of("o_totalprice > 200000"), keys)


@query("SELECT user_id FROM events WHERE event_type = 'error' UNION SELECT user_id FROM events WHERE event_type = 'signup'")
def o4_union(x: Tables) -> DataFrame:
    of = lambda kind: x.events.filter(F.col("event_type") == kind).select("user_id")
    return of("error").unionByName(of("signup")).distinct()


_SPLIT = "old AS (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING'), new AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_name || '*' END AS c_name, c_nationkey, c_acctbal * 2 AS c_acctbal, CASE WHEN c_acctbal > 5000 THEN 'MOVED' END AS c_mktsegment FROM customer WHERE c_nationkey < 12)"


def _sides(x: Tables) -> tuple[DataFrame, DataFrame]:
    old = x.customer.filter("c_mktsegment <> 'BUILDING'")
    new = x.customer.filter("c_nationkey < 12").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.concat("c_name", F.lit("*"))).alias("c_name"), "c_nationkey", (F.col("c_acctbal") * 2).alias("c_acctbal"), F.when(F.col("c_acctbal") > 5000, "MOVED").alias("c_mktsegment"))
    return old, new


@query(f"WITH {_SPLIT} SELECT * FROM old UNION ALL SELECT * FROM new WHERE c_custkey NOT IN (SELECT c_custkey FROM old)")
def k1_insert_or_ignore(x: Tables) -> DataFrame:
    old, new = _sides(x)
    return u.insert_or_ignore(old, new.withColumn("_seq", F.lit(0)), ["c_custkey"], "_seq")


@query(f"""WITH {_SPLIT} SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_name ELSE o.c_name END AS c_name, coalesce(n.c_nationkey, o.c_nationkey) AS c_nationkey,
 CASE WHEN n.c_custkey IS NOT NULL THEN n.c_acctbal ELSE o.c_acctbal END AS c_acctbal, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment FROM old o FULL JOIN new n ON o.c_custkey = n.c_custkey""")
def k2_upsert(x: Tables) -> DataFrame:
    old, new = _sides(x)
    return u.upsert(old, new, ["c_custkey"], {"c_name": "take", "c_nationkey": "keep", "c_acctbal": "take", "c_mktsegment": "keep"})


@query(f"WITH {_SPLIT} SELECT * FROM new UNION ALL SELECT * FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM new)")
def k3_insert_or_replace(x: Tables) -> DataFrame:
    old, new = _sides(x)
    return u.insert_or_replace(old, new.withColumn("_seq", F.lit(0)), ["c_custkey"], "_seq")


@query(f"WITH {_SPLIT} SELECT * FROM old UNION ALL SELECT * FROM new")
def k4_append(x: Tables) -> DataFrame:
    return u.append(*_sides(x))


@query(f"WITH {_SPLIT} SELECT count(*) AS n_rows, count(*) FILTER (c_custkey NOT IN (SELECT c_custkey FROM old)) AS n_new, count(*) FILTER (c_custkey IN (SELECT c_custkey FROM old)) AS n_known FROM new")
def k6_merge_report(x: Tables) -> DataFrame:
    return u.merge_report(*_sides(x), ["c_custkey"])


@query(f"""WITH {_SPLIT} SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name, coalesce(n.c_nationkey, o.c_nationkey) AS c_nationkey,
 CASE WHEN n.c_custkey IS NULL THEN o.c_acctbal WHEN o.c_custkey IS NULL THEN n.c_acctbal ELSE greatest(n.c_acctbal, o.c_acctbal) END AS c_acctbal, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment FROM old o FULL JOIN new n ON o.c_custkey = n.c_custkey""")
def k7_merge_upsert(x: Tables) -> DataFrame:
    old, new = _sides(x)
    return u.upsert(old, new, ["c_custkey"], {"c_name": "keep", "c_nationkey": "keep", "c_acctbal": "greatest", "c_mktsegment": "keep"})


@query("SELECT user_id, count(*) AS submissions, min(epoch_us(ts)) AS created_at, max(epoch_us(ts)) AS updated_at, arg_max(event_type, (ts, event_id)) AS source FROM events GROUP BY ALL")
def k8_counter_upsert(x: Tables) -> DataFrame:
    return u.count_upsert(x.stream, "user_id", "us", "event_type", "event_id")


@query("SELECT c_name, c_mktsegment, max(epoch_us(o_orderdate)) AS newest FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL ORDER BY newest DESC, c_name, c_mktsegment LIMIT 20")
def t1_recent_distinct(x: Tables) -> DataFrame:
    rows = x.orders.join(x.customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("us", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    return k.recent_distinct(rows, ["c_name", "c_mktsegment"], "us", 20)


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders) WHERE rank <= 5")
def t2_top_per_group(x: Tables) -> DataFrame:
    return k.per_group(x.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 5)


@query("SELECT *, p_size * n AS weighted FROM (SELECT p_brand, p_size, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) ORDER BY weighted DESC, p_brand, p_size LIMIT 5")
def t3_weighted_count(x: Tables) -> DataFrame:
    rows = x.lineitem.join(x.part, F.col("l_partkey") == F.col("p_partkey"))
    return k.weighted_count(rows, ["p_brand"], "p_size", 5)


@query("SELECT * FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha1(c_custkey::VARCHAR), c_custkey)::INT AS rank FROM customer) WHERE rank <= 25")
def t7_hash_cap(x: Tables) -> DataFrame:
    return k.hash_cap(x.customer.select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey", 25)


@query("SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY ALL")
def t9_t10_best_row(x: Tables) -> DataFrame:
    return k.best_by(x.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k")))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey >= 10 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') ORDER BY c_acctbal DESC, c_custkey LIMIT 40")
def t11_priority_bump(x: Tables) -> DataFrame:
    done = x.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return k.priority_bump(x.customer, done, "c_custkey", "c_nationkey", "c_acctbal", 10, 40).select("c_custkey", "c_acctbal")


@query("""WITH RECURSIVE p AS (SELECT vec_id, row_number() OVER (ORDER BY sha1('7:' || vec_id), vec_id) - 1 AS place, count(*) OVER () - 1 AS n FROM embeddings),
d AS (SELECT vec_id AS query_id, place AS own, n, n - 16 AS j, []::BIGINT[] AS taken FROM p WHERE vec_id % 50 = 0
 UNION ALL SELECT query_id, own, n, j + 1, list_append(taken, CASE WHEN list_contains(taken, t) THEN j ELSE t END)
 FROM (SELECT *, ('0x' || right(sha1('7:' || query_id || ':' || j), 15))::BIGINT % (j + 1) AS t FROM d WHERE j < n)),
r AS (SELECT query_id, own, unnest(taken) AS at, generate_subscripts(taken, 1) AS rank FROM d WHERE j = n)
SELECT query_id, p.vec_id AS row_id, rank::INT AS rank FROM r JOIN p ON p.place = r.at + (r.at >= r.own)::INT""")
def t12_random_cohort(x: Tables) -> DataFrame:
    asks = x.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"))
    return k.random_per_query(asks, x.embeddings.withColumnRenamed("vec_id", "row_id"), "query_id", "row_id", 16, 7)


@query("""WITH b AS (SELECT DISTINCT c_nationkey % 4 AS band, c_custkey FROM customer), s AS (SELECT band, c_custkey, row_number() OVER (PARTITION BY band ORDER BY sha1(c_custkey::VARCHAR), c_custkey) AS r FROM b) SELECT c_custkey, band FROM s WHERE r <= 30""")
def t13_stratified(x: Tables) -> DataFrame:
    return k.stratified(x.customer.withColumn("band", F.col("c_nationkey") % 4), [0, 1, 2, 3], "band", "c_custkey", 30)


@query("""WITH l AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha1('3:' || doc_id), doc_id) AS rn FROM labels), m AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM labels GROUP BY quality))
SELECT doc_id, quality FROM l, m WHERE rn <= least""")
def t14_balanced(x: Tables) -> DataFrame:
    return k.balanced(x.labels, "quality", "doc_id", 3).select("doc_id", "quality")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%al%' ORDER BY p_name, p_partkey LIMIT 20")
def p4_search(x: Tables) -> DataFrame:
    from matchlake.plans.review import search

    return search(x.part, "p_name", "al", ["p_partkey", "p_name"], "p_partkey")


@query("""SELECT p_partkey AS k, p_size, p_type FROM part WHERE p_size IN (1, 2, 3, 5, 8, 13) AND p_retailprice BETWEEN 900 AND 1500 AND p_type IS NOT NULL""")
def p1_p5_predicates(x: Tables) -> DataFrame:
    rows = x.part.filter(F.col("p_size").isin(1, 2, 3, 5, 8, 13) & F.col("p_retailprice").between(900, 1500) & F.col("p_type").isNotNull())
    return rows.select(F.col("p_partkey").alias("k"), "p_size", "p_type")
