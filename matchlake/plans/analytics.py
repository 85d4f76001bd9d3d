"""Queries of aggregates, vectors, cohorts, splits, scalar functions, sources and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.functions import scalars as s
from matchlake.operators import aggregates as a
from matchlake.operators import causal, cohort, knn, splits
from matchlake.plans.registry import Tables, query
from matchlake.sources.scratch import materialise

_IN95 = "l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'"


@query(f"""SELECT l_suppkey, l_orderkey, min(l_returnflag) AS flag, count(*) FILTER ({_IN95}) AS n_in, round(sum(CASE WHEN {_IN95} THEN l_quantity ELSE 0 END), 2) AS quantity, round(sum(CASE WHEN {_IN95} THEN l_extendedprice / greatest(l_quantity, 1) ELSE 0 END), 7) AS unit FROM lineitem GROUP BY ALL""")
def a5_conditional_rollup(x: Tables) -> DataFrame:
    inside = F.col("l_shipdate").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz"))
    total = lambda c: F.sum(F.when(inside, c).otherwise(0.0))
    return x.lineitem.groupBy("l_suppkey", "l_orderkey").agg(F.min("l_returnflag").alias("flag"), F.count_if(inside).alias("n_in"), F.round(total(F.col("l_quantity")), 2).alias("quantity"), F.round(total(F.col("l_extendedprice") / F.greatest(F.col("l_quantity"), F.lit(1))), 7).alias("unit"))


@query("""SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS n_back, round(count(*) FILTER (l_returnflag = 'R') / count(*), 8) AS rate, CASE WHEN sum(l_discount) > 0 THEN round(sum(l_tax) / sum(l_discount), 6) ELSE 0 END AS ratio FROM lineitem GROUP BY ALL""")
def a6_guarded_ratios(x: Tables) -> DataFrame:
    back = F.count_if(F.col("l_returnflag") == "R")
    ratio = F.when(F.sum("l_discount") > 0, F.round(F.sum("l_tax") / F.sum("l_discount"), 6)).otherwise(0.0)
    return x.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), back.alias("n_back"), F.round(back / F.count("*"), 8).alias("rate"), ratio.alias("ratio"))


@query("SELECT l_suppkey, l_returnflag, n, round(n / sum(n) OVER (PARTITION BY l_suppkey), 8) AS share FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)")
def a7_shares(x: Tables) -> DataFrame:
    return a.share_of(x.lineitem, ["l_suppkey"], "l_returnflag").withColumn("share", F.round("share", 8))


@query("""WITH c AS (SELECT o_custkey, min(o_orderdate) AS cutoff FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL)
SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN c USING (o_custkey) WHERE cutoff IS NULL OR o_orderdate < cutoff GROUP BY ALL""")
def a8_causal_cutoff(x: Tables) -> DataFrame:
    from matchlake.operators.players import before_cutoff, causal_cutoff

    stats = x.orders.select(F.col("o_custkey").alias("puuid"), F.col("o_orderkey").alias("match_id"), F.col("o_orderdate").alias("created_at"), "o_totalprice")
    urgent = x.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("match_id"))
    rows = before_cutoff(stats, causal_cutoff(stats, urgent))
    return rows.groupBy(F.col("puuid").alias("o_custkey")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH e AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
SELECT label, round(sum(x), 6) AS sum_x, round(avg(y), 8) AS avg_y, round(sqrt(var_pop(x) + var_pop(y)), 8) AS spread FROM e GROUP BY ALL""")
def a10_team_state(x: Tables) -> DataFrame:
    rows = x.embeddings.select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return a.team_state(rows, ["label"], ["x"], ["y"], "x", "y").select("label", F.round("sum_x", 6).alias("sum_x"), F.round("avg_y", 8).alias("avg_y"), F.round("spread", 8).alias("spread"))


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY c_nationkey) AS total, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS r FROM c)
SELECT c_nationkey, CASE WHEN total >= 40 THEN c_mktsegment END AS mode, CASE WHEN total >= 40 THEN n END AS n FROM t WHERE r = 1""")
def a14_mode(x: Tables) -> DataFrame:
    return a.mode_of(x.customer, ["c_nationkey"], "c_mktsegment", 40)


@query("""SELECT dim::INT AS dim, round(avg(embedding[dim + 1]::DOUBLE), 8) AS mean, round(greatest(stddev_pop(embedding[dim + 1]::DOUBLE), 1e-6), 8) AS sd FROM embeddings, range(0, 64) r(dim) GROUP BY ALL""")
def a15_whitening(x: Tables) -> DataFrame:
    return a.whitening(x.embeddings, "embedding").select("dim", F.round("mean", 8).alias("mean"), F.round("sd", 8).alias("sd"))


@query("""WITH w AS (SELECT dim, avg(embedding[dim + 1]::DOUBLE) AS m, greatest(stddev_pop(embedding[dim + 1]::DOUBLE), 1e-6) AS sd FROM embeddings, range(0, 64) r(dim) GROUP BY ALL)
SELECT vec_id, round(sum(abs((embedding[dim + 1]::DOUBLE - m) / sd)), 5) AS size FROM embeddings, w GROUP BY ALL""")
def f14_c19_whitened_vectors(x: Tables) -> DataFrame:
    rows = knn.whiten_vectors(x.embeddings, "embedding", a.whitening(x.embeddings, "embedding"))
    return rows.select("vec_id", F.round(F.aggregate("key", F.lit(0.0), lambda t, v: t + F.abs(v)), 5).alias("size"))


_PAIRS = """SELECT q.vec_id AS query_id, c.vec_id AS row_id, q.label AS ql, c.label AS cl, sqrt(list_sum(list_transform(range(1, 65), lambda i: (q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE)))) AS d
 FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id"""
_TOP = f"p AS ({_PAIRS}), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, row_id) AS rank FROM p)"


def _neighbours(x: Tables, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    corpus = x.embeddings.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("key"), "label", F.col("vec_id").alias("own"))
    asks = corpus.filter("row_id % 50 = 0").withColumnRenamed("row_id", "query_id")  # a search takes these ids as its queries
    return knn.nearest(asks, corpus, k, exclude=("own", "own")), asks, corpus


@query(f"WITH {_TOP} SELECT query_id, row_id, rank::INT AS rank, round(d, 6) AS distance FROM t WHERE rank <= 16")
def t4_nearest(x: Tables) -> DataFrame:
    return _neighbours(x, 16)[0].withColumn("distance", F.round("distance", 6))


@query(f"WITH {_TOP} SELECT query_id, row_id, rank::INT AS rank, round(d, 6) AS distance FROM t WHERE rank <= 16")
def t4_s16_pruned_nearest(x: Tables) -> DataFrame:
    """The same search over blocks that a pivot table rules out where it can."""
    from matchlake.operators.pruned import nearest

    corpus = x.embeddings.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("key"), F.col("vec_id").alias("own"))
    asks = corpus.filter("row_id % 50 = 0").withColumnRenamed("row_id", "query_id")
    return nearest(asks, corpus, 16, exclude=("own", "own")).withColumn("distance", F.round("distance", 6))


@query(f"""WITH {_TOP}, r AS (SELECT query_id, k, count(*) AS size, avg((cl < 5)::INT) AS p FROM t, (VALUES (16), (32), (64)) v(k) WHERE rank <= k GROUP BY ALL)
SELECT query_id, k, size, round(p, 8) AS rate, round(CASE WHEN p <= 0 OR p >= 1 THEN 0 ELSE -(p * log2(p) + (1 - p) * log2(1 - p)) END, 8) AS entropy FROM r""")
def t15_a16_cohort_sweep(x: Tables) -> DataFrame:
    hits, _, corpus = _neighbours(x, 64)
    rates = cohort.cohort_rates(hits, corpus.withColumn("win", (F.col("label") < 5).cast("int")), "query_id", "row_id", "win", (16, 32, 64))
    return rates.select("query_id", "k", "size", F.round("rate", 8).alias("rate"), F.round("entropy", 8).alias("entropy"))


@query(f"""WITH {_TOP}, r AS (SELECT query_id, k, avg((cl < 5)::INT) AS p FROM t, (VALUES (16), (32), (64)) v(k) WHERE rank <= k GROUP BY ALL),
e AS (SELECT k, CASE WHEN p <= 0 OR p >= 1 THEN 0 ELSE -(p * log2(p) + (1 - p) * log2(1 - p)) END AS h FROM r)
SELECT round(avg(h), 8) AS mean_entropy, avg(h) >= 0.7 AS passes FROM e WHERE k = 64""")
def c22_retrieval_gate(x: Tables) -> DataFrame:
    hits, _, corpus = _neighbours(x, 64)
    rates = cohort.cohort_rates(hits, corpus.withColumn("win", (F.col("label") < 5).cast("int")), "query_id", "row_id", "win", (16, 32, 64))
    return cohort.retrieval_gate(cohort.mean_entropy(rates)).withColumn("mean_entropy", F.round("mean_entropy", 8))


_BANDED = f"""p0 AS ({_PAIRS}), p AS (SELECT *, ql % 5 - 1 AS qb, cl % 5 - 1 AS cb, ql = cl AS own FROM p0),
x AS (SELECT *, CASE WHEN qb >= 0 AND cb >= 0 THEN abs(qb - cb) ELSE 0 END AS diff, qb >= 0 AND cb >= 0 AS both_ranked FROM p
 UNION ALL SELECT vec_id, vec_id, label, label, 0.0, label % 5 - 1, label % 5 - 1, true, 0, label % 5 - 1 >= 0 FROM embeddings WHERE vec_id % 50 = 0),
n AS (SELECT query_id, any_value(qb) AS qb, count(*) FILTER (diff = 0) AS same, count(*) FILTER (NOT own AND diff = 0) AS k0, count(*) FILTER (NOT own AND diff <= 1) AS k1, count(*) FILTER (NOT own) AS k2 FROM x GROUP BY query_id),
s AS (SELECT *, CASE WHEN qb < 0 THEN 0 WHEN least(k0, 40) >= 32 THEN 0 WHEN least(k1, 40) >= 32 THEN 1 ELSE 2 END AS st FROM n),
g AS (SELECT *, CASE WHEN (CASE st WHEN 0 THEN k0 WHEN 1 THEN k1 ELSE k2 END) < 40 THEN 3 ELSE st END AS stage FROM s),
c AS (SELECT x.*, stage, g.same, CASE WHEN stage = 2 AND both_ranked THEN d * 1.25 ** diff ELSE d END AS dist FROM x JOIN g USING (query_id) WHERE stage = 3 OR (NOT own AND (stage = 2 OR (stage = 1 AND diff <= 1) OR (stage = 0 AND diff = 0)))),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, row_id) AS rank FROM c)"""


@query(f"""WITH {_BANDED}
SELECT query_id, row_id, rank::INT AS rank, round(dist, 6) AS distance, stage::INT AS stage, least(same, 40) AS effective_k, CASE WHEN qb >= 0 THEN both_ranked AND diff = 0 END AS in_band FROM r WHERE rank <= 40""")
def t5_banded_nearest(x: Tables) -> DataFrame:
    corpus = x.embeddings.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("key"), (F.col("label") % 5 - 1).alias("band"), F.col("label").alias("grp"))
    asks = corpus.filter("row_id % 50 = 0").withColumnRenamed("row_id", "query_id")  # a search takes these ids as its queries
    return knn.nearest_in_bands(asks, corpus, 40).withColumn("distance", F.round("distance", 6))


_BITS = "CASE WHEN {p} <= 0 OR {p} >= 1 THEN 0 ELSE -({p} * log2({p}) + (1 - {p}) * log2(1 - {p})) END"
_PART = "sqrt(list_sum(list_transform(range({a}, {b}), lambda i: (q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE))))"


@query(f"""WITH RECURSIVE d AS (SELECT 'model' AS source, q.vec_id AS query_id, c.vec_id AS row_id, c.label AS cl, {_PART.format(a=1, b=65)} AS d FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
 UNION ALL SELECT 'static', q.vec_id, c.vec_id, c.label, {_PART.format(a=1, b=9)} FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
 UNION ALL SELECT 'frame', q.vec_id, c.vec_id, c.label, {_PART.format(a=33, b=65)} FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
pl AS (SELECT vec_id, label, row_number() OVER (ORDER BY sha1('0:' || vec_id), vec_id) - 1 AS place, count(*) OVER () - 1 AS n FROM embeddings),
rd AS (SELECT vec_id AS query_id, place AS own, n, n - 64 AS j, []::BIGINT[] AS taken FROM pl WHERE vec_id % 50 = 0
 UNION ALL SELECT query_id, own, n, j + 1, list_append(taken, CASE WHEN list_contains(taken, t) THEN j ELSE t END) FROM (SELECT *, ('0x' || right(sha1('0:' || query_id || ':' || j), 15))::BIGINT % (j + 1) AS t FROM rd WHERE j < n)),
rr AS (SELECT query_id, own, unnest(taken) AS at_place, generate_subscripts(taken, 1) AS rank FROM rd WHERE j = n),
h AS (SELECT source, query_id, cl, row_number() OVER (PARTITION BY source, query_id ORDER BY d, row_id) AS rank FROM d UNION ALL SELECT 'random', query_id, pl.label, rank FROM rr JOIN pl ON pl.place = at_place + (at_place >= own)::INT),
e AS (SELECT source, k, query_id, avg((cl < 5)::INT) AS p FROM h, (VALUES (16), (32), (64)) v(k) WHERE rank <= k GROUP BY ALL)
SELECT source, k, round(avg({_BITS.format(p="p")}), 8) AS mean_entropy, count(*) AS n_queries, CASE WHEN k = 64 THEN avg({_BITS.format(p="p")}) >= 0.7 END AS passes FROM e GROUP BY source, k""")
def c22_retrieval_report(x: Tables) -> DataFrame:
    """Three sources of vectors and random rows, by k: the model's whole vector, and two parts of it in place of the baselines'."""
    rows = x.embeddings.select(F.col("vec_id").alias("row_id"), "embedding", F.slice("embedding", 1, 8).alias("short"), F.slice("embedding", 33, 32).alias("long"), (F.col("label") < 5).cast("int").alias("win"), F.col("vec_id").alias("own"))
    asks = rows.filter("row_id % 50 = 0").withColumnRenamed("row_id", "query_id")  # a search takes these ids as its queries
    out = cohort.retrieval_report(asks, rows, {"model": "embedding", "static": "short", "frame": "long"}, "query_id", "row_id", "win", "own", (16, 32, 64))
    return out.withColumn("mean_entropy", F.round("mean_entropy", 8))


@query(f"""WITH {_TOP}, h AS (SELECT * FROM t WHERE rank <= 16), c AS (SELECT ql, cl, count(*) AS n FROM h GROUP BY ALL), o AS (SELECT sum(n) FILTER (ql = cl) / sum(n) AS diagonal FROM c), m AS (SELECT ql AS minute, coalesce(sum(n) FILTER (ql = cl), 0) / sum(n) AS same_share FROM c GROUP BY ALL),
q AS (SELECT query_id, ql AS minute, count(*) FILTER (ql = cl) AS ns, avg((row_id % 2)::INT) FILTER (ql = cl) AS ps, count(*) FILTER (ql <> cl) AS nc, avg((row_id % 2)::INT) FILTER (ql <> cl) AS pc FROM h GROUP BY ALL),
e AS (SELECT minute, round(avg(CASE WHEN ns >= 4 THEN {_BITS.format(p="ps")} END), 8) AS same_entropy, round(avg(CASE WHEN nc >= 4 THEN {_BITS.format(p="pc")} END), 8) AS cross_entropy FROM q GROUP BY ALL)
SELECT minute, round(same_share, 8) AS same_share, same_entropy, cross_entropy, round(diagonal, 8) AS diagonal, CASE WHEN diagonal > 0.5 THEN 'diagonal-dominant' WHEN diagonal < 0.25 THEN 'broadly mixed' ELSE 'mid-range' END AS verdict FROM m JOIN e USING (minute), o""")
def c24_minute_diagnostic(x: Tables) -> DataFrame:
    hits, asks, corpus = _neighbours(x, 16)
    rows = corpus.select("row_id", F.col("label").alias("minute"), (F.col("row_id") % 2).cast("int").alias("odd"))
    out = cohort.minute_diagnostic(hits, rows, asks.withColumnRenamed("label", "minute"), "query_id", "row_id", "odd")
    return out.withColumns({n: F.round(n, 8) for n in ("same_share", "same_entropy", "cross_entropy", "diagonal")})


@query(f"""WITH {_TOP}, r AS (SELECT query_id, ql AS minute, avg((cl < 5)::INT) AS p FROM t WHERE rank <= 16 GROUP BY ALL) SELECT minute, round(avg({_BITS.format(p="p")}), 8) AS mean_entropy, count(p) AS n FROM (SELECT range AS minute FROM range(0, 12)) LEFT JOIN r USING (minute) GROUP BY ALL""")
def c24_entropy_by_minute(x: Tables) -> DataFrame:
    hits, asks, corpus = _neighbours(x, 16)
    rates = cohort.cohort_rates(hits, corpus.withColumn("win", (F.col("label") < 5).cast("int")), "query_id", "row_id", "win", (16,))
    domain = x.spark.range(12).select(F.col("id").alias("minute"))
    out = cohort.entropy_by_minute(rates, asks.select("query_id", F.col("label").alias("minute")), domain, "query_id")
    return out.select("minute", F.round("mean_entropy", 8).alias("mean_entropy"), F.coalesce("n", F.lit(0)).alias("n"))


_AREA = """(SELECT (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM {rates}))"""


@query(f"""WITH {_BANDED}, bp AS (SELECT q.vec_id AS query_id, c.vec_id AS row_id, q.label AS ql, c.label AS cl, {_PART.format(a=1, b=65)} AS d FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0 AND q.label <> c.label),
bt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, row_id) AS rank FROM bp),
ra AS (SELECT query_id, (any_value(ql) % 2 = 0)::INT AS y, avg((row_id % 3 = 0)::INT) AS p, any_value(least(same, 40)) AS ek FROM r WHERE rank <= 40 GROUP BY ALL), rb AS (SELECT query_id, (any_value(ql) % 2 = 0)::INT AS y, avg((row_id % 3 = 0)::INT) AS p, count(*) AS ek FROM bt WHERE rank <= 40 GROUP BY ALL),
f AS (SELECT (SELECT quantile_disc(ek, 0.5) FROM ra) AS aware_effective_k, {_AREA.format(rates="ra")} AS aware_auc, (SELECT avg({_BITS.format(p="p")}) FROM ra) AS aware_entropy, (SELECT quantile_disc(ek, 0.5) FROM rb) AS base_effective_k, {_AREA.format(rates="rb")} AS base_auc, (SELECT avg({_BITS.format(p="p")}) FROM rb) AS base_entropy)
SELECT aware_effective_k, round(aware_auc, 8) AS aware_auc, round(aware_entropy, 8) AS aware_entropy, base_effective_k, round(base_auc, 8) AS base_auc, round(base_entropy, 8) AS base_entropy, aware_effective_k >= 32 AND aware_auc >= base_auc - 0.02 AND aware_entropy <= base_entropy + 0.03 AS passes FROM f""")
def c23_skill_gate(x: Tables) -> DataFrame:
    """Band-aware neighbours against plain ones: a row's label is whether its id divides by three, a query's whether its group is even."""
    rows = x.embeddings.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("key"), (F.col("label") % 5 - 1).alias("band"), F.col("label").alias("grp"), (F.col("vec_id") % 3 == 0).cast("int").alias("win"))
    asks = rows.filter("row_id % 50 = 0").withColumnRenamed("row_id", "query_id").withColumn("win", (F.col("grp") % 2 == 0).cast("int"))
    aware, base = (materialise(h, "hits") for h in (knn.nearest_in_bands(asks, rows, 40), knn.nearest(asks, rows, 40, exclude=("grp", "grp"))))  # each is read several times, and searched once
    known = aware.groupBy("query_id").agg(F.first("effective_k").alias("effective_k"))
    figures = [cohort.skill_figures(h, rows, asks, "query_id", "row_id", "win", e) for h, e in ((aware, known), (base, None))]
    out = cohort.skill_gate(*figures)
    return out.withColumns({f"{s}_{n}": F.round(f"{s}_{n}", 8) for s in ("aware", "base") for n in ("auc", "entropy")})


@query(f"""WITH {_TOP}, r AS (SELECT query_id, ql, avg((cl < 5)::INT) AS p, count(*) AS size FROM t WHERE rank <= 32 GROUP BY ALL), a AS (SELECT ql AS game, query_id AS pos, CASE WHEN ql % 2 = 0 THEN 100 ELSE 200 END AS side, (ql % 3 = 0)::INT AS won, {_BITS.format(p="p")} AS entropy, p, size FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY game ORDER BY entropy DESC, pos) AS rn FROM a)
SELECT game, pos, side, won, round(entropy, 8) AS entropy, round(CASE side WHEN 100 THEN p ELSE 1 - p END, 8) AS rate, size, CASE won WHEN 1 THEN 'strength' ELSE 'mistake' END AS kind, CASE WHEN entropy < 0.3 THEN 'strong' WHEN entropy < 0.7 THEN 'moderate' ELSE 'weak' END AS confidence,
 floor(CASE side WHEN 100 THEN p ELSE 1 - p END * size + 0.5)::BIGINT || ' of ' || size || ' cohort games ended in a win' AS label FROM b WHERE rn = 1""")
def c25_lessons(x: Tables) -> DataFrame:
    hits, asks, corpus = _neighbours(x, 32)
    rates = cohort.cohort_rates(hits, corpus.withColumn("win", (F.col("label") < 5).cast("int")), "query_id", "row_id", "win", (32,))
    rows = rates.join(asks.select("query_id", F.col("label").alias("game")), "query_id")
    anchors = rows.select("game", F.col("query_id").alias("pos"), F.when(F.col("game") % 2 == 0, 100).otherwise(200).alias("side"), (F.col("game") % 3 == 0).cast("int").alias("won"), "entropy", "rate", "size")
    return cohort.lessons(anchors, "game").withColumn("entropy", F.round("entropy", 8)).withColumn("rate", F.round("rate", 8))


@query(f"WITH {_TOP}, c AS (SELECT ql AS query_label, cl AS row_label, count(*) AS n FROM t WHERE rank <= 16 GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY query_label), 8) AS share FROM c")
def a19_heatmap(x: Tables) -> DataFrame:
    hits, asks, corpus = _neighbours(x, 16)
    rows = hits.join(asks.select("query_id", F.col("label").alias("query_label")), "query_id").join(corpus.select("row_id", F.col("label").alias("row_label")), "row_id")
    return a.heatmap(rows, "query_label", "row_label").withColumn("share", F.round("share", 8))


@query(f"""WITH {_TOP}, h AS (SELECT query_id, ql, count(*) FILTER (ql = cl) AS ns, avg((row_id % 2)::INT) FILTER (ql = cl) AS ps, count(*) FILTER (ql <> cl) AS nc, avg((row_id % 2)::INT) FILTER (ql <> cl) AS pc FROM t WHERE rank <= 16 GROUP BY ALL)
SELECT ql AS minute, round(avg(CASE WHEN ns >= 4 THEN CASE WHEN ps <= 0 OR ps >= 1 THEN 0 ELSE -(ps * log2(ps) + (1 - ps) * log2(1 - ps)) END END), 8) AS same_entropy,
 round(avg(CASE WHEN nc >= 4 THEN CASE WHEN pc <= 0 OR pc >= 1 THEN 0 ELSE -(pc * log2(pc) + (1 - pc) * log2(1 - pc)) END END), 8) AS cross_entropy FROM h GROUP BY ALL""")
def a20_minute_split(x: Tables) -> DataFrame:
    hits, asks, corpus = _neighbours(x, 16)
    out = cohort.minute_split(hits, corpus.select("row_id", F.col("label").alias("minute"), (F.col("row_id") % 2).cast("int").alias("odd")), asks.withColumnRenamed("label", "minute"), "query_id", "row_id", "odd")
    return out.select("minute", F.round("same_entropy", 8).alias("same_entropy"), F.round("cross_entropy", 8).alias("cross_entropy"))


_AUC = """r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM d)
SELECT count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 8) AS auc FROM r"""


@query(f"WITH d AS (SELECT n_chars AS score, quality AS y FROM labels JOIN documents USING (doc_id)), {_AUC}")
def a21_roc_auc(x: Tables) -> DataFrame:
    return a.roc_auc(x.labels.join(x.documents.select("doc_id", "n_chars"), "doc_id"), "n_chars", "quality").withColumn("auc", F.round("auc", 8))


@query("""WITH d AS (SELECT n_chars AS score, (lang = c)::INT AS y, c FROM documents, (VALUES ('en'), ('de'), ('fr'), ('es')) v(c)),
r AS (SELECT c, y, rank() OVER (PARTITION BY c ORDER BY score) + (count(*) OVER (PARTITION BY c, score) - 1) / 2.0 AS r FROM d),
a AS (SELECT c, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM r GROUP BY c) SELECT round(avg(auc), 8) AS macro_auc FROM a""")
def a22_macro_auc(x: Tables) -> DataFrame:
    return a.macro_auc(x.documents, "n_chars", "lang", ["en", "de", "fr", "es"]).withColumn("macro_auc", F.round("macro_auc", 8))


@query("SELECT l_suppkey, quantile_disc(l_quantity, 0.5) AS low, median(l_quantity) AS mid FROM lineitem GROUP BY ALL")
def a23_medians(x: Tables) -> DataFrame:
    return x.lineitem.groupBy("l_suppkey").agg(a.lower_median("l_quantity").alias("low"), F.median("l_quantity").alias("mid"))


@query("""WITH r AS (SELECT c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS rn, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT c_nationkey, max(c_acctbal) AS quantile FROM r WHERE rn = round_even((n - 1) * 0.9, 0) + 1 GROUP BY ALL""")
def a24_nearest_rank(x: Tables) -> DataFrame:
    return a.nearest_rank(x.customer, ["c_nationkey"], "c_acctbal", 0.9)


@query("WITH c AS (SELECT l_suppkey, sum(l_discount - 0.05) AS s FROM lineitem GROUP BY ALL) SELECT round(sum(s * s), 5) AS meat, count(*) AS n_clusters FROM c")
def a26_cluster_meat(x: Tables) -> DataFrame:
    return a.cluster_meat(x.lineitem.withColumn("score", F.col("l_discount") - 0.05), "l_suppkey", "score").withColumn("meat", F.round("meat", 5))


@query("SELECT dim::INT AS dim, round(avg(embedding[dim + 1]::DOUBLE), 8) AS mean, round(var_pop(embedding[dim + 1]::DOUBLE), 8) AS variance, var_pop(embedding[dim + 1]::DOUBLE) > 0.01 AS is_active FROM embeddings, range(0, 64) r(dim) GROUP BY ALL")
def a27_active_dimensions(x: Tables) -> DataFrame:
    return a.dimension_stats(x.embeddings, "embedding", 0.01).withColumn("mean", F.round("mean", 8)).withColumn("variance", F.round("variance", 8))


@query(f"WITH {_TOP}, q AS (SELECT ql, query_id, max((rank <= 5 AND ql = cl)::INT) AS hit FROM t GROUP BY ALL) SELECT ql AS query_label, round(avg(hit), 8) AS hit_rate, count(*) AS n_queries FROM q GROUP BY ALL")
def a28_hit_rate(x: Tables) -> DataFrame:
    hits, asks, corpus = _neighbours(x, 16)
    rows = hits.join(asks.select("query_id", F.col("label").alias("query_label")), "query_id").join(corpus.select("row_id", F.col("label").alias("row_label")), "row_id")
    out = a.hit_rate(rows, ["query_id"], [F.col("rank")], F.col("query_label") == F.col("row_label"), 5, ["query_label"])
    return out.withColumn("hit_rate", F.round("hit_rate", 8))


@query("SELECT user_id, round(coalesce(avg(value) FILTER (event_type = 'purchase' AND value > 90), 0), 6) AS mean FROM events GROUP BY ALL")
def a29_masked_mean(x: Tables) -> DataFrame:
    mask = (F.col("event_type") == "purchase") & (F.col("value") > 90)
    return x.events.groupBy("user_id").agg(F.round(a.masked_mean(F.col("value"), mask), 6).alias("mean"))


@query("WITH c AS (SELECT l_suppkey, l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, count(*) AS n, round(sum(n) / (count(*) * max(n)), 8) AS efficiency FROM c GROUP BY ALL")
def a30_padding(x: Tables) -> DataFrame:
    sizes = x.lineitem.groupBy("l_suppkey", "l_orderkey").agg(F.count("*").alias("size"))
    return a.padding_efficiency(sizes, ["l_suppkey"], "size").withColumn("efficiency", F.round("efficiency", 8))


@query("SELECT h AS hour, n, top FROM range(0, 30) r(h) LEFT JOIN (SELECT hour(ts) AS h, count(*) AS n, max(value) AS top FROM events GROUP BY ALL) USING (h)")
def a18_a25_fixed_domain(x: Tables) -> DataFrame:
    domain = x.spark.range(30).select(F.col("id").alias("hour"))
    rows = x.events.withColumn("hour", F.hour(F.col("ts").cast("timestamp")).cast("long"))
    return a.over_domain(domain, rows, "hour", [F.count("*").alias("n"), F.max("value").alias("top")])


@query("""WITH m AS (SELECT json_extract(props, '$.k')::BIGINT AS k FROM events) SELECT sum(coalesce(k, 0))::DOUBLE AS k, 0.0::DOUBLE AS absent FROM m""")
def a33_map_totals(x: Tables) -> DataFrame:
    return a.map_total(x.events.select(F.from_json("props", "map<string,double>").alias("m")), "m", ["k", "absent"])


_PLACES = """pl AS (SELECT o_custkey, row_number() OVER (ORDER BY sha1(o_custkey::VARCHAR), o_custkey) - 1 AS place FROM (SELECT DISTINCT o_custkey FROM orders)),
f AS (SELECT o_orderkey, min(place) AS place FROM orders JOIN pl USING (o_custkey) GROUP BY ALL), tot AS (SELECT count(*) AS n, floor(count(*) * 0.1) AS target, floor(count(*) * 0.1 * 1.1) AS upper FROM orders),
c AS (SELECT k, (SELECT count(*) FROM f WHERE place < k) AS held FROM (SELECT place + 1 AS k FROM pl))"""
_GROWN = """g AS (SELECT greatest(1, floor(target / 20))::BIGINT AS k FROM tot UNION ALL SELECT greatest(k + 1, floor(k * 1.5))::BIGINT FROM g WHERE k <= (SELECT count(*) FROM pl)),
grown AS (SELECT coalesce(min(g.k), (SELECT count(*) FROM pl)) AS k FROM g JOIN c ON c.k = g.k, tot WHERE held >= target),
chosen AS (SELECT CASE WHEN (SELECT held FROM c WHERE c.k = grown.k) > upper THEN (SELECT min(c.k) FROM c, tot t2 WHERE held >= target) ELSE grown.k END AS k FROM grown, tot)"""


@query(f"WITH RECURSIVE {_PLACES}, {_GROWN} SELECT o_orderkey, k::BIGINT AS n_players FROM f, chosen WHERE place < k")
def c17_player_cold(x: Tables) -> DataFrame:
    _, games, k = splits.player_cold(x.orders.select("o_custkey", "o_orderkey"), x.orders.select("o_orderkey"), "o_custkey", "o_orderkey", 0.1)
    return games.withColumn("n_players", F.lit(k).cast("long"))


@query(f"""WITH RECURSIVE {_PLACES}, {_GROWN}, cold AS (SELECT o_orderkey FROM f, chosen WHERE place < k)
SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM cold) THEN 'player_cold' WHEN ('0x' || right(sha1(o_orderkey::VARCHAR), 8))::BIGINT / 4294967296.0 < 0.1 THEN 'game_cold' ELSE 'train' END AS split FROM orders""")
def c18_o6_splits(x: Tables) -> DataFrame:
    games = x.orders.select("o_orderkey")
    _, cold, _ = splits.player_cold(x.orders.select("o_custkey", "o_orderkey"), games, "o_custkey", "o_orderkey", 0.1)
    game = splits.game_cold(games, cold, "o_orderkey", 0.1)
    rest = splits.train(games, cold, game, game="o_orderkey")
    name = lambda df, n: df.select("o_orderkey", F.lit(n).alias("split"))
    return name(cold, "player_cold").unionByName(name(game, "game_cold")).unionByName(name(rest, "train"))


@query("""WITH v AS (SELECT p_partkey, p_size || '.' || (p_partkey % 30) || CASE WHEN p_partkey % 3 = 0 THEN '.x7' WHEN p_partkey % 3 = 1 THEN '.512.1' ELSE '' END AS v FROM part)
SELECT p_partkey, string_split(v, '.')[1] || '.' || string_split(v, '.')[2] AS patch, string_split(v, '.')[1] || '.' || string_split(v, '.')[2] || '.1' AS asset,
 CASE WHEN p_partkey % 3 = 1 THEN 512 ELSE 0 END AS third FROM v""")
def f1_f3_versions(x: Tables) -> DataFrame:
    tail = F.when(F.col("p_partkey") % 3 == 0, ".x7").when(F.col("p_partkey") % 3 == 1, ".512.1").otherwise("")
    v = F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 30).cast("string"), tail)
    return x.part.select("p_partkey", s.major_minor(v).alias("patch"), s.asset_version(v).alias("asset"), s.version_parts(v)[2].alias("third"))


@query("""WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events) SELECT event_id, round_even((ms % 3600000) / 60000.0, 0)::INT AS minute,
 CASE WHEN (ms // 3600000) % 24 < 6 THEN 1 WHEN (ms // 3600000) % 24 < 12 THEN 2 WHEN (ms // 3600000) % 24 < 18 THEN 3 ELSE 4 END AS hours FROM e""")
def f8_f9_clock(x: Tables) -> DataFrame:
    ms = F.floor(F.col("us") / 1000)
    return x.stream.select("event_id", s.anchor_minute(ms % 3600000).alias("minute"), s.hour_bucket(ms).alias("hours"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS p, l_tax + 0.3 AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN p <= 0 OR p >= 1 THEN 0 ELSE -(p * log2(p) + (1 - p) * log2(1 - p)) END, 6) AS entropy,
 round(least(greatest(p, 1e-6), 1 - 1e-6) * ln(least(greatest(p, 1e-6), 1 - 1e-6) / q) + (1 - least(greatest(p, 1e-6), 1 - 1e-6)) * ln((1 - least(greatest(p, 1e-6), 1 - 1e-6)) / (1 - q)), 6) AS kl FROM p""")
def f12_f15_information(x: Tables) -> DataFrame:
    p, q = F.col("l_discount") * 10, F.col("l_tax") + 0.3
    return x.lineitem.select("l_orderkey", "l_linenumber", F.round(s.binary_entropy(p), 6).alias("entropy"), F.round(s.bernoulli_kl(p, q), 6).alias("kl"))


@query("SELECT c_custkey, round(('0x' || right(sha1(c_name), 8))::BIGINT / 4294967296.0, 9) AS share, left(sha256(encode(c_name) || '\\x00'::BLOB || encode(c_mktsegment) || '\\x00'::BLOB), 16) AS key FROM customer")
def f17_f18_hashes(x: Tables) -> DataFrame:
    return x.customer.select("c_custkey", F.round(s.hash_share(F.col("c_name")), 9).alias("share"), s.content_key(F.col("c_name"), F.col("c_mktsegment")).alias("key"))


@query("SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events")
def f19_json(x: Tables) -> DataFrame:
    return x.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""WITH t AS (SELECT c_custkey, CASE c_nationkey % 6 WHEN 0 THEN 'GOLD' WHEN 1 THEN 'gold' WHEN 2 THEN 'IRON' WHEN 3 THEN 'MASTER' WHEN 4 THEN 'WOOD' END AS tier, floor(c_acctbal)::INT AS lp FROM customer),
n AS (SELECT *, CASE tier WHEN 'GOLD' THEN 4 WHEN 'IRON' THEN 1 WHEN 'MASTER' THEN 8 ELSE 0 END AS num FROM t)
SELECT c_custkey, num, CASE WHEN num <= 0 THEN -1 WHEN num <= 3 THEN 0 WHEN num <= 5 THEN 1 WHEN num <= 7 THEN 2 ELSE 3 END AS band, 1000 * num + greatest(lp, 0) AS seed, 1 + 100 * num + greatest(lp, 0) AS parse,
 CASE WHEN tier IS NULL THEN 0 WHEN upper(tier) = 'GOLD' THEN 4 WHEN tier = 'IRON' THEN 1 WHEN tier = 'MASTER' THEN 8 ELSE 1 END AS looked FROM n""")
def f6_f22_f23_tiers(x: Tables) -> DataFrame:
    m = F.col("c_nationkey") % 6
    tier = F.when(m == 0, "GOLD").when(m == 1, "gold").when(m == 2, "IRON").when(m == 3, "MASTER").when(m == 4, "WOOD")
    rows = x.customer.select("c_custkey", tier.alias("tier"), F.floor("c_acctbal").cast("int").alias("lp")).withColumn("num", s.tier_number(F.col("tier")))
    table = {name: k for k, name in enumerate(s.TIERS, 1)}
    return rows.select("c_custkey", "num", s.tier_band(F.col("num")).alias("band"), s.seed_priority(F.col("num"), F.col("lp")).alias("seed"), s.parse_priority(F.col("num"), F.col("lp")).alias("parse"), s.lookup_any_case(F.col("tier"), table).alias("looked"))


@query("""SELECT page_id, coalesce(nullif(left(regexp_replace(lower(trim(url)), '[^a-z0-9_-]+', '-', 'g'), 64), ''), 'unknown') AS slug, regexp_matches(lower(trim(url)), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') AS email FROM pages""")
def f28_slugs(x: Tables) -> DataFrame:
    return x.pages.select("page_id", s.slug(F.col("url")).alias("slug"), s.is_email(F.col("url")).alias("email"))


@query("""SELECT p_partkey, CASE WHEN p_retailprice / 2000 < 0.3 THEN 'strong' WHEN p_retailprice / 2000 < 0.7 THEN 'moderate' ELSE 'weak' END AS band, floor((p_size / 64.0) * 32 + 0.5)::BIGINT || ' of 32 cohort games ended in a win' AS label FROM part""")
def f29_labels(x: Tables) -> DataFrame:
    return x.part.select("p_partkey", s.confidence_band(F.col("p_retailprice") / 2000).alias("band"), s.wins_label(F.col("p_size") / F.lit(64.0), F.lit(32)).alias("label"))


@query("SELECT event_id, round(sin((us // 1000 % 60000) / 1000.0), 8) AS s0, round(cos((us // 1000 % 60000) / 1000.0 * exp(2 * (-9.210340371976184 / 8))), 8) AS c1 FROM (SELECT event_id, epoch_us(ts) AS us FROM events)")
def f30_time_encoding(x: Tables) -> DataFrame:
    code = s.time_encoding(F.floor(F.col("us") / 1000) % 60000)
    return x.stream.select("event_id", F.round(code[0], 8).alias("s0"), F.round(code[3], 8).alias("c1"))


@query("""SELECT c_custkey, 'At ' || (c_nationkey // 2) || ' min, your team ' || CASE WHEN c_acctbal > 0 THEN 'gained ' ELSE 'lost ' END || lower(c_mktsegment) || '. ' || c_name AS line FROM customer""")
def f24_descriptions(x: Tables) -> DataFrame:
    return x.customer.select("c_custkey", s.describe_move(F.col("c_mktsegment"), F.col("c_acctbal"), F.col("c_nationkey") / 2, F.col("c_name")).alias("line"))


@query("""SELECT page_id, len(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) AS n_links, coalesce(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)[1], '') AS first_link FROM pages""")
def s9_scrape(x: Tables) -> DataFrame:
    from matchlake.sources.files import links

    found = links(F.col("html"))
    return x.pages.select("page_id", F.size(found).cast("long").alias("n_links"), F.coalesce(F.get(found, F.lit(0)), F.lit("")).alias("first_link"))


@query("""WITH RECURSIVE m AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn, CASE WHEN l_suppkey % 4 = 1 THEN 'undo' WHEN l_returnflag = 'R' THEN 'drop' ELSE 'buy' END AS kind, l_partkey % 3 AS item, l_partkey % 3 AS gone, l_suppkey % 3 AS back FROM lineitem),
r AS (SELECT l_orderkey, 0::BIGINT AS rn, []::BIGINT[] AS items FROM (SELECT DISTINCT l_orderkey FROM m)
 UNION ALL SELECT m.l_orderkey, m.rn, CASE kind WHEN 'buy' THEN list_append(items, item)
  WHEN 'drop' THEN CASE WHEN list_contains(items, item) THEN items[1:list_position(items, item) - 1] || items[list_position(items, item) + 1:] ELSE items END
  ELSE CASE WHEN back > 0 THEN list_append(CASE WHEN gone > 0 AND list_contains(items, gone) THEN items[1:list_position(items, gone) - 1] || items[list_position(items, gone) + 1:] ELSE items END, back)
   ELSE CASE WHEN gone > 0 AND list_contains(items, gone) THEN items[1:list_position(items, gone) - 1] || items[list_position(items, gone) + 1:] ELSE items END END END
 FROM r JOIN m ON m.l_orderkey = r.l_orderkey AND m.rn = r.rn + 1)
SELECT l_orderkey, array_to_string(arg_max(items, rn), ',') AS items FROM r GROUP BY ALL""")
def f26_inventory(x: Tables) -> DataFrame:
    """Items bought, dropped and undone in the order of lines."""
    kind = F.when(F.col("l_suppkey") % 4 == 1, "undo").when(F.col("l_returnflag") == "R", "drop").otherwise("buy")
    item = (F.col("l_partkey") % 3).cast("int")
    move = F.struct(F.col("l_linenumber").alias("at"), "l_partkey", "l_suppkey", kind.alias("kind"), item.alias("item"), item.alias("before"), (F.col("l_suppkey") % 3).cast("int").alias("after"))
    moves = x.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(move)).alias("moves"))
    return moves.select("l_orderkey", F.array_join(s.inventory(F.col("moves")), ",").alias("items"))


@query()
def c28_c30_effects(x: Tables) -> DataFrame:
    """Effect of being toxic on being good, by language, given length."""
    rows = x.labels.join(x.documents.select("doc_id", "lang", "n_chars"), "doc_id").select("doc_id", "lang", F.log1p("n_chars").alias("size"), (F.col("doc_id") % 7).alias("noise"), "toxic", "quality")
    return causal.agreement(causal.estimate_effects(rows, ["lang"], ["size", "noise"], "toxic", "quality", "doc_id"))


_VERDICT = """CASE WHEN count(*) < 15 THEN 'thin' WHEN avg(l_discount) > 0.052 THEN 'no_overlap' WHEN avg(l_tax) > 0.041 THEN 'contradict' WHEN avg(l_quantity) < 25.2 THEN 'weak' ELSE 'accept' END"""


@query(f"""WITH v AS (SELECT l_returnflag, l_suppkey % 25 AS band, {_VERDICT} AS verdict FROM lineitem GROUP BY ALL)
SELECT l_returnflag, count(*) FILTER (verdict = 'accept') AS n_accepted, count(*) FILTER (verdict <> 'accept') AS n_rejected, round(avg((verdict = 'no_overlap')::INT), 6) AS overlap_fail_rate, count(DISTINCT band) FILTER (verdict = 'accept') AS n_bands, count(DISTINCT band) FILTER (verdict = 'accept') >= 2 AS passes FROM v GROUP BY l_returnflag""")
def c30_a31_gate(x: Tables) -> DataFrame:
    """How many groups of each kind are accepted, and whether in two bands or more."""
    verdicts = x.lineitem.groupBy("l_returnflag", (F.col("l_suppkey") % 25).alias("band")).agg(F.expr(_VERDICT).alias("verdict"))
    return causal.gate(verdicts, "l_returnflag", "band").withColumn("overlap_fail_rate", F.round("overlap_fail_rate", 6))


@query()
def c31_rank_probe(x: Tables) -> DataFrame:
    """How well a label of the embeddings can be read off all of a vector, its first half, and four of its components."""
    from matchlake.operators.probe import rank_probe

    rows = x.embeddings.filter("label < 4")
    views = {"whole": F.col("embedding"), "half": F.slice("embedding", 1, 32), "four": F.slice("embedding", 1, 4)}
    found = [(name, rank_probe(rows.withColumn("_view", v), "vec_id", "_view", "label")) for name, v in views.items()]
    return x.spark.createDataFrame(found, "view string, auc double")


def _streamed(x: Tables, plan, mode: str = "append") -> DataFrame:
    """The rows that a stream over the events files gives when it drains, kept in the shared folder."""
    from matchlake.sources.scratch import fresh_path
    from matchlake.streaming.workers import drain

    root = fresh_path(x.spark, "stream")
    events = x.spark.read.parquet(f"{x.sf_dir}/events.parquet")
    source = x.spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{x.sf_dir}/events.parquet*")
    out = plan(source.withColumn("ts", F.col("ts").cast("timestamp")))
    drain(out, lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out/batch={n}"), f"{root}/state", mode)
    return x.spark.read.parquet(f"{root}/out").drop("batch")


@query("""WITH w AS (SELECT epoch_us(time_bucket(INTERVAL 30 SECONDS, ts)) AS start_us, count(*) AS n FROM events GROUP BY ALL) SELECT start_us, n FROM w WHERE start_us + 30000000 <= (SELECT max(epoch_us(ts)) - 60000000 FROM events)""")
def r5_stream_throughput(x: Tables) -> DataFrame:
    from matchlake.streaming.workers import throughput

    return _streamed(x, lambda e: throughput(e, "ts")).select(F.unix_micros("start").alias("start_us"), "n")


@query("""WITH e AS (SELECT user_id, event_type, ts, event_id FROM events) SELECT p.event_id, v.event_id AS view_id FROM e p JOIN e v ON p.user_id = v.user_id AND p.event_type = 'purchase' AND v.event_type = 'view' AND v.ts <= p.ts - INTERVAL 15 MINUTES AND v.ts >= p.ts - INTERVAL 6 HOURS""")
def r9_stream_lookback(x: Tables) -> DataFrame:
    """Purchases with the views of their user that lie a quarter to six hours behind, joined as streams."""
    from matchlake.streaming.workers import lookback

    def plan(e: DataFrame) -> DataFrame:
        views = e.filter("event_type = 'view'").select(F.col("user_id"), F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"))
        joined = lookback(e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id"), views, "user_id", "ts", "view_ts", "6 hours", "15 minutes", "7 hours")
        return joined.select("event_id", "view_id")

    return _streamed(x, plan)


@query("SELECT event_id, user_id FROM events")
def r2_stream_once_each(x: Tables) -> DataFrame:
    from matchlake.streaming.workers import once_each

    return _streamed(x, lambda e: once_each(e.unionByName(e), "event_id", "ts")).select("event_id", "user_id")


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, max(value) AS highest FROM events GROUP BY ALL")
def r7_stream_fold(x: Tables) -> DataFrame:
    from matchlake.streaming.workers import running_totals

    last = _streamed(x, lambda e: running_totals(e.select("user_id", "event_id", "value"), "user_id", "event_id", "value"), "update")
    return last.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"), F.max("highest").alias("highest"))


@query("SELECT event_type, count(*) AS priority FROM events GROUP BY ALL")
def r3_stream_priorities(x: Tables) -> DataFrame:
    from matchlake.streaming.workers import priorities

    return _streamed(x, lambda e: priorities(e, "event_type"), "complete").groupBy("event_type").agg(F.max("priority").alias("priority"))
