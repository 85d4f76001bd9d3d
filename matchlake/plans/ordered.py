"""Queries of the ordered operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.operators import temporal as t
from matchlake.operators.packing import budget_batches
from matchlake.plans.registry import Tables, query

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000
_E = "e AS (SELECT *, epoch_us(ts) AS us FROM events)"


@query(f"""WITH {_E} SELECT event_id, count(*) FILTER (event_type = 'view') OVER w AS n_view, count(*) FILTER (event_type = 'purchase') OVER w AS n_purchase
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def w1_running_counts(x: Tables) -> DataFrame:
    kind = F.col("event_type")
    return t.running_counts(x.stream, ["user_id"], "us", {"n_view": kind == "view", "n_purchase": kind == "purchase"}).select("event_id", "n_view", "n_purchase")


_ASOF = f"""WITH {_E}, v AS (SELECT user_id, us, max_by(value, event_id) AS view_value, max(event_id) AS view_id FROM e WHERE event_type = 'view' GROUP BY ALL)
SELECT p.event_id, v.view_id, v.view_value FROM (SELECT *, us - {{offset}} AS at FROM e WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.at >= v.us"""


def _asof(x: Tables, offset: int) -> DataFrame:
    views = x.stream.filter("event_type = 'view'").select("user_id", "us", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    bought = x.stream.filter("event_type = 'purchase'").select("user_id", "us", "event_id")
    return t.asof_backward(bought, views, ["user_id"], "us", "us", ["view_id", "view_value"], tie="view_id", offset=offset).select("event_id", "view_id", "view_value")


@query(_ASOF.format(offset=0))
def j11_asof_join(x: Tables) -> DataFrame:
    return _asof(x, 0)


@query(_ASOF.format(offset=HOUR_US))
def j13_asof_lookback(x: Tables) -> DataFrame:
    return _asof(x, HOUR_US)


@query(f"""WITH {_E}, d AS (SELECT user_id, event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY us, event_id) AS delta FROM e),
r AS (SELECT user_id, event_id, round(delta, 6) AS delta, row_number() OVER (PARTITION BY user_id ORDER BY abs(delta) DESC, event_id) AS place FROM d WHERE abs(delta) >= 20)
SELECT * FROM r WHERE place <= 10""")
def w2_t6_key_moments(x: Tables) -> DataFrame:
    rows = t.lag_delta(x.stream, ["user_id"], ["us", "event_id"], "value").filter(F.abs("delta") >= 20)
    over = Window.partitionBy("user_id").orderBy(F.abs("delta").desc(), "event_id")
    return rows.withColumn("place", F.row_number().over(over).cast("long")).filter("place <= 10").select("user_id", "event_id", F.round("delta", 6).alias("delta"), "place")


@query(f"""WITH {_E}, l AS (SELECT user_id, event_id, event_type = 'error' AS now, lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY us, event_id) AS was FROM e)
SELECT user_id, event_id FROM l WHERE now AND NOT was""")
def w3_entered(x: Tables) -> DataFrame:
    return t.entered(x.stream, ["user_id"], ["us", "event_id"], F.col("event_type") == "error").select("user_id", "event_id")


@query(f"""WITH {_E}, w AS (SELECT user_id, event_id, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS window_id FROM e)
SELECT user_id, window_id, count(*) AS n FROM w GROUP BY ALL""")
def w4_anchor_windows(x: Tables) -> DataFrame:
    return t.anchor_windows(x.stream, ["user_id"], ["us", "event_id"], F.col("event_type") == "signup").groupBy("user_id", "window_id").agg(F.count("*").alias("n"))


@query(f"""WITH {_E}, w AS (SELECT *, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS window_id FROM e),
m AS (SELECT *, max(window_id) OVER (PARTITION BY user_id) AS top FROM w)
SELECT user_id, window_id, coalesce(arg_min(event_type, (us, event_id)) FILTER (event_type <> 'signup'), 'none') AS first_kind,
 coalesce(arg_max(event_type, (us, event_id)) FILTER (event_type <> 'signup'), 'none') AS last_kind,
 max((event_type = 'error')::INT) AS has_error, max((event_type = 'purchase')::INT) AS has_purchase
FROM m WHERE window_id > 0 AND window_id < top GROUP BY ALL""")
def w5_w7_window_labels(x: Tables) -> DataFrame:
    return t.window_labels(x.stream, ["user_id"], ["us", "event_id"], "event_type", F.col("event_type") == "signup", ["error", "purchase"])


@query(f"""WITH {_E} SELECT event_id, round(lead(value) OVER w - value, 6) AS next_delta, coalesce(lead(value > 10) OVER w AND value > 10, false) AS both_valid
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)""")
def w8_w9_transitions(x: Tables) -> DataFrame:
    rows = t.lead_delta(x.stream, ["user_id"], ["us", "event_id"], "value", F.col("value") > 10)
    return rows.select("event_id", F.round("next_delta", 6).alias("next_delta"), "both_valid")


@query(f"""WITH {_E} SELECT user_id, arg_min(value, (us < 1705276800000000, us, event_id)) AS value FROM e GROUP BY user_id""")
def w10_first_at_or_after(x: Tables) -> DataFrame:
    return t.first_at_or_after(x.stream, ["user_id"], "us", 1705276800000000, "value", "event_id")


@query(f"""WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM e) SELECT user_id, event_id, value FROM r WHERE rn = 5""")
def w11_nth_row(x: Tables) -> DataFrame:
    return t.nth_row(x.stream, ["user_id"], ["us", "event_id"], 5).select("user_id", "event_id", "value")


@query(f"""WITH {_E} SELECT event_id, lag(value) OVER w AS prev_value, lag(event_type) OVER w AS prev_event_type FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)""")
def w12_previous_values(x: Tables) -> DataFrame:
    return t.previous_values(x.stream, ["user_id"], ["us", "event_id"], ["value", "event_type"]).select("event_id", "prev_value", "prev_event_type")


@query("""WITH c AS (SELECT l_suppkey, l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_suppkey, l_orderkey, n, coalesce(sum(n) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM c""")
def w13_offsets(x: Tables) -> DataFrame:
    counts = x.lineitem.groupBy("l_suppkey", "l_orderkey").agg(F.count("*").alias("n"))
    return t.offsets(counts, ["l_suppkey"], ["l_orderkey"], "n")


@query("""WITH RECURSIVE s AS (SELECT l_suppkey, l_orderkey, count(*) AS lines, sum(l_quantity)::BIGINT AS pieces, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS rn FROM lineitem GROUP BY l_suppkey, l_orderkey),
b AS (SELECT *, 0::BIGINT AS batch, 1::BIGINT AS held, lines AS top1, pieces AS top2 FROM s WHERE rn = 1
 UNION ALL SELECT l_suppkey, l_orderkey, lines, pieces, rn, CASE WHEN is_full THEN batch + 1 ELSE batch END, CASE WHEN is_full THEN 1 ELSE held + 1 END, CASE WHEN is_full THEN lines ELSE greatest(lines, top1) END, CASE WHEN is_full THEN pieces ELSE greatest(pieces, top2) END
 FROM (SELECT s.*, batch, held, top1, top2, greatest(s.lines, top1) * (held + 1) > 16 OR greatest(s.pieces, top2) * (held + 1) > 400 AS is_full FROM b JOIN s ON s.l_suppkey = b.l_suppkey AND s.rn = b.rn + 1))
SELECT l_suppkey, l_orderkey, lines, pieces, batch FROM b""")
def w14_budget_batches(x: Tables) -> DataFrame:
    sizes = x.lineitem.groupBy("l_suppkey", "l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("long").alias("pieces"))
    return budget_batches(sizes, ["l_suppkey"], ["l_orderkey"], ["lines", "pieces"], [16, 400])


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM (SELECT *, rank() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS r FROM events) WHERE r = 1 GROUP BY ALL")
def w16_first_of(x: Tables) -> DataFrame:
    return t.first_of(x.stream, ["user_id", "event_type"], ["us", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT epoch_us(time_bucket(INTERVAL 30 SECONDS, ts)) AS start_us, count(*) AS n FROM events GROUP BY ALL")
def w17_throughput(x: Tables) -> DataFrame:
    return t.throughput(x.events, "ts")


@query(f"""WITH {_E}, g AS (SELECT user_id, event_id, us, floor((us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id)) / {DAY_US}.0) AS gap FROM e),
r AS (SELECT *, count(*) FILTER (gap IS NULL OR gap > 1) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT event_id, 1 + count(*) FILTER (gap = 1) OVER (PARTITION BY user_id, run ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM r""")
def w18_streaks(x: Tables) -> DataFrame:
    return t.streaks(x.stream, ["user_id"], ["us", "event_id"], "us").select("event_id", "streak")


@query(f"""WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS rn FROM e) SELECT user_id, event_id FROM r WHERE rn <= 30""")
def w19_last_n(x: Tables) -> DataFrame:
    return t.last_n(x.stream, ["user_id"], [F.desc("us"), F.desc("event_id")], 30).select("user_id", "event_id")


@query(f"""WITH {_E}, c AS (SELECT user_id, event_type, us, event_id, count(*) FILTER (event_type = 'view') OVER w AS v, count(*) FILTER (event_type = 'purchase') OVER w AS p
 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (SELECT user_id, event_id, us, v - p AS lead, (v - p) - lag(v - p) OVER (PARTITION BY user_id ORDER BY us, event_id) AS delta FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(delta) DESC, us, event_id) AS place FROM l WHERE abs(delta) >= 1)
SELECT user_id, event_id, lead, delta, place FROM r WHERE place <= 10""")
def flagship_moments(x: Tables) -> DataFrame:
    """Running counts, their difference, its changes, and the ten largest of each user: one shuffle for all."""
    kind = F.col("event_type")
    rows = t.running_counts(x.stream.select("user_id", "event_id", "event_type", "us"), ["user_id"], "us", {"v": kind == "view", "p": kind == "purchase"})
    rows = t.lag_delta(rows.withColumn("lead", F.col("v") - F.col("p")), ["user_id"], ["us", "event_id"], "lead").filter(F.abs("delta") >= 1)
    over = Window.partitionBy("user_id").orderBy(F.abs("delta").desc(), "us", "event_id")
    return rows.withColumn("place", F.row_number().over(over).cast("long")).filter("place <= 10").select("user_id", "event_id", "lead", "delta", "place")


@query(f"""WITH {_E}, r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM e),
s AS (SELECT *, greatest(1, n // 12) AS stride FROM r) SELECT user_id, event_id FROM s WHERE rn % stride = 0 AND rn // stride < 12""")
def p16_strided(x: Tables) -> DataFrame:
    from matchlake.operators.topk import strided

    return strided(x.stream, ["user_id"], ["us", "event_id"], 12).select("user_id", "event_id")


@query(f"""WITH {_E}, r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS rn FROM e) SELECT user_id, event_id FROM r WHERE rn % 4 = 3""")
def p15_rotating_stride(x: Tables) -> DataFrame:
    from matchlake.operators.topk import rotating_stride

    return rotating_stride(x.stream, ["user_id"], ["us", "event_id"], 4, 7).select("user_id", "event_id")


@query("SELECT c_custkey, row_number() OVER (ORDER BY sha1('5:' || c_custkey), c_custkey) - 1 AS place FROM customer")
def w15_seeded_order(x: Tables) -> DataFrame:
    """Places in a seeded order: ranks within hash cells, and the sizes of the cells before."""
    return t.seeded_order(x.customer, "c_custkey", 5)
