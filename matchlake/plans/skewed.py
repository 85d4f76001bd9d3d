"""Ordered queries over a stream half of which is one user's, by slices of that user's history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.operators import segments as s
from matchlake.plans.registry import Tables, query

#: Rows of a slice: small, so that the tables here have some.
ROWS = 500
_E = "e AS (SELECT CASE WHEN event_id % 2 = 0 THEN -1 ELSE user_id END AS user_id, event_id, event_type, value, epoch_us(ts) AS us FROM events)"


def stream(x: Tables) -> DataFrame:
    """events with half of them under user -1."""
    return x.stream.withColumn("user_id", F.when(F.col("event_id") % 2 == 0, F.lit(-1)).otherwise(F.col("user_id")))


@query(f"""WITH {_E} SELECT event_id, count(*) FILTER (event_type = 'view') OVER w AS n_view, count(*) FILTER (event_type = 'purchase') OVER w AS n_purchase
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def w1_running_counts_hot_key(x: Tables) -> DataFrame:
    kind = F.col("event_type")
    return s.running_counts(stream(x), ["user_id"], "us", {"n_view": kind == "view", "n_purchase": kind == "purchase"}, ROWS).select("event_id", "n_view", "n_purchase")


@query(f"""WITH {_E}, v AS (SELECT user_id, us, max_by(value, event_id) AS view_value, max(event_id) AS view_id FROM e WHERE event_type = 'view' GROUP BY ALL)
SELECT p.event_id, v.view_id, v.view_value FROM (SELECT * FROM e WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.us >= v.us""")
def j11_j12_asof_hot_key(x: Tables) -> DataFrame:
    views = stream(x).filter("event_type = 'view'").select("user_id", "us", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    bought = stream(x).filter("event_type = 'purchase'").select("user_id", "us", "event_id")
    return s.asof_backward(bought, views, ["user_id"], "us", "us", ["view_id", "view_value"], tie="view_id", rows=ROWS).select("event_id", "view_id", "view_value")


@query(f"WITH {_E} SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY us, event_id), 6) AS delta FROM e")
def w2_lag_delta_hot_key(x: Tables) -> DataFrame:
    return s.lag_delta(stream(x), ["user_id"], ["us", "event_id"], "value", rows=ROWS).select("event_id", F.round("delta", 6).alias("delta"))


@query(f"""WITH {_E}, l AS (SELECT event_id, event_type = 'error' AS now, lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY us, event_id) AS was FROM e)
SELECT event_id FROM l WHERE now AND NOT was""")
def w3_entered_hot_key(x: Tables) -> DataFrame:
    return s.entered(stream(x), ["user_id"], ["us", "event_id"], F.col("event_type") == "error", ROWS).select("event_id")


@query(f"WITH {_E} SELECT event_id, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS window_id FROM e")
def w4_anchor_windows_hot_key(x: Tables) -> DataFrame:
    return s.anchor_windows(stream(x), ["user_id"], ["us", "event_id"], F.col("event_type") == "signup", ROWS).select("event_id", "window_id")


@query(f"""WITH {_E}, g AS (SELECT *, floor((us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id)) / 3600000000.0) AS gap FROM e),
r AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT event_id, (1 + sum(CASE WHEN gap = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS streak FROM r""")
def w18_streaks_hot_key(x: Tables) -> DataFrame:
    return s.streaks(stream(x), ["user_id"], ["us", "event_id"], "us", 3_600_000_000, ROWS).select("event_id", "streak")
