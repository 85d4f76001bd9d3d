"""Queries of the streams with timers and of the queue source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.plans.registry import Tables, query


def _drained(x: Tables, plan, mode: str) -> DataFrame:
    """What a stream over the events gives; its state is in the store that has timers, and the session's setting stays as it was."""
    from matchlake.sources.scratch import fresh_path
    from matchlake.streaming.expiring import with_timers
    from matchlake.streaming.workers import drain

    name, root = "spark.sql.streaming.stateStore.providerClass", fresh_path(x.spark, "stream")
    held = x.spark.conf.get(name)
    with_timers(x.spark)
    try:
        source = x.spark.readStream.schema(x.events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{x.sf_dir}/events.parquet*")
        drain(plan(source.withColumn("ts", F.col("ts").cast("timestamp"))), lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out/batch={n}"), f"{root}/state", mode)
    finally:
        x.spark.conf.set(name, held)
    return x.spark.read.parquet(f"{root}/out").drop("batch")


@query("""WITH g AS (SELECT *, ts - lag(ts) OVER w > INTERVAL 6 HOURS AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, max(value) AS highest FROM s WHERE (user_id, run) IN (SELECT (user_id, max(run)) FROM s GROUP BY user_id) GROUP BY user_id""")
def r7_stream_expiring_totals(x: Tables) -> DataFrame:
    """Totals of each user since the last silence of more than six hours; state of silent users goes."""
    from matchlake.streaming.expiring import running_totals

    out = _drained(x, lambda e: running_totals(e, "user_id", "ts", "value", 6), "update")
    return out.select("user_id", "n", F.round("total", 4).alias("total"), "highest")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts FROM events),
p AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY user_id
 UNION ALL SELECT p.user_id, (SELECT min(e.ts) FROM e WHERE e.user_id = p.user_id AND e.ts >= p.ts + INTERVAL 24 HOURS) FROM p WHERE p.ts IS NOT NULL)
SELECT DISTINCT user_id, epoch_us(ts) AS us FROM p WHERE ts IS NOT NULL""")
def r8_stream_cooldown(x: Tables) -> DataFrame:
    """The events of each user that come a day or more after the last one let through."""
    from matchlake.streaming.expiring import cooled_down

    out = _drained(x, lambda e: cooled_down(e.select("user_id", "event_id", "ts"), "user_id", "ts", 24), "append")
    return out.select("user_id", F.unix_micros("ts").alias("us"))


@query("""WITH g AS (SELECT *, ts - lag(ts) OVER w > INTERVAL 12 HOURS AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT event_id, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS window_id FROM s""")
def r6_stream_anchor_windows(x: Tables) -> DataFrame:
    """Anchor windows of a stream, begun anew after twelve silent hours."""
    from matchlake.streaming.expiring import anchor_windows

    rows = lambda e: e.select("user_id", "event_id", "ts", (F.col("event_type") == "signup").alias("is_anchor"))
    return _drained(x, lambda e: anchor_windows(rows(e), "user_id", "ts", ["ts", "event_id"], "is_anchor", 12), "append").select("event_id", "window_id")


@query("SELECT event_id, event_id % 5 AS score, 4 - event_id % 5 AS batch FROM events")
def s10_r1_queue_stream(x: Tables) -> DataFrame:
    """Events in a queue by score, drained a file at a time: the batch in which each came."""
    from matchlake.sources.queue import enqueue, queue_stream
    from matchlake.sources.scratch import fresh_path
    from matchlake.streaming.workers import drain

    root = fresh_path(x.spark, "queue")
    enqueue(x.events.select("event_id"), f"{root}/items", F.col("event_id") % 5)
    for _ in range(5):
        drain(queue_stream(x.spark, f"{root}/items", "event_id long", 1), lambda df, n: df.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{root}/out/n={n}"), f"{root}/state")
    return x.spark.read.parquet(f"{root}/out").select("event_id", "score", "batch")
