"""Incremental forms of the work queues and ordered folds."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", wall_s: float | None = None) -> bool:
    """Take what is there, batch by batch, and stop; after wall_s seconds at the latest (R1). Whether all was taken.

    The checkpoint makes a batch's number stable over restarts, and a later drain goes on where this one stopped.
    """
    running = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if wall_s is None:
        running.awaitTermination()
        return True
    done = bool(running.awaitTermination(wall_s))
    if not done:
        running.stop()
    return done


def drain_until_idle(stream: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, idle_s: float = 15.0, wall_s: float = 8 * 3600.0, pause_s: float = 1.0) -> int:
    """Drain again and again until nothing has come for idle_s, or wall_s is over (R1). stream makes the source anew; the number of rows taken."""
    taken, began = [0], time.monotonic()
    last = began

    def counted(df: DataFrame, n: int) -> None:
        taken[0] += df.count()
        sink(df, n)

    while time.monotonic() - began < wall_s:
        before = taken[0]
        drain(stream(), counted, checkpoint, wall_s=max(1.0, wall_s - (time.monotonic() - began)))
        now = time.monotonic()
        last = now if taken[0] > before else last
        if now - last >= idle_s:
            break
        time.sleep(pause_s)
    return taken[0]


def once_each(stream: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark (R2)."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def priorities(stream: DataFrame, key: str, score: Callable | None = None) -> DataFrame:
    """Accumulated priority of each key (R3); rows weigh 1 unless score says otherwise."""
    return stream.groupBy(key).agg(F.sum(F.lit(1) if score is None else score()).alias("priority"))


def throughput(stream: DataFrame, ts: str, width: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Rows in each tumbling window, final once the watermark has passed it."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def lookback(stream: DataFrame, frames: DataFrame, key: str, ts: str, frame_ts: str, most: str = "75 seconds", back: str = "15 seconds", late: str = "2 minutes") -> DataFrame:
    """Events joined to the frames that lie back or more behind them, within a bounded interval."""
    a = stream.withWatermark(ts, late).alias("a")
    b = frames.withWatermark(frame_ts, late).alias("b")
    when = (F.col(f"a.{key}") == F.col(f"b.{key}")) & F.expr(f"b.{frame_ts} <= a.{ts} - INTERVAL {back}") & F.expr(f"b.{frame_ts} >= a.{ts} - INTERVAL {most}")
    return a.join(b, when)


def running_totals(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """A fold with state for each key: rows in order within a batch, totals over all batches so far.

    Output: key, n, total, highest after each batch that has rows of the key.
    """

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, highest = state.get if state.exists else (0, 0.0, float("-inf"))
        rows = pd.concat(list(frames)).sort_values(order)
        n, total, highest = n + len(rows), total + float(rows[value].sum()), max(highest, float(rows[value].max()))
        state.update((n, total, highest))
        yield pd.DataFrame({key: [keys[0]], "n": [n], "total": [total], "highest": [highest]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, n long, total double, highest double", "n long, total double, highest double", "update", GroupStateTimeout.NoTimeout)


def cooled_down(stream: DataFrame, key: str, micros: str, cooldown_us: int = 86_400_000_000) -> DataFrame:
    """Rows that come a cooldown or more after the last row let through."""

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(micros)
        keep = []
        for at in rows[micros]:
            keep.append(last is None or at - last >= cooldown_us)
            last = int(at) if keep[-1] else last
        state.update((last,))
        yield rows[keep]

    schema = ", ".join(f"`{n}` {t}" for n, t in stream.dtypes)
    return stream.groupBy(key).applyInPandasWithState(step, schema, "last long", "append", GroupStateTimeout.NoTimeout)
