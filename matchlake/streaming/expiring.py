"""Folds with state that expires: a key that is silent for long enough in event time leaves no state behind.

Each key's state has a timer at the time when it stops to matter; the watermark sets it off, and the state goes. State needs Spark's RocksDB store
(with_timers() sets it) and the engine's clock is the rows' own, so that a replay gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_timers(spark: SparkSession) -> None:
    """Streams that this session starts from now on keep state in the store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _Expiring(StatefulProcessor):
    """State of one row for each key, dropped when the watermark is `keep_ms` past the key's last time."""

    FIELDS = ""

    def __init__(self, key: str, ts: str, keep_ms: int):
        self.key, self.ts, self.keep_ms = key, ts, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", self.FIELDS)

    def keep(self, row: tuple, last_ms: int) -> None:
        self.state.update(row)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(last_ms + self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def _millis(column: pd.Series) -> pd.Series:
    return column.astype("datetime64[ms]").astype("int64")


class _Totals(_Expiring):
    FIELDS = "n long, total double, highest double, last_ms long"

    def __init__(self, key: str, ts: str, value: str, keep_ms: int):
        super().__init__(key, ts, keep_ms)
        self.value = value

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(self.ts, kind="stable")
        at = _millis(frame[self.ts])
        n, total, highest, last = self.state.get() if self.state.exists() else (0, 0.0, float("-inf"), None)
        before = at.shift(1)
        if last is not None:
            before.iloc[0] = last
        starts = (at - before > self.keep_ms).to_numpy().nonzero()[0]
        if len(starts):  # silent for too long: what was counted before is forgotten, whether or not its timer has gone off
            frame, at = frame.iloc[starts[-1] :], at.iloc[starts[-1] :]
            n, total, highest, last = 0, 0.0, float("-inf"), None
        values = frame[self.value].dropna()
        n, total, highest = n + len(frame), total + float(values.sum()), max(highest, float(values.max())) if len(values) else highest
        last = max(int(at.iloc[-1]), last if last is not None else int(at.iloc[-1]))
        self.keep((n, total, highest, last), last)
        yield pd.DataFrame({self.key: [key[0]], "n": [n], "total": [total], "highest": [highest]})


class _Cooldown(_Expiring):
    FIELDS = "last_ms long"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(self.ts, kind="stable").reset_index(drop=True)
        at = _millis(frame[self.ts]).to_numpy()
        last = self.state.get()[0] if self.state.exists() else None
        passed, k = [], 0
        while k < len(at):  # from one row that passes to the next
            k = k if last is None else max(k, int(at.searchsorted(last + self.keep_ms)))
            if k < len(at):
                passed.append(k)
                last = int(at[k])
                k += 1
        if passed:
            self.keep((last,), last)
        yield frame.iloc[passed]


class _Anchors(_Expiring):
    FIELDS = "n long, last_ms long"

    def __init__(self, key: str, ts: str, order: list[str], flag: str, keep_ms: int):
        super().__init__(key, ts, keep_ms)
        self.order, self.flag = order, flag

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable").reset_index(drop=True)
        at, one = _millis(frame[self.ts]), frame[self.flag].fillna(False).astype("int64")
        n, last = self.state.get() if self.state.exists() else (0, None)
        before = at.shift(1)
        if last is not None:
            before.iloc[0] = last
        count = n + one.cumsum()
        # what was counted up to the last long silence is taken off
        off = (count - one).where(at - before > self.keep_ms).ffill().fillna(0).astype("int64")
        last = max(int(at.iloc[-1]), last if last is not None else int(at.iloc[-1]))
        self.keep((int(count.iloc[-1] - off.iloc[-1]), last), last)
        yield frame.assign(window_id=count - off)


def _run(stream: DataFrame, key: str, ts: str, late: str, processor: _Expiring, schema: str, mode: str) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(key).transformWithStateInPandas(processor, schema, mode, "EventTime")


def running_totals(stream: DataFrame, key: str, ts: str, value: str, hours: float = 24, late: str = "1 hour") -> DataFrame:
    """key, n, total, highest of a key's rows since it was last silent for more than some hours, after each batch that has rows of it."""
    kind = dict(stream.dtypes)[key]
    return _run(stream.select(key, ts, value), key, ts, late, _Totals(key, ts, value, int(hours * 3_600_000)), f"`{key}` {kind}, n long, total double, highest double", "Update")


def cooled_down(stream: DataFrame, key: str, ts: str, hours: float = 24, late: str = "1 hour") -> DataFrame:
    """Rows that come some hours or more after the key's last row let through."""
    schema = ", ".join(f"`{n}` {t}" for n, t in stream.dtypes)
    return _run(stream, key, ts, late, _Cooldown(key, ts, int(hours * 3_600_000)), schema, "Append")


def anchor_windows(stream: DataFrame, key: str, ts: str, order: list[str], flag: str, hours: float = 24, late: str = "1 hour") -> DataFrame:
    """Rows with window_id, the number of the key's flagged rows up to the row since the key was last silent for more than some hours.

    Rows count in the order in which batches bring them, and by order within a batch.
    """
    schema = ", ".join([*(f"`{n}` {t}" for n, t in stream.dtypes), "window_id long"])
    return _run(stream, key, ts, late, _Anchors(key, ts, order, flag, int(hours * 3_600_000)), schema, "Append")
