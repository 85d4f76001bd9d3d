"""The priority queue as a stream over restarts, and state that expires."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from matchlake.sources.queue import enqueue, queue_stream
from matchlake.streaming import expiring
from matchlake.streaming.workers import drain

ITEM = "id long, name string"


def test_queue_gives_the_highest_scores_first(spark, tmp_path):
    path, taken = str(tmp_path / "queue"), []
    items = spark.range(60).select("id", F.concat(F.lit("é\n"), F.col("id").cast("string")).alias("name"))
    enqueue(items, path, F.col("id") % 6)
    take = lambda df, n: taken.append(sorted((r.score, r.id, r.name) for r in df.collect()))
    for _ in range(3):
        drain(queue_stream(spark, path, ITEM, files=2), take, str(tmp_path / "state"))
    assert [sorted({s for s, *_ in b}) for b in taken] == [[4, 5], [2, 3], [0, 1]]
    assert sorted(x for b in taken for x in b) == sorted((i % 6, i, f"é\n{i}") for i in range(60))
    enqueue(items.limit(3), path, F.lit(9))
    drain(queue_stream(spark, path, ITEM), take, str(tmp_path / "state"))
    assert len(taken) == 4 and {s for s, *_ in taken[3]} == {9}
    drain(queue_stream(spark, path, ITEM), take, str(tmp_path / "state"))
    assert len(taken) == 4


def test_a_killed_stream_loses_and_repeats_nothing(spark, tmp_path):
    """The sink fails in its second batch; the next run takes that batch again, and only that one; a new stream takes what was not committed."""
    path, kept = str(tmp_path / "queue"), {}
    enqueue(spark.range(40).select("id", F.lit("x").alias("name")), path, F.col("id") % 4)

    def sink(df, n):
        if n == 1 and not kept.get("failed"):
            kept["failed"] = True
            raise RuntimeError("killed")
        kept.setdefault(n, sorted(r.id for r in df.collect()))

    state = str(tmp_path / "state")
    drain(queue_stream(spark, path, ITEM, files=1), sink, state)
    with pytest.raises(Exception, match="killed"):
        drain(queue_stream(spark, path, ITEM, files=1), sink, state)
    for _ in range(4):
        drain(queue_stream(spark, path, ITEM, files=1), sink, state)
    rows = [i for n, ids in kept.items() if n != "failed" for i in ids]
    assert sorted(rows) == list(range(40)) and kept[0] == [i for i in range(40) if i % 4 == 3]
    # without its checkpoint: a plan that was taken and never committed comes first
    enqueue(spark.range(40, 44).select("id", F.lit("y").alias("name")), path, F.lit(1))
    with pytest.raises(Exception, match="killed"):
        drain(queue_stream(spark, path, ITEM), lambda df, n: (_ for _ in ()).throw(RuntimeError("killed")), state)
    again = []
    drain(queue_stream(spark, path, ITEM), lambda df, n: again.extend(r.id for r in df.collect()), str(tmp_path / "other"))
    assert sorted(i for i in again if i >= 40) == [40, 41, 42, 43]


def events(n: int, seed: int):
    rng, at, rows = random.Random(seed), datetime(2024, 1, 1), []
    for i in range(n):
        at += timedelta(minutes=rng.randint(1, 40))
        rows.append((rng.randint(0, 8) if i < n // 2 else rng.randint(6, 12), at, i, rng.choice([1.0, 2.0, None])))
    return rows


def feed(spark, path, rows, batches):
    """rows in files that a stream reads one at a time, in order."""
    size = -(-len(rows) // batches)
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], "k long, ts timestamp, i long, v double").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("k long, ts timestamp, i long, v double").option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture
def timers(spark):
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    expiring.with_timers(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)


def state_rows(spark, state):
    return {r.key.k if hasattr(r.key, "k") else r.key[0] for r in spark.read.format("statestore").option("path", state).option("stateVarName", "held").load().collect()}


def test_totals_forget_silent_keys(spark, tmp_path, timers):
    rows, out, state = events(400, 1), {}, str(tmp_path / "state")
    source = feed(spark, str(tmp_path / "in"), rows, 4)
    drain(expiring.running_totals(source, "k", "ts", "v"), lambda df, n: out.update({r.k: (r.n, r.total, r.highest) for r in df.collect()}), state, "update")
    want = {}
    for k in {r[0] for r in rows}:
        own, since = [r for r in rows if r[0] == k], 0
        for j in range(1, len(own)):
            since = j if own[j][1] - own[j - 1][1] > timedelta(hours=24) else since
        values = [r[3] for r in own[since:] if r[3] is not None]
        want[k] = (len(own) - since, sum(values), max(values, default=float("-inf")))
    assert out == want
    end = max(r[1] for r in rows) - timedelta(hours=1)
    alive = {k for k in want if max(r[1] for r in rows if r[0] == k) + timedelta(hours=24) > end}
    assert state_rows(spark, state) == alive and len(alive) < len(want), "state of silent keys is gone"


def test_cooldown_forgets(spark, tmp_path, timers):
    rows, out, state = events(300, 2), [], str(tmp_path / "state")
    source = feed(spark, str(tmp_path / "in"), rows, 3)
    drain(expiring.cooled_down(source, "k", "ts", 6), lambda df, n: out.extend((r.k, r.i) for r in df.collect()), state)
    want, last = [], {}
    for k, at, i, _ in rows:
        if k not in last or at - last[k] >= timedelta(hours=6):
            want.append((k, i))
            last[k] = at
    assert sorted(out) == sorted(want)
    end = max(r[1] for r in rows) - timedelta(hours=1)
    assert state_rows(spark, state) == {k for k, at in last.items() if at + timedelta(hours=6) > end}


def test_anchor_windows_go_on_over_batches(spark, tmp_path, timers):
    rows, out, state = events(300, 5), {}, str(tmp_path / "state")
    source = feed(spark, str(tmp_path / "in"), rows, 4).withColumn("flag", F.col("v") == 2)
    drain(expiring.anchor_windows(source, "k", "ts", ["ts", "i"], "flag", 10), lambda df, n: out.update({r.i: r.window_id for r in df.collect()}), state)
    held, want = {}, {}
    for k, at, i, v in rows:
        n, last = held.get(k, (0, at))
        n = (0 if at - last > timedelta(hours=10) else n) + (v == 2)
        held[k], want[i] = (n, at), n
    assert out == want
    end = max(r[1] for r in rows) - timedelta(hours=1)
    assert state_rows(spark, state) == {k for k, (_, at) in held.items() if at + timedelta(hours=10) > end}
