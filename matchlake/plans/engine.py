"""Whole-corpus jobs: states, vectors, concepts and moments of all matches at once (C7), work lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.functions.scalars import route_of
from matchlake.operators import teamstate


def process_all(frames: DataFrame, events: DataFrame, games: DataFrame, discover: Callable[[DataFrame, list[str]], DataFrame] = teamstate.discover_concepts) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Feature vectors, concepts and key moments. One plan for all matches; no loop over matches."""
    vectors = teamstate.feature_vectors(teamstate.game_states(frames, events), games)
    concepts = discover(vectors, list(teamstate.LEARNED))
    return vectors, concepts, teamstate.key_moments(vectors, concepts)


def unparsed(raw: DataFrame, games: DataFrame) -> DataFrame:
    """Stored documents that no table has yet."""
    return raw.select("match_id").join(games.select("match_id"), "match_id", "left_anti")


def rank_backlog(players: DataFrame, frames: DataFrame) -> DataFrame:
    """Players without a rank, by the route of one of their matches."""
    one = frames.groupBy("puuid").agg(F.min("match_id").alias("match_id"))
    return players.filter(F.col("rank_tier").isNull()).select("puuid").join(one, "puuid").select("puuid", route_of(F.col("match_id")).alias("route"))


def seed_batch(seeds: DataFrame, running: DataFrame, seeded: DataFrame, now_s: int, cooldown_s: int = 86_400) -> DataFrame:
    """Seeds that are neither in work nor seeded within the cooldown."""
    recent = seeded.filter(F.col("seeded_at") > now_s - cooldown_s)
    return seeds.join(running.select("puuid"), "puuid", "left_anti").join(recent.select("puuid"), "puuid", "left_anti")


def recover(queue: DataFrame, running: DataFrame, score: float = 0.0) -> DataFrame:
    """The queue with everything in work put back; a key in both keeps the larger score."""
    return queue.unionByName(running.select("puuid").withColumn("score", F.lit(score))).groupBy("puuid").agg(F.max("score").alias("score"))


def pop_highest(queue: DataFrame, n: int = 1) -> DataFrame:
    """The entries a worker takes next."""
    return queue.orderBy(F.desc("score"), "puuid").limit(n)


def match_cost(frames: DataFrame, events: DataFrame) -> DataFrame:
    """Anchors and events of each match, for sizing batches."""
    anchors = frames.groupBy("match_id").agg(F.count_distinct("timestamp_ms").alias("n_anchors"))
    return anchors.join(events.groupBy("match_id").agg(F.count("*").alias("n_events")), "match_id", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))


def runtime_projection(step_s: float, steps: int, epochs: int, stop_share: float = 0.25, epoch_min: float = 180.0, total_h: float = 24.0) -> dict:
    """Minutes an epoch and hours to an early stop, against their gates."""
    epoch = step_s * steps / 60
    total = epoch * epochs * stop_share / 60
    return {"epoch_min": epoch, "early_stop_h": total, "passes": epoch <= epoch_min and total <= total_h}


def escalate(tier: int, stagnant: int, grew: bool, after: int = 3, top: int = 10) -> tuple[int, int]:
    """Tier and stagnation count after one more run: the tier rises when so many runs brought nothing."""
    if grew:
        return tier, 0
    return (min(top, tier + 1), 0) if stagnant + 1 >= after else (tier, stagnant + 1)
