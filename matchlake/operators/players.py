"""Player roll-ups: one row a player and match, and vectors under a causal cutoff."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.functions.scalars import tier_number

WINDOW_MS = (540_000, 660_000)
#: Roles in the order of their features. Fixed values.
ROLES = ("TOP", "JGL", "MID", "BOT", "SUP")


def match_rollup(frames: DataFrame, games: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Sums over the frames from minute 9 to 11, for the matches that done lacks; games without a row fall out."""
    rows = frames.filter(F.col("participant_slot").between(1, 10))
    if done is not None:
        rows = rows.join(done.select("match_id").distinct(), "match_id", "left_anti")
    inside = F.col("timestamp_ms").between(*WINDOW_MS)
    # a null in either argument makes SQLite's scalar MAX null
    deaths = F.when(F.col("deaths").isNotNull(), F.greatest("deaths", F.lit(1)))
    total = lambda c, name: F.sum(F.when(inside, c).otherwise(0.0)).alias(name)
    agg = rows.groupBy("puuid", "match_id").agg(
        F.min("team_id").alias("team_id"),
        F.min("role").alias("role"),
        F.sum(F.when(inside, 1).otherwise(0)).alias("window_10_rows"),
        total((F.col("kills") + F.col("assists")) * 1.0 / deaths, "kda_10_sum"),
        total(F.col("cs"), "cs_10_sum"),
        total(F.col("total_gold"), "total_gold_10_sum"),
        total(F.col("ward_count"), "ward_count_10_sum"),
    )
    return agg.join(games.select("match_id", "created_at", "winning_team"), "match_id")


def causal_cutoff(stats: DataFrame, excluded: DataFrame) -> DataFrame:
    """puuid, cutoff: the player's earliest excluded match."""
    return stats.join(excluded.select("match_id").distinct(), "match_id", "left_semi").groupBy("puuid").agg(F.min("created_at").alias("cutoff"))


def before_cutoff(stats: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The rows of players without a cutoff, and the others' rows before it."""
    rows = stats.join(cutoffs, "puuid", "left")
    return rows.filter(F.col("cutoff").isNull() | (F.col("created_at") < F.col("cutoff"))).drop("cutoff")


def player_vectors(players: DataFrame, stats: DataFrame, excluded: DataFrame) -> DataFrame:
    """puuid and 16 features, from matches before the cutoff only; rank columns are as of now.

    0 tier, 1 points, 2 log games, 3 win rate, 4 kda, 5 cs, 6 gold, 8 wards, 10 to 14 role shares; the rest is 0.
    """
    seen = before_cutoff(stats, causal_cutoff(stats, excluded))
    agg = seen.groupBy("puuid").agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("team_id") == F.col("winning_team"), 1).otherwise(0)).alias("wins"),
        *(F.sum(c).alias(c) for c in ("window_10_rows", "kda_10_sum", "cs_10_sum", "total_gold_10_sum", "ward_count_10_sum")),
        *(F.count_if(F.col("role") == r).alias(f"role_{r}") for r in ROLES),
        F.count("*").alias("n_roles"),
    )
    rows = players.select("puuid", "rank_tier", "lp").join(agg, "puuid", "left")
    mean = lambda c: F.when(F.col("window_10_rows") > 0, F.col(c) / F.col("window_10_rows"))
    parts = [
        tier_number(F.col("rank_tier")).cast("double"),
        F.when(F.col("lp").isNotNull(), F.least(F.col("lp") / 1000.0, F.lit(2.0))),  # least() would pass over a null
        F.log1p(F.coalesce("n", F.lit(0))),
        F.when(F.col("n") > 0, F.col("wins") / F.col("n")),
        mean("kda_10_sum"),
        mean("cs_10_sum"),
        mean("total_gold_10_sum"),
        F.lit(0.0),
        mean("ward_count_10_sum"),
        F.lit(0.0),
        *(F.when(F.col("n_roles") > 0, F.col(f"role_{r}") / F.col("n_roles")) for r in ROLES),
        F.lit(0.0),
    ]
    return rows.select("puuid", F.array(*(F.coalesce(p, F.lit(0.0)) for p in parts)).alias("vector"))
