"""Splits by stable hashes: player-cold, game-cold, train."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.scalars import hash_share
from matchlake.sources.scratch import materialise


def places_by(df: DataFrame, key: str, digest: Column) -> DataFrame:
    """key, place: 0-based place in the order of a hexadecimal digest, then the key. Places are cell offsets plus a rank
    within the cell of the digest's first 12 bits, so the order is global but no task sorts everything."""
    keys = df.withColumn("_h", digest).withColumn("_cell", F.conv(F.left("_h", F.lit(3)), 16, 10).cast("int"))
    sizes = keys.groupBy("_cell").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy("_h", key)) - 1
    return keys.withColumn("_rank", rank).join(F.broadcast(sizes.select("_cell", "_before")), "_cell").select(key, (F.col("_rank") + F.col("_before")).alias("place"))


def rank_players(pairs: DataFrame, player: str) -> DataFrame:
    """player, place: 0-based place by SHA-1, then key."""
    keys = pairs.select(player).filter(F.col(player).isNotNull()).distinct()
    return places_by(keys, player, F.sha1(F.encode(F.col(player).cast("string"), "UTF-8")))


def player_cold(pairs: DataFrame, games: DataFrame, player: str, game: str, fraction: float, tolerance: float = 0.1) -> tuple[DataFrame, DataFrame, int]:
    """Players and games of the player-cold holdout, and the number k of players (C17).

    The first k players by hash are taken and with them all their games. k grows by half, from a twentieth of the
    target, until the games reach the target; beyond the tolerance it shrinks one by one while they still do.
    Closed form: a game enters with the smallest place among its players, so the number of games within
    the first k players is a count over places, and the loop runs over a few such counts on the driver.
    """
    total = games.select(game).count()
    places = materialise(rank_players(pairs, player), "places")  # each step below is a scan of a small table
    n_players = places.count()
    if not total or not n_players:
        return places.select(player).limit(0), games.select(game).limit(0), 0
    target, upper = int(total * fraction), int(total * fraction * (1 + tolerance))
    first = materialise(pairs.select(player, game).join(places, player).groupBy(game).agg(F.min("place").alias("place")), "first")

    def held(ks: list[int]) -> list[int]:
        """Games within the first k players, for each k, in one pass."""
        row = first.agg(*(F.count_if(F.col("place") < k).alias(f"k{i}") for i, k in enumerate(ks))).first()
        return list(row)

    steps = [max(1, target // 20)]
    while steps[-1] <= n_players:
        steps.append(max(steps[-1] + 1, int(steps[-1] * 1.5)))
    grown = [*(k for k in steps if k <= n_players), n_players]
    sizes = held(grown)
    at = next((i for i, n in enumerate(sizes) if n >= target), len(grown) - 1)
    chosen, size = grown[at], sizes[at]
    if size > upper:
        low, high = 0, chosen  # the smallest k that still reaches the target, at least 1
        while low + 1 < high:
            tries = sorted({low + (high - low) * i // 64 for i in range(1, 64)} - {low, high})
            reach = dict(zip(tries, held(tries), strict=True))
            high = min((k for k, n in reach.items() if n >= target), default=high)
            low = max((k for k in tries if k < high), default=low)
        chosen = high
    return places.filter(F.col("place") < chosen).select(player), first.filter(F.col("place") < chosen).select(game), chosen


def game_cold(games: DataFrame, taken: DataFrame, game: str, fraction: float) -> DataFrame:
    """Games outside the player-cold set whose hash share is under the fraction."""
    rest = games.select(game).join(taken.select(game), game, "left_anti")
    return rest.filter(hash_share(F.col(game).cast("string")) < fraction)


def train(games: DataFrame, *holdouts: DataFrame, game: str) -> DataFrame:
    """Games in no holdout."""
    for held in holdouts:
        games = games.join(held.select(game), game, "left_anti")
    return games
