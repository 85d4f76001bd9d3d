"""Review queries over the telemetry tables: search, player review, game review."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.operators.topk import per_group


def search(df: DataFrame, name: str, text: str, columns: list[str], tie: str, n: int = 20) -> DataFrame:
    """The first n rows whose name holds the text, whatever its case; % and _ keep their meaning."""
    return df.filter(F.col(name).ilike(f"%{text}%")).orderBy(name, tie).limit(n).select(*columns)


def search_players(players: DataFrame, text: str) -> DataFrame:
    return search(players, "riot_id", text, ["puuid", "riot_id", "rank_tier", "rank_division", "lp"], "puuid")


def recent_games(frames: DataFrame, games: DataFrame, puuid: str, n: int = 20) -> DataFrame:
    """The player's newest games with team and role."""
    rows = frames.filter(F.col("puuid") == puuid).select("match_id", "team_id", "role").distinct().join(games, "match_id")
    return rows.select("match_id", "team_id", "role", "patch", "game_duration_s", "winning_team", "created_at").orderBy(F.desc("created_at"), "match_id").limit(n)


def player_review(frames: DataFrame, games: DataFrame, moments: DataFrame, concepts: DataFrame, puuid: str) -> tuple[DataFrame, DataFrame]:
    """The recent games, each with its five largest moments of the player's team; and the five weightiest concepts.

    The second counts moments times the player's frames of that match, as the stored queries do (J3).
    """
    mine = recent_games(frames, games, puuid)
    known = moments.join(concepts.select("concept_id", F.col("name").alias("concept_name"), "importance", "category"), "concept_id")
    top = per_group(known, ["match_id", "team_id"], [F.desc("impact_score"), "timestamp_ms", "concept_id"], 5)
    nested = top.groupBy("match_id", "team_id").agg(F.array_sort(F.collect_list(F.struct("rank", "timestamp_ms", "concept_id", "concept_name", "description", "impact_score"))).alias("moments"))
    own = frames.filter(F.col("puuid") == puuid).select("match_id", "team_id")
    weights = known.join(own, ["match_id", "team_id"]).groupBy("concept_id", "concept_name", "importance").agg(F.count("*").alias("n"))
    weights = weights.withColumn("weight", F.col("importance") * F.col("n")).orderBy(F.desc("weight"), "concept_id").limit(5)
    return mine.join(nested, ["match_id", "team_id"], "left"), weights


def game_review(games: DataFrame, frames: DataFrame, events: DataFrame, moments: DataFrame, concepts: DataFrame, match_id: str) -> DataFrame:
    """One row: the game, its frames, large events and moments as ordered arrays."""
    game = games.filter(F.col("match_id") == match_id)
    of = lambda df: df.filter(F.col("match_id") == match_id)
    rows = of(frames).groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("timestamp_ms", "participant_slot", "team_id", "total_gold", "cs", "kills", "deaths", "assists", "pos_x", "pos_y"))).alias("frames"))
    big = of(events).filter(F.col("event_type").isin("CHAMPION_KILL", "ELITE_MONSTER_KILL", "BUILDING_KILL")).groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("timestamp_ms", "event_type", "killer_id", "victim_id", "team_id"))).alias("events"))
    told = of(moments).join(concepts.select("concept_id", F.col("name").alias("concept_name")), "concept_id").groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("timestamp_ms", "concept_id", "team_id", "concept_name", "description", "impact_score"))).alias("moments"))
    return game.join(rows, "match_id", "left").join(big, "match_id", "left").join(told, "match_id", "left")


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def dispatch(tables: dict[str, DataFrame], request: dict) -> object:
    """The answer to a request, for one player or one match, as plain values; any other action is an error object."""
    action = request.get("action")
    if action == "search":
        return _rows(search_players(tables["players"], request["query"]))
    if action == "review":
        return _player_answer(tables, request["puuid"])
    if action == "game":
        return _game_answer(tables, request["match_id"], request["puuid"])
    return {"error": f"Unknown action: {action}"}


def reply(tables: dict[str, DataFrame], request: dict) -> str:
    """dispatch() as JSON text; what JSON lacks is a string."""
    return json.dumps(dispatch(tables, request), default=str)


def _player_answer(tables: dict[str, DataFrame], puuid: str) -> dict:
    who = tables["players"].filter(F.col("puuid") == puuid).first()
    if who is None:
        return {"error": "Player not found"}
    mine, weights = player_review(tables["frames"], tables["games"], tables["key_moments"], tables["concepts"], puuid)
    recent = [r | {"won": r["winning_team"] == r["team_id"], "moments": r["moments"] or []} for r in _rows(mine.orderBy(F.desc("created_at"), "match_id"))]
    return {"player": who.asDict(), "games": recent, "concepts": _rows(weights)}


def _game_answer(tables: dict[str, DataFrame], match_id: str, puuid: str) -> dict:
    own = tables["frames"].filter((F.col("match_id") == match_id) & (F.col("puuid") == puuid)).select("team_id", "role").first()
    found = game_review(tables["games"], tables["frames"], tables["events"], tables["key_moments"], tables["concepts"], match_id).first()
    if own is None or found is None:
        return {"error": "Game not found"}
    row = found.asDict(recursive=True)
    parts = {n: row.pop(n) or [] for n in ("moments", "frames", "events")}
    mine = [m for m in parts["moments"] if m["team_id"] == own.team_id]
    return {"game": row, "won": row["winning_team"] == own.team_id, "team_id": own.team_id, "role": own.role, "moments": mine, "frames": parts["frames"], "objectives": parts["events"]}
