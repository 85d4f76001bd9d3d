"""Schemas of the match telemetry: relational tables and the nested documents they come from."""

from __future__ import annotations

from pyspark.sql.types import StructType

DDL = {
    "games": "match_id STRING, patch STRING, queue_id INT, game_duration_s INT, winning_team INT, created_at BIGINT",
    "players": "puuid STRING, riot_id STRING, rank_tier STRING, rank_division STRING, lp INT, last_updated BIGINT",
    "frames": "match_id STRING, participant_slot INT, puuid STRING, team_id INT, role STRING, timestamp_ms BIGINT, current_gold INT, total_gold INT, xp INT, level INT, cs INT, jungle_cs INT, pos_x INT, pos_y INT, kills INT, deaths INT, assists INT, ward_count INT, item_ids ARRAY<INT>",
    "events": "match_id STRING, timestamp_ms BIGINT, event_type STRING, participant_id INT, killer_id INT, victim_id INT, killer_team INT, team_id INT, position_x INT, position_y INT, details STRING",
    "player_match_stats": "puuid STRING, match_id STRING, team_id INT, role STRING, created_at BIGINT, winning_team INT, window_10_rows INT, kda_10_sum DOUBLE, cs_10_sum DOUBLE, total_gold_10_sum DOUBLE, ward_count_10_sum DOUBLE",
    "concepts": "concept_id STRING, name STRING, explanation STRING, feature_key STRING, importance DOUBLE, game_phase STRING, category STRING",
    "key_moments": "match_id STRING, timestamp_ms BIGINT, concept_id STRING, team_id INT, description STRING, impact_score DOUBLE",
    "player_progress": "puuid STRING, concept_id STRING, times_seen INT, times_correct INT, last_seen BIGINT",
    "raw_matches": "match_id STRING, match_json BINARY, timeline_json BINARY, stored_at BIGINT",
    "waitlist_signups": "email STRING, source STRING, created_at STRING, updated_at STRING, submissions INT",
}

MATCH = (
    "metadata STRUCT<matchId: STRING, participants: ARRAY<STRING>>, "
    "info STRUCT<gameVersion: STRING, queueId: INT, gameDuration: INT, gameCreation: BIGINT, platformId: STRING, "
    "participants: ARRAY<STRUCT<participantId: INT, puuid: STRING, teamId: INT, teamPosition: STRING, win: BOOLEAN, championId: INT, riotIdGameName: STRING, riotIdTagline: STRING>>>"
)
EVENT = (
    "STRUCT<type: STRING, timestamp: BIGINT, participantId: INT, creatorId: INT, killerId: INT, victimId: INT, killerTeamId: INT, teamId: INT, "
    "assistingParticipantIds: ARRAY<INT>, position: STRUCT<x: INT, y: INT>, itemId: INT, beforeId: INT, afterId: INT, skillSlot: INT, "
    "monsterType: STRING, monsterSubType: STRING, buildingType: STRING, laneType: STRING, towerType: STRING, wardType: STRING>"
)
STATS = "STRUCT<currentGold: INT, totalGold: INT, xp: INT, level: INT, minionsKilled: INT, jungleMinionsKilled: INT, position: STRUCT<x: INT, y: INT>>"
TIMELINE = f"metadata STRUCT<matchId: STRING>, info STRUCT<frameInterval: BIGINT, frames: ARRAY<STRUCT<timestamp: BIGINT, events: ARRAY<{EVENT}>, participantFrames: MAP<STRING, {STATS}>>>>"


def table(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])


def lock(schema: StructType) -> str:
    """A schema as sorted JSON text, to hold against a stored one."""
    import json

    return json.dumps(schema.jsonValue(), sort_keys=True, indent=1)


def drift(schema: StructType, locked: str) -> list[str]:
    """Names of fields that differ from a locked schema, in either direction."""
    import json

    now, then = ({f["name"]: f for f in s["fields"]} for s in (schema.jsonValue(), json.loads(locked)))
    return sorted(n for n in now.keys() | then.keys() if now.get(n) != then.get(n))
