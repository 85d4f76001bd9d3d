"""Nested match and timeline documents flattened to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlake import schemas
from matchlake.functions.scalars import inventory, lookup, major_minor

#: What a participant's position is called in the tables. Fixed values.
ROLES = {"TOP": "TOP", "JUNGLE": "JGL", "MIDDLE": "MID", "BOTTOM": "BOT", "UTILITY": "SUP", "": "UNK"}
#: Event fields that columns hold, so that details does not; team ids are in both. Fixed values.
IN_COLUMNS = ("type", "timestamp", "position", "participantId", "killerId", "victimId")


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MATCH).json(path)


def read_timelines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TIMELINE).json(path)


def live_patch(matches: DataFrame, patch: str) -> DataFrame:
    """Matches of one major.minor version, before anything is written."""
    return matches.filter(major_minor(F.col("info.gameVersion")) == patch)


def games(matches: DataFrame) -> DataFrame:
    won = F.filter("info.participants", lambda p: p["win"])
    return matches.select(
        F.col("metadata.matchId").alias("match_id"),
        F.coalesce("info.gameVersion", F.lit("")).alias("patch"),
        F.col("info.queueId").alias("queue_id"),
        F.col("info.gameDuration").alias("game_duration_s"),
        F.coalesce(F.get(won, 0)["teamId"], F.lit(0)).alias("winning_team"),
        F.col("info.gameCreation").alias("created_at"),
    )


def participants(matches: DataFrame) -> DataFrame:
    """match_id, participant_slot, puuid, team_id, role, riot_id: the first ten of each match."""
    rows = matches.select(F.col("metadata.matchId").alias("match_id"), F.explode(F.slice("info.participants", 1, 10)).alias("p"))
    name, tag = F.col("p.riotIdGameName"), F.col("p.riotIdTagline")
    return rows.select("match_id", F.col("p.participantId").alias("participant_slot"), F.col("p.puuid").alias("puuid"), F.col("p.teamId").alias("team_id"), lookup(F.coalesce(F.col("p.teamPosition"), F.lit("")), ROLES, "UNK").alias("role"), F.when(name.isNotNull() & (name != ""), F.concat_ws("#", name, tag)).alias("riot_id"))


def _frames(timelines: DataFrame) -> DataFrame:
    return timelines.select(F.col("metadata.matchId").alias("match_id"), F.posexplode("info.frames").alias("frame_no", "frame"))


def events(timelines: DataFrame) -> DataFrame:
    """One row an event; what has no column stays in details as JSON."""
    rows = _frames(timelines).select("match_id", "frame_no", F.posexplode("frame.events").alias("place", "e"))
    fields = [f.name for f in rows.schema["e"].dataType.fields if f.name not in IN_COLUMNS]
    details = F.to_json(F.struct(*(F.col(f"e.{n}").alias(n) for n in fields)))
    return rows.select(
        "match_id",
        F.col("e.timestamp").alias("timestamp_ms"),
        F.col("e.type").alias("event_type"),
        F.col("e.participantId").alias("participant_id"),
        F.col("e.killerId").alias("killer_id"),
        F.col("e.victimId").alias("victim_id"),
        F.col("e.killerTeamId").alias("killer_team"),
        F.col("e.teamId").alias("team_id"),
        F.col("e.position.x").alias("position_x"),
        F.col("e.position.y").alias("position_y"),
        details.alias("details"),
        "frame_no",
        "place",
    )


def _tallies(timelines: DataFrame) -> DataFrame:
    """match_id, slot, frame_no and what each event of the frame adds to the slot."""
    e = _frames(timelines).select("match_id", "frame_no", F.posexplode("frame.events").alias("place", "e")).select("match_id", "frame_no", "place", "e.*")
    kill = F.col("type") == "CHAMPION_KILL"

    def part(slot: Column, when: Column, name: str) -> DataFrame:
        return e.filter(when).select("match_id", "frame_no", slot.alias("slot"), *(F.lit(int(name == n)).alias(n) for n in ("kills", "deaths", "assists", "ward_count")))

    ward = F.when(F.col("type") == "WARD_PLACED", F.col("creatorId")).when(F.col("type") == "WARD_KILL", F.col("killerId"))
    rows = part(F.col("killerId"), kill, "kills").unionByName(part(F.col("victimId"), kill, "deaths")).unionByName(part(F.explode("assistingParticipantIds"), kill, "assists")).unionByName(part(ward, F.col("type").isin("WARD_PLACED", "WARD_KILL"), "ward_count"))
    return rows.filter(F.col("slot").between(1, 10))


def _moves(timelines: DataFrame) -> DataFrame:
    """Item moves of each slot and frame in the order of events."""
    e = _frames(timelines).select("match_id", "frame_no", F.posexplode("frame.events").alias("place", "e")).select("match_id", "frame_no", "place", "e.*")
    kind = F.when(F.col("type") == "ITEM_PURCHASED", "buy").when(F.col("type").isin("ITEM_SOLD", "ITEM_DESTROYED"), "drop").when(F.col("type") == "ITEM_UNDO", "undo")
    move = F.struct("frame_no", "place", kind.alias("kind"), F.coalesce("itemId", F.lit(0)).alias("item"), F.coalesce("beforeId", F.lit(0)).alias("before"), F.coalesce("afterId", F.lit(0)).alias("after"))
    rows = e.filter(kind.isNotNull() & F.col("participantId").between(1, 10))
    return rows.groupBy("match_id", F.col("participantId").alias("slot")).agg(F.array_sort(F.collect_list(move)).alias("moves"))


def frames(matches: DataFrame, timelines: DataFrame) -> DataFrame:
    """Ten rows a frame. A frame sees every event that is bundled in it, whatever the event's own time."""
    rows = _frames(timelines).select("match_id", "frame_no", F.col("frame.timestamp").alias("timestamp_ms"), F.explode("frame.participantFrames").alias("key", "s"))
    rows = rows.select("match_id", "frame_no", "timestamp_ms", F.col("key").try_cast("int").alias("slot"), "s.*").filter(F.col("slot").between(1, 10))
    added = _tallies(timelines).groupBy("match_id", "slot", "frame_no").agg(*(F.sum(c).alias(c) for c in ("kills", "deaths", "assists", "ward_count")))
    over = Window.partitionBy("match_id", "slot").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(added, ["match_id", "slot", "frame_no"], "left")
    rows = rows.withColumns({c: F.sum(F.coalesce(c, F.lit(0))).over(over).cast("int") for c in ("kills", "deaths", "assists", "ward_count")})
    rows = rows.join(_moves(timelines), ["match_id", "slot"], "left")
    upto = F.filter("moves", lambda m: m["frame_no"] <= F.col("frame_no"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    who = participants(matches).drop("riot_id").withColumnRenamed("participant_slot", "slot")
    rows = rows.join(who, ["match_id", "slot"])
    return rows.select(
        "match_id",
        F.col("slot").alias("participant_slot"),
        "puuid",
        "team_id",
        "role",
        "timestamp_ms",
        zero("currentGold").alias("current_gold"),
        zero("totalGold").alias("total_gold"),
        zero("xp").alias("xp"),
        F.coalesce("level", F.lit(1)).alias("level"),
        zero("minionsKilled").alias("cs"),
        zero("jungleMinionsKilled").alias("jungle_cs"),
        zero("position.x").alias("pos_x"),
        zero("position.y").alias("pos_y"),
        "kills",
        "deaths",
        "assists",
        "ward_count",
        F.coalesce(inventory(upto), F.array().cast("array<int>")).alias("item_ids"),
    )
