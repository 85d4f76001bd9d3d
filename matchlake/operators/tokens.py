"""Event tokens: extraction, inferred decisions, ordered streams, anchor samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.scalars import in_range_or_zero, lookup, lookup_any_case, shifted_label
from matchlake.operators.temporal import asof_backward, so_far

#: Kinds of tokens and their ids: the anchor, padding, then events and inferred decisions. Fixed values.
ANCHOR, PAD = 0, 1
KINDS = {
    "CHAMPION_KILL": 8,
    "BUILDING_KILL": 9,
    "ELITE_MONSTER_KILL": 10,
    "CHAMPION_SPECIAL_KILL": 11,
    "ITEM_PURCHASED": 12,
    "SKILL_LEVEL_UP": 13,
    "WARD_PLACED": 14,
    "WARD_KILL": 15,
    "RECALL": 16,
    "ENGAGE": 17,
    "DISENGAGE": 18,
}
KILLER_KINDS = ("CHAMPION_KILL", "BUILDING_KILL", "ELITE_MONSTER_KILL", "CHAMPION_SPECIAL_KILL")
#: Decisions, in the order of their labels; 6 is none. Fixed values.
DECISIONS = ("ITEM_PURCHASED", "SKILL_LEVEL_UP", "WARD_PLACED", "RECALL", "ENGAGE", "DISENGAGE")
#: Payload dictionaries: null is 0, anything unknown 1. Fixed values.
MONSTERS = {"NONE": 0, "UNKNOWN": 1, "DRAGON": 2, "BARON_NASHOR": 3, "RIFTHERALD": 4, "HORDE": 5, "ATAKHAN": 6}
SUBTYPES = {
    "NONE": 0,
    "UNKNOWN": 1,
    "AIR_DRAGON": 2,
    "CHEMTECH_DRAGON": 3,
    "EARTH_DRAGON": 4,
    "FIRE_DRAGON": 5,
    "HEXTECH_DRAGON": 6,
    "WATER_DRAGON": 7,
    "ELDER_DRAGON": 8,
    "RIFTHERALD": 9,
    "BARON_NASHOR": 10,
    "HORDE": 11,
    "ATAKHAN": 12,
}
BUILDINGS = {"NONE": 0, "UNKNOWN": 1, "TOWER_BUILDING": 2, "INHIBITOR_BUILDING": 3, "NEXUS_BUILDING": 4}
LANES = {"NONE": 0, "UNKNOWN": 1, "TOP_LANE": 2, "MID_LANE": 3, "BOT_LANE": 4}
TOWERS = {"NONE": 0, "UNKNOWN": 1, "OUTER_TURRET": 2, "INNER_TURRET": 3, "BASE_TURRET": 4, "NEXUS_TURRET": 5}
WARDS = {"NONE": 0, "UNKNOWN": 1, "YELLOW_TRINKET": 2, "CONTROL_WARD": 3, "BLUE_TRINKET": 4, "SIGHT_WARD": 5, "UNDEFINED": 6}
PAYLOADS = ("item_id", "skill_slot", "monster_type_id", "monster_subtype_id", "building_type_id", "lane_type_id", "tower_type_id", "ward_type_id")
#: Scales of a participant's frame and of the macro state, in the order of their columns. Fixed values.
FRAME_SCALE = {"total_gold": 5000.0, "current_gold": 3000.0, "xp": 5000.0, "level": 18.0, "cs": 200.0, "jungle_cs": 120.0, "kills": 20.0, "deaths": 20.0, "assists": 30.0, "pos_x": 15000.0, "pos_y": 15000.0}
MACRO_SCALE = {
    "gold_diff": 25000.0,
    "xp_diff": 25000.0,
    "kill_diff": 30.0,
    "tower_diff": 11.0,
    "plate_diff": 15.0,
    "dragon_diff": 6.0,
    "baron_diff": 3.0,
    "herald_diff": 3.0,
    "grub_diff": 10.0,
    "blue_dragon_count": 6.0,
    "red_dragon_count": 6.0,
    "baron_present": 1.0,
    "blue_centroid_x": 15000.0,
    "blue_centroid_y": 15000.0,
    "blue_spread": 8000.0,
    "red_centroid_x": 15000.0,
    "red_centroid_y": 15000.0,
    "red_spread": 8000.0,
}
#: Fountains, their radius, the radius of a fight, and how long before a kill it began. Fixed values.
FOUNTAINS = {100: (400, 400), 200: (14300, 14300)}
FOUNTAIN_RADIUS, FIGHT_RADIUS, LOOKBACK_MS = 1500, 2500, 15_000


def event_tokens(events: DataFrame, fix_ward_actor: bool = False) -> DataFrame:
    """match_id, timestamp_ms, kind_id, actor, target and payload ids of the events that have an actor in 1 to 10 (C11).

    Ward events name no participant, so they fall out, unless fix_ward_actor reads their creator or killer.
    """
    kind = F.col("event_type")
    of = lambda name: F.get_json_object("details", f"$.{name}")
    actor = F.when(kind.isin(*KILLER_KINDS), F.col("killer_id")).otherwise(F.col("participant_id"))
    if fix_ward_actor:
        actor = F.when(kind == "WARD_PLACED", F.coalesce(actor, of("creatorId").try_cast("int"))).when(kind == "WARD_KILL", F.coalesce(actor, F.col("killer_id"), of("killerId").try_cast("int"))).otherwise(actor)
    ward = kind.isin("WARD_PLACED", "WARD_KILL")
    payloads = {
        "item_id": (kind == "ITEM_PURCHASED", in_range_or_zero(of("itemId").try_cast("int"), 0, 10_000)),
        "skill_slot": (kind == "SKILL_LEVEL_UP", in_range_or_zero(of("skillSlot").try_cast("int"), 0, 4)),
        "monster_type_id": (kind == "ELITE_MONSTER_KILL", lookup_any_case(of("monsterType"), MONSTERS)),
        "monster_subtype_id": (kind == "ELITE_MONSTER_KILL", lookup_any_case(F.coalesce(F.nullif(of("monsterSubType"), F.lit("")), of("monsterType")), SUBTYPES)),
        "building_type_id": (kind == "BUILDING_KILL", lookup_any_case(of("buildingType"), BUILDINGS)),
        "lane_type_id": (kind == "BUILDING_KILL", lookup_any_case(of("laneType"), LANES)),
        "tower_type_id": (kind == "BUILDING_KILL", lookup_any_case(of("towerType"), TOWERS)),
        "ward_type_id": (ward, lookup_any_case(of("wardType"), WARDS)),
    }
    rows = events.filter(kind.isin(*list(KINDS)[:8]))
    target = F.when(kind == "CHAMPION_KILL", F.coalesce("victim_id", F.lit(0))).otherwise(0)
    rows = rows.select("match_id", "timestamp_ms", lookup(kind, KINDS).alias("kind_id"), actor.alias("actor"), target.alias("target"), *(F.coalesce(F.when(when, value), F.lit(0)).alias(n) for n, (when, value) in payloads.items()))
    return rows.filter(F.col("actor").between(1, 10))


def _bare(df: DataFrame, kind, actor) -> DataFrame:
    return df.select("match_id", "timestamp_ms", kind.alias("kind_id"), actor.alias("actor"), F.lit(0).alias("target"), *(F.lit(0).alias(p) for p in PAYLOADS))


def recalls(frames: DataFrame) -> DataFrame:
    """A token where a player is inside the own fountain and was outside it in the frame before."""
    home = lambda axis: F.when(F.col("team_id") == 100, FOUNTAINS[100][axis]).otherwise(FOUNTAINS[200][axis])
    dx, dy = F.col("pos_x") - home(0), F.col("pos_y") - home(1)
    inside = dx * dx + dy * dy <= FOUNTAIN_RADIUS * FOUNTAIN_RADIUS
    over = Window.partitionBy("match_id", "participant_slot").orderBy("timestamp_ms")
    rows = frames.withColumn("_in", inside).withColumn("_was", F.lag("_in").over(over)).filter("_in AND NOT _was")
    return _bare(rows, F.lit(KINDS["RECALL"]), F.col("participant_slot"))


def engages(frames: DataFrame, events: DataFrame) -> DataFrame:
    """Fight tokens at the time of a kill of the other team.

    Players are counted near the kill's place in the last frame 15 s or more before it: three attackers and two
    defenders make an engagement of the killer's team; more defenders than attackers also a disengagement of
    the other team. One a kind, team and time; the team's first slot is the actor.
    """
    killer, victim = F.when(F.col("killer_id") <= 5, 100).otherwise(200), F.when(F.col("victim_id") <= 5, 100).otherwise(200)
    kills = events.filter((F.col("event_type") == "CHAMPION_KILL") & F.col("position_x").isNotNull() & F.col("killer_id").between(1, 10) & F.col("victim_id").between(1, 10) & (killer != victim))
    kills = kills.select("match_id", "timestamp_ms", killer.alias("_team"), "position_x", "position_y").distinct()
    spots = frames.select("match_id", F.col("timestamp_ms").alias("_ts")).distinct()
    at = asof_backward(kills, spots, ["match_id"], "timestamp_ms", "_ts", ["_ts"], offset=LOOKBACK_MS).filter(F.col("_ts").isNotNull())
    near = at.join(frames.select("match_id", F.col("timestamp_ms").alias("_ts"), "team_id", "pos_x", "pos_y"), ["match_id", "_ts"])
    dx, dy = F.col("pos_x") - F.col("position_x"), F.col("pos_y") - F.col("position_y")
    close = dx * dx + dy * dy <= FIGHT_RADIUS * FIGHT_RADIUS
    counts = near.groupBy(*at.columns).agg(F.count_if(close & (F.col("team_id") == F.col("_team"))).alias("attackers"), F.count_if(close & (F.col("team_id") == 300 - F.col("_team"))).alias("defenders")).filter("attackers >= 3 AND defenders >= 2")
    slot = lambda team: F.when(team == 100, 1).otherwise(6)
    engaged = _bare(counts, F.lit(KINDS["ENGAGE"]), slot(F.col("_team")))
    left = _bare(counts.filter("defenders > attackers"), F.lit(KINDS["DISENGAGE"]), slot(300 - F.col("_team")))
    return engaged.unionByName(left).distinct()


def token_stream(frames: DataFrame, events: DataFrame, fix_ward_actor: bool = False) -> DataFrame:
    """Anchors, event tokens and decisions with their place in the stream: by time, anchors first, then kind."""
    anchors = _bare(frames.select("match_id", "timestamp_ms").distinct(), F.lit(ANCHOR), F.lit(0))
    rows = anchors.unionByName(event_tokens(events, fix_ward_actor)).unionByName(recalls(frames)).unionByName(engages(frames, events))
    over = Window.partitionBy("match_id").orderBy("timestamp_ms", "kind_id", "actor", "target", *PAYLOADS)
    return rows.withColumn("pos", F.row_number().over(over) - 1)


def anchor_labels(tokens: DataFrame) -> DataFrame:
    """A row for each anchor but a match's last: first next kind (0 none) and the set of kinds before the next anchor."""
    over = Window.partitionBy("match_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = tokens.withColumn("anchor", F.count_if(F.col("kind_id") == ANCHOR).over(over))
    rows = rows.withColumn("_last", F.max("anchor").over(Window.partitionBy("match_id"))).filter("anchor > 0 AND anchor < _last")
    event = F.col("kind_id") >= min(KINDS.values())
    return rows.groupBy("match_id", "anchor").agg(
        F.min(F.when(~event, F.col("timestamp_ms"))).alias("timestamp_ms"),
        F.coalesce(shifted_label(F.min_by(F.when(event, F.col("kind_id")), F.when(event, F.col("pos")))), F.lit(0)).alias("next_label"),
        F.array_sort(F.collect_set(F.when(event, F.col("kind_id")))).alias("kinds"),
    )


def decision_labels(tokens: DataFrame) -> DataFrame:
    """The last decision of each actor before the next anchor, 6 where an actor of the match has none."""
    over = Window.partitionBy("match_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = tokens.withColumn("anchor", F.count_if(F.col("kind_id") == ANCHOR).over(over)).filter("anchor > 0")
    made = lookup(F.col("kind_id"), {KINDS[d]: k for k, d in enumerate(DECISIONS)})
    rows = rows.withColumn("decision", made)
    last = rows.filter("decision IS NOT NULL AND actor BETWEEN 1 AND 10").groupBy("match_id", "anchor", "actor").agg(F.max_by("decision", "pos").alias("decision"))
    every = rows.select("match_id", "anchor").distinct().withColumn("actor", F.explode(F.sequence(F.lit(1), F.lit(10))))
    return every.join(last, ["match_id", "anchor", "actor"], "left").withColumn("decision", F.coalesce("decision", F.lit(len(DECISIONS))))


def frame_tensor(frames: DataFrame, stats: list[str], slots: int = 10, scale: dict[str, float] | None = None) -> DataFrame:
    """One array a match and time: stats by slot, a missing slot 0, and the minute last (C14, C20)."""
    value = lambda c: F.col(c).cast("double") / (scale or {}).get(c, 1.0)
    rows = frames.filter(F.col("participant_slot").between(1, slots)).groupBy("match_id", "timestamp_ms").agg(*(F.max(F.when(F.col("participant_slot") == s, value(c))).alias(f"{c}_{s}") for s in range(1, slots + 1) for c in stats))
    cells = [F.coalesce(F.col(f"{c}_{s}"), F.lit(0.0)) for s in range(1, slots + 1) for c in stats]
    return rows.select("match_id", "timestamp_ms", F.array(*cells, F.col("timestamp_ms") / 60000.0).alias("vector"))


def macro_state(frames: DataFrame, events: DataFrame) -> DataFrame:
    """The scaled macro columns at each frame time (C14). Any team but 100 is red; teams and kinds that a column
    lacks come from the details; objectives taken up to and at the time count."""
    of = lambda name: F.get_json_object("details", f"$.{name}")
    kind, known = F.col("event_type"), lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit(0)), of(b).try_cast("int"))
    lost = known("team_id", "teamId")
    monster = {"dragon": "DRAGON", "baron": "BARON_NASHOR", "herald": "RIFTHERALD", "grub": "HORDE"}
    tower = (kind == "BUILDING_KILL") & (F.upper(of("buildingType")) == "TOWER_BUILDING")
    plate = kind == "TURRET_PLATE_DESTROYED"
    scorer = F.when(kind == "ELITE_MONSTER_KILL", known("killer_team", "killerTeamId")).when(tower | plate, F.when(lost == 100, 200).when(lost == 200, 100))
    counted = {n: (kind == "ELITE_MONSTER_KILL") & (F.upper(of("monsterType")) == m) for n, m in monster.items()} | {"tower": tower, "plate": plate}
    marks = events.select("match_id", "timestamp_ms", scorer.alias("_side"), *(F.coalesce(c.cast("int"), F.lit(0)).alias(n) for n, c in counted.items())).filter(F.col("_side").isin(100, 200))
    blue = F.col("team_id") == 100
    sums = [F.sum(F.when(blue, F.col(c)).otherwise(-F.col(c))).alias(f"{n}_diff") for n, c in (("gold", "total_gold"), ("xp", "xp"), ("kill", "kills"))]
    spots = [x for side, cond in (("blue", blue), ("red", ~blue)) for x in (F.avg(F.when(cond, F.col("pos_x"))).alias(f"{side}_centroid_x"), F.avg(F.when(cond, F.col("pos_y"))).alias(f"{side}_centroid_y"), F.sqrt(F.var_pop(F.when(cond, F.col("pos_x"))) + F.var_pop(F.when(cond, F.col("pos_y")))).alias(f"{side}_spread"))]
    at = frames.groupBy("match_id", "timestamp_ms").agg(*sums, *spots).withColumn("_frame", F.lit(True))
    over = so_far(["match_id"], "timestamp_ms")
    side = lambda n, team: F.coalesce(F.sum(F.when(F.col("_side") == team, F.col(n))).over(over), F.lit(0))
    both = at.unionByName(marks, allowMissingColumns=True)
    rows = both.withColumns({f"{n}_diff": side(n, 100) - side(n, 200) for n in counted} | {"blue_dragon_count": side("dragon", 100), "red_dragon_count": side("dragon", 200), "baron_present": F.when(side("baron", 100) + side("baron", 200) > 0, 1.0).otherwise(0.0)})
    return rows.filter("_frame").select("match_id", "timestamp_ms", *((F.coalesce(F.col(c), F.lit(0)) / s).alias(c) for c, s in MACRO_SCALE.items()))


def causal_rows(tokens: DataFrame, outcome: DataFrame, kind: int) -> DataFrame:
    """Two rows an anchor window with an event, one a team: treated if the team has the kind in it."""
    over = Window.partitionBy("match_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = tokens.withColumn("anchor", F.count_if(F.col("kind_id") == ANCHOR).over(over)).filter((F.col("anchor") > 0) & (F.col("kind_id") != ANCHOR))
    of = lambda low, high: F.max(F.when((F.col("kind_id") == kind) & F.col("actor").between(low, high), 1).otherwise(0))
    per = rows.groupBy("match_id", "anchor").agg(of(1, 5).alias("blue"), of(6, 10).alias("red")).join(outcome, "match_id")
    sides = F.explode(F.array(F.struct(F.lit(100).alias("team_id"), F.col("blue").alias("treated"), F.col("blue_win").alias("won")), F.struct(F.lit(200).alias("team_id"), F.col("red").alias("treated"), (1 - F.col("blue_win")).alias("won"))))
    return per.select("match_id", "anchor", sides.alias("s")).select("match_id", "anchor", "s.*")


def padded(tokens: DataFrame, length: int, pad: int = PAD) -> DataFrame:
    """Kinds of each match as one array of a given length, padded or cut, and the true length.

    Collecting is bounded: the length-first tokens of a match are selected before.
    """
    rows = tokens.filter(F.col("pos") < length).groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("pos", "kind_id"))).alias("t"))
    kinds = F.transform("t", lambda t: t["kind_id"])
    return rows.select("match_id", F.concat(kinds, F.array_repeat(F.lit(pad), F.lit(length) - F.size("t"))).alias("kinds"), F.size("t").alias("n"))


def flat_batch(tokens: DataFrame) -> DataFrame:
    """The kinds of each match without padding, and where they begin in the batch that all matches make, in order of their ids.

    A batch is what one training step holds; begins and n are its row index.
    """
    rows = tokens.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("pos", "kind_id"))).alias("t"))
    rows = rows.select("match_id", F.size("t").cast("long").alias("n"), F.transform("t", lambda t: t["kind_id"]).alias("kinds"))
    before = F.sum("n").over(Window.orderBy("match_id").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("begins", F.coalesce(before, F.lit(0)))
