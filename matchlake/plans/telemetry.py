"""Queries of the telemetry operators over match tables that arithmetic derives from the suppliers, a match each.

One dialect of expressions serves both sides: Spark reads them as they are, DuckDB with // for div.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake import schemas
from matchlake.operators import players, static, teamstate, tokens, topk, upsert
from matchlake.plans import engine, review
from matchlake.plans.registry import SQL, Tables, query
from matchlake.sources import files, matches

FRAMES, SLOTS, EVENTS = 12, 10, 24
#: Matches that one task derives, about.
MATCHES = 500

MATCH = "CASE m % 3 WHEN 0 THEN 'NA1_' WHEN 1 THEN 'KR_' ELSE 'EUW1_' END || m"
GAME = {
    "match_id": MATCH,
    "patch": "'14.' || (m % 9 + 1) || '.58'",
    "queue_id": "420",
    "game_duration_s": "1500 + m % 700",
    "winning_team": "CASE WHEN m % 3 = 0 THEN 200 ELSE 100 END",
    "created_at": "1700000000000 + m * 3600000",
}
_FAR = "(m * 523 + s * 1009 + f * 2003)"
FRAME = {
    "match_id": MATCH,
    "participant_slot": "s",
    "puuid": "'p' || ((m * 3 + s) % 37)",
    "team_id": "CASE WHEN s <= 5 THEN 100 ELSE 200 END",
    "role": "CASE s % 5 WHEN 1 THEN 'TOP' WHEN 2 THEN 'JGL' WHEN 3 THEN 'MID' WHEN 4 THEN 'BOT' ELSE 'SUP' END",
    "timestamp_ms": "f * 60000",
    "current_gold": "100 + (m * 7 + s * 13 + f * 29) % 500",
    "total_gold": "500 + f * 400 + (m * 31 + s * 17 + f * f * 11) % 900",
    "xp": "f * 350 + (m * 19 + s * 23) % 400",
    "level": "1 + f",
    "cs": "f * 7 + (m + s) % 9",
    "jungle_cs": "CASE WHEN s % 5 = 2 THEN f * 6 ELSE 0 END",
    "pos_x": f"CASE WHEN (m + s + f) % 7 = 0 THEN 400 + s WHEN (m + s + f) % 11 = 0 THEN 14200 + s WHEN f % 4 = 3 THEN 7000 + (s * 97 + m * 13) % 1500 ELSE {_FAR} % 15000 END",
    "pos_y": f"CASE WHEN (m + s + f) % 7 = 0 THEN 450 + f WHEN (m + s + f) % 11 = 0 THEN 14250 - f WHEN f % 4 = 3 THEN 7000 + (s * 89 + m * 17) % 1500 ELSE {_FAR} * 7 % 15000 END",
    "kills": "f * (1 + (m + s) % 3) div 4",
    "deaths": "f * ((m + 2 * s) % 3) div 5",
    "assists": "f * ((m + s) % 4) div 3",
    "ward_count": "f * (s % 3) div 2",
}
#: By kind: kills, buildings, monsters, special kills, purchases, skills, wards placed, wards killed.
_KIND = "(m + k) % 8"
EVENT = {
    "match_id": MATCH,
    "timestamp_ms": "(m * 37 + k * 29311) % 660000",
    "event_type": f"CASE {_KIND} WHEN 0 THEN 'CHAMPION_KILL' WHEN 1 THEN 'BUILDING_KILL' WHEN 2 THEN 'ELITE_MONSTER_KILL' WHEN 3 THEN 'CHAMPION_SPECIAL_KILL' WHEN 4 THEN 'ITEM_PURCHASED' WHEN 5 THEN 'SKILL_LEVEL_UP' WHEN 6 THEN 'WARD_PLACED' ELSE 'WARD_KILL' END",
    "participant_id": f"CASE WHEN {_KIND} IN (4, 5) THEN 1 + (m + 3 * k) % 11 END",
    "killer_id": f"CASE WHEN {_KIND} IN (0, 1, 2, 3, 7) THEN (m * 5 + k * 3) % 11 END",
    "victim_id": f"CASE WHEN {_KIND} = 0 THEN 1 + (m + k * 7) % 10 END",
    "killer_team": f"CASE WHEN {_KIND} = 2 THEN CASE WHEN (m + k div 8) % 2 = 0 THEN 100 ELSE 200 END END",
    "team_id": f"CASE WHEN {_KIND} = 1 THEN CASE WHEN (m * 3 + k div 8) % 2 = 0 THEN 100 ELSE 200 END END",
    "position_x": f"CASE WHEN {_KIND} = 0 THEN 7000 + (m + k) % 900 END",
    "position_y": f"CASE WHEN {_KIND} = 0 THEN 7000 + (m + k * 3) % 900 END",
}
#: What the details of an event say; the SQL reads it from columns, the operators from JSON.
MONSTER = f"CASE WHEN {_KIND} = 2 THEN CASE (m * 3 + k) % 4 WHEN 0 THEN 'DRAGON' WHEN 1 THEN 'BARON_NASHOR' WHEN 2 THEN 'RIFTHERALD' ELSE 'HORDE' END END"
BUILDING = f"CASE WHEN {_KIND} = 1 THEN CASE WHEN m % 3 = 0 THEN 'INHIBITOR_BUILDING' ELSE 'TOWER_BUILDING' END END"
DETAILS = f"""CASE {_KIND} WHEN 2 THEN '{{"monsterType":"' || ({MONSTER}) || '","monsterSubType":"' || CASE WHEN (m * 3 + k) % 4 = 0 THEN 'FIRE_DRAGON' ELSE '' END || '"}}'
 WHEN 1 THEN '{{"buildingType":"' || ({BUILDING}) || '","laneType":"mid_lane","towerType":"OUTER_TURRET"}}' WHEN 4 THEN '{{"itemId":' || (1000 + k * 700) || '}}'
 WHEN 5 THEN '{{"skillSlot":' || (k % 6) || '}}' WHEN 6 THEN '{{"creatorId":' || (1 + k % 10) || ',"wardType":"YELLOW_TRINKET"}}' WHEN 7 THEN '{{"wardType":"control_ward"}}' ELSE '{{}}' END"""


def _duck(columns: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {n}" for n, v in columns.items()).replace(" div ", " // ")


_M = "(SELECT s_suppkey AS m FROM supplier)"
_G = f"g AS (SELECT {_duck(GAME)} FROM {_M})"
_FR = f"fr AS (SELECT {_duck(FRAME)} FROM {_M}, range(0, {FRAMES}) a(f), range(1, {SLOTS + 1}) b(s))"
_EV = f"ev AS (SELECT m, k, {_duck(EVENT | {'monster': MONSTER, 'building': BUILDING})} FROM {_M}, range(0, {EVENTS}) a(k))"
_ALL = f"{_G}, {_FR}, {_EV}"


def _suppliers(x: Tables) -> DataFrame:
    """m and match_id, dealt by match in proportion to their number: one small file would else make all frames in one task."""
    rows = x.supplier.select(F.col("s_suppkey").alias("m")).select("m", F.expr(MATCH).alias("match_id"))
    return rows.repartition(max(1, -(-x.supplier.count() // MATCHES)), "match_id")


def _each(df: DataFrame, name: str, start: int, end: int) -> DataFrame:
    """df with each number of a range. By a join, whose size Spark takes as the product of its sides; exploded rows count as one, and Spark would broadcast all frames for a small table."""
    return df.crossJoin(df.sparkSession.range(start, end, 1, 1).select(F.col("id").cast("int").alias(name)))


def _typed(df: DataFrame, name: str, columns: dict[str, str]) -> DataFrame:
    """The named table's columns, in its types; those without an expression are empty."""
    cells = []
    for field in schemas.table(name).fields:
        cell = F.col(field.name) if field.name in df.columns else F.expr(columns[field.name]) if field.name in columns else F.array().cast("array<int>") if field.name == "item_ids" else F.lit(None)
        cells.append(cell.cast(field.dataType).alias(field.name))
    return df.select(*cells)


def games(x: Tables) -> DataFrame:
    return _typed(_suppliers(x), "games", GAME)


def frames(x: Tables) -> DataFrame:
    return _typed(_each(_each(_suppliers(x), "f", 0, FRAMES), "s", 1, SLOTS + 1), "frames", FRAME)


def _numbered(x: Tables) -> DataFrame:
    return _each(_suppliers(x), "k", 0, EVENTS)


def events(x: Tables) -> DataFrame:
    return _typed(_numbered(x), "events", EVENT | {"details": DETAILS})


_OF = {"dragon_count": "DRAGON", "baron_count": "BARON_NASHOR", "herald_count": "RIFTHERALD", "horde_count": "HORDE"}
_STATES = f"""mk AS (SELECT match_id, timestamp_ms, CASE WHEN monster IS NOT NULL THEN killer_team WHEN building = 'TOWER_BUILDING' THEN 300 - team_id END AS team_id, monster, building FROM ev),
st0 AS (SELECT match_id, timestamp_ms, team_id, sum(total_gold) AS total_gold, sum(xp) AS total_xp, sum(cs + jungle_cs) AS total_cs, sum(ward_count) AS ward_count, sum(kills) AS kills, sum(deaths) AS deaths,
 avg(pos_x) AS centroid_x, avg(pos_y) AS centroid_y, sqrt(var_pop(pos_x) + var_pop(pos_y)) AS spread, avg(level) AS avg_level FROM fr GROUP BY ALL),
st AS (SELECT s.*, {", ".join(f"(SELECT count(*) FROM mk WHERE mk.match_id = s.match_id AND mk.team_id = s.team_id AND mk.timestamp_ms <= s.timestamp_ms AND monster = '{v}') AS {n}" for n, v in _OF.items())},
 (SELECT count(*) FROM mk WHERE mk.match_id = s.match_id AND mk.team_id = s.team_id AND mk.timestamp_ms <= s.timestamp_ms AND building = 'TOWER_BUILDING') AS tower_count FROM st0 s)"""
_ROUNDED = ("centroid_x", "centroid_y", "spread", "avg_level")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(f"WITH {_ALL}, {_STATES} SELECT * REPLACE ({', '.join(f'round({n}, 6) AS {n}' for n in _ROUNDED)}) FROM st")
def c3_a11_a12_o5_game_states(x: Tables) -> DataFrame:
    return _rounded(teamstate.game_states(frames(x), events(x)), *_ROUNDED)


_VECTORS = f"""v AS (SELECT a.match_id, a.timestamp_ms, a.team_id, a.timestamp_ms / 60000.0 AS minutes, {", ".join(f"a.{c} - b.{c} AS {n}" for n, c in teamstate.DIFFS.items())},
 {", ".join(f"a.{c} AS {n}" for n, c in teamstate.OWN.items())}, (a.team_id = g.winning_team)::INT AS won FROM st a JOIN st b ON a.match_id = b.match_id AND a.timestamp_ms = b.timestamp_ms AND a.team_id = 300 - b.team_id JOIN g ON g.match_id = a.match_id)"""


@query(f"WITH {_ALL}, {_STATES}, {_VECTORS} SELECT * REPLACE (round(team_avg_level, 6) AS team_avg_level, round(team_spread, 6) AS team_spread, round(minutes, 6) AS minutes) FROM v")
def c4_feature_vectors(x: Tables) -> DataFrame:
    vectors = teamstate.feature_vectors(teamstate.game_states(frames(x), events(x)), games(x))
    return _rounded(vectors, "team_avg_level", "team_spread", "minutes")


_CONCEPTS = (("c_gold", "Gold Advantage", "More gold.", "team_gold_lead", 0.5, "all", "economy"), ("c_kill", "Kill Pressure", "More kills.", "team_kill_lead", 300.0, "all", "fighting"), ("c_tower", "Tower Pressure", "Towers.", "team_towers", 200.0, "all", "objectives"))


@query(f"""WITH {_ALL}, {_STATES}, {_VECTORS}, c(concept_id, name, explanation, key, importance, least) AS (VALUES ('c_gold', 'gold advantage', 'More gold.', 'team_gold_lead', 0.5, 1500), ('c_kill', 'kill pressure', 'More kills.', 'team_kill_lead', 300.0, 2), ('c_tower', 'tower pressure', 'Towers.', 'team_towers', 200.0, 1)),
d AS (SELECT v.match_id, v.timestamp_ms, v.team_id, c.*, CASE key WHEN 'team_gold_lead' THEN team_gold_lead WHEN 'team_kill_lead' THEN team_kill_lead ELSE team_towers END AS now FROM v, c),
l AS (SELECT *, now - lag(now) OVER (PARTITION BY match_id, team_id, key ORDER BY timestamp_ms) AS delta FROM d),
r AS (SELECT *, abs(delta) * importance AS impact, row_number() OVER (PARTITION BY match_id ORDER BY abs(delta) * importance DESC, importance DESC, concept_id, team_id, timestamp_ms) AS place FROM l WHERE abs(delta) >= least),
k AS (SELECT *, row_number() OVER (PARTITION BY match_id, timestamp_ms, concept_id ORDER BY place DESC) AS rn FROM r WHERE place <= 10)
SELECT match_id, timestamp_ms, concept_id, team_id, 'At ' || (timestamp_ms // 60000) || ' min, your team ' || CASE WHEN delta > 0 THEN 'gained ' ELSE 'lost ' END || name || '. ' || explanation AS description, round(impact, 6) AS impact_score, place FROM k WHERE rn = 1""")
def c6_key_moments(x: Tables) -> DataFrame:
    vectors = teamstate.feature_vectors(teamstate.game_states(frames(x), events(x)), games(x))
    concepts = x.spark.createDataFrame(list(_CONCEPTS), schemas.table("concepts"))
    return _rounded(teamstate.key_moments(vectors, concepts), "impact_score")


_PLAIN = teamstate.LEARNED[:-1]  # whole numbers: the spread is a mean of roots, whose last digits depend on the order of rows
_SAY = {f: (*teamstate.MEANING.get(f, (f.replace("_", " ").title(), "general", "all")), f"This measures {f.replace('_', ' ')}.") for f in _PLAIN}


@query(f"""WITH {_ALL}, {_STATES}, {_VECTORS}, t5 AS (SELECT won AS y, unnest({list(_PLAIN)}) AS f, unnest([{", ".join(f"{f}::DOUBLE" for f in _PLAIN)}]) AS v FROM v),
r5 AS (SELECT f, min(v) AS low, max(v) AS high FROM t5 WHERE v IS NOT NULL GROUP BY f),
c5 AS (SELECT f, CASE WHEN high > low THEN least(floor((v - low) / ((high - low) / 32)), 31) ELSE 0 END AS cell, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS w FROM t5 JOIN r5 USING (f) GROUP BY ALL),
u5 AS (SELECT f, sum(n) OVER o AS n1, sum(w) OVER o AS w1, sum(n) OVER (PARTITION BY f) AS n, sum(w) OVER (PARTITION BY f) AS w FROM c5 WINDOW o AS (PARTITION BY f ORDER BY cell ROWS UNBOUNDED PRECEDING)),
g5 AS (SELECT f, coalesce(max(CASE WHEN n1 < n THEN 2 * (w / n) * (1 - w / n) - n1 / n * 2 * (w1 / n1) * (1 - w1 / n1) - (n - n1) / n * 2 * ((w - w1) / (n - n1)) * (1 - (w - w1) / (n - n1)) END), 0) AS gain FROM u5 GROUP BY f),
h5 AS (SELECT f, greatest(gain, 0) / (SELECT sum(greatest(gain, 0)) FROM g5) AS importance FROM g5)
SELECT 'concept_' || f AS concept_id, CASE f {" ".join(f"WHEN '{f}' THEN '{m[0]}'" for f, m in _SAY.items())} END AS name, CASE f {" ".join(f"WHEN '{f}' THEN '{m[3]}'" for f, m in _SAY.items())} END AS explanation, f AS feature_key, round(importance, 6) AS importance,
 CASE f {" ".join(f"WHEN '{f}' THEN '{m[2]}'" for f, m in _SAY.items())} END AS game_phase, CASE f {" ".join(f"WHEN '{f}' THEN '{m[1]}'" for f, m in _SAY.items())} END AS category FROM h5 WHERE importance >= 0.01""")
def c5_concepts(x: Tables) -> DataFrame:
    """What tells winners from losers: each feature's share of the impurity that one cut removes."""
    vectors = teamstate.feature_vectors(teamstate.game_states(frames(x), events(x)), games(x))
    return _rounded(teamstate.concepts_by_impurity(vectors, list(_PLAIN)), "importance")


_LEAST = " ".join(f"WHEN '{f}' THEN {t}" for f, t in teamstate.THRESHOLDS.items())


@query(f"""WITH {_ALL}, {_STATES}, {_VECTORS}, c AS (SELECT concept_id, lower(name) AS name, explanation, feature_key AS key, importance, CASE feature_key {_LEAST} ELSE {teamstate.DEFAULT_THRESHOLD} END AS least FROM ({SQL["c5_concepts"]})),
d AS (SELECT v.match_id, v.timestamp_ms, v.team_id, c.*, CASE key {" ".join(f"WHEN '{f}' THEN {f}" for f in _PLAIN)} END AS now FROM v, c),
l AS ({SQL["c6_key_moments"].split(chr(10) + "l AS (")[1]}""")
def c7_process_all(x: Tables) -> DataFrame:
    """Key moments of all matches by the concepts that all matches give, in one job."""

    def discover(vectors: DataFrame, features: list[str]) -> DataFrame:
        return _rounded(teamstate.concepts_by_impurity(vectors, [f for f in features if f in _PLAIN]), "importance")

    return _rounded(engine.process_all(frames(x), events(x), games(x), discover)[2], "impact_score")


_ROLL = """roll AS (SELECT puuid, match_id, min(team_id) AS team_id, min(role) AS role, count(*) FILTER (timestamp_ms BETWEEN 540000 AND 660000) AS window_10_rows,
 sum(CASE WHEN timestamp_ms BETWEEN 540000 AND 660000 THEN (kills + assists) / greatest(deaths, 1) ELSE 0 END) AS kda_10_sum, sum(CASE WHEN timestamp_ms BETWEEN 540000 AND 660000 THEN cs ELSE 0 END) AS cs_10_sum,
 sum(CASE WHEN timestamp_ms BETWEEN 540000 AND 660000 THEN total_gold ELSE 0 END) AS total_gold_10_sum, sum(CASE WHEN timestamp_ms BETWEEN 540000 AND 660000 THEN ward_count ELSE 0 END) AS ward_count_10_sum FROM fr GROUP BY puuid, match_id)"""


@query(f"""WITH {_G}, {_FR}, {_ROLL} SELECT roll.* REPLACE (round(kda_10_sum, 6) AS kda_10_sum), created_at, winning_team FROM roll JOIN g USING (match_id) WHERE created_at % 7 <> 0 AND (created_at // 3600000) % 5 <> 0""")
def c8_match_rollup(x: Tables) -> DataFrame:
    """Matches that a target lacks; those without a game row fall out."""
    known = games(x).filter("created_at % 7 <> 0")
    done = games(x).filter("(created_at div 3600000) % 5 = 0").select("match_id")
    return _rounded(players.match_rollup(frames(x), known, done), "kda_10_sum")


_PLAYERS = "pl AS (SELECT 'p' || n AS puuid, CASE n % 6 WHEN 0 THEN NULL WHEN 1 THEN 'IRON' WHEN 2 THEN 'GOLD' WHEN 3 THEN 'MASTER' WHEN 4 THEN 'CHALLENGER' ELSE 'SILVER' END AS tier, CASE WHEN n % 4 > 0 THEN n * 150 END AS lp, n FROM range(0, 40) r(n))"


def _players(x: Tables) -> DataFrame:
    rows = x.spark.range(40).withColumnRenamed("id", "n")
    tier = F.expr("CASE n % 6 WHEN 0 THEN NULL WHEN 1 THEN 'IRON' WHEN 2 THEN 'GOLD' WHEN 3 THEN 'MASTER' WHEN 4 THEN 'CHALLENGER' ELSE 'SILVER' END")
    return rows.select(F.expr("'p' || n").alias("puuid"), F.expr("'Name ' || n || '#T'").alias("riot_id"), tier.alias("rank_tier"), F.lit("I").alias("rank_division"), F.expr("CASE WHEN n % 4 > 0 THEN n * 150 END").cast("int").alias("lp"), F.col("n").alias("last_updated"))


@query(f"""WITH {_G}, {_FR}, {_ROLL}, {_PLAYERS}, stats AS (SELECT * FROM roll JOIN g USING (match_id)), cut AS (SELECT puuid, min(created_at) AS cutoff FROM stats WHERE match_id LIKE '%7' GROUP BY ALL),
a AS (SELECT puuid, count(*) AS n, count(*) FILTER (team_id = winning_team) AS wins, sum(window_10_rows) AS w, sum(kda_10_sum) AS kda, sum(cs_10_sum) AS cs, sum(total_gold_10_sum) AS gold, sum(ward_count_10_sum) AS wards,
 {", ".join(f"count(*) FILTER (role = '{r}') AS {r}" for r in players.ROLES)} FROM stats LEFT JOIN cut USING (puuid) WHERE cutoff IS NULL OR created_at < cutoff GROUP BY ALL),
f AS (SELECT puuid, list_value(CASE tier WHEN 'IRON' THEN 1 WHEN 'GOLD' THEN 4 WHEN 'MASTER' THEN 8 WHEN 'CHALLENGER' THEN 10 WHEN 'SILVER' THEN 3 ELSE 0 END, CASE WHEN pl.lp IS NULL THEN 0 ELSE least(pl.lp / 1000.0, 2) END, ln(1 + coalesce(a.n, 0)), coalesce(wins / a.n, 0), coalesce(kda / w, 0), coalesce(cs / w, 0), coalesce(gold / w, 0), 0, coalesce(wards / w, 0), 0,
 {", ".join(f"coalesce({r} / a.n, 0)" for r in players.ROLES)}, 0) AS vector FROM pl LEFT JOIN a USING (puuid))
SELECT puuid, dim::INT AS dim, round(vector[dim + 1], 6) AS value FROM f, range(0, 16) r(dim)""")
def c9_player_vectors(x: Tables) -> DataFrame:
    """All 16 features of every player, from matches before the first excluded one."""
    stats = players.match_rollup(frames(x), games(x))
    vectors = players.player_vectors(_players(x), stats, games(x).filter("match_id LIKE '%7'").select("match_id"))
    return vectors.select("puuid", F.posexplode("vector").alias("dim", "value")).withColumn("value", F.round("value", 6))


def _payload(kinds: str, value: str) -> str:
    return f"CASE WHEN event_type IN ({kinds}) THEN {value} ELSE 0 END"


_TOKENS = f"""et AS (SELECT match_id, timestamp_ms, CASE event_type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in list(tokens.KINDS.items())[:8])} END AS kind_id,
 CASE WHEN event_type IN ('CHAMPION_KILL', 'BUILDING_KILL', 'ELITE_MONSTER_KILL', 'CHAMPION_SPECIAL_KILL') THEN killer_id ELSE participant_id END AS actor, coalesce(victim_id, 0) AS target,
 {_payload("'ITEM_PURCHASED'", "CASE WHEN 1000 + k * 700 <= 10000 THEN 1000 + k * 700 ELSE 0 END")} AS item_id, {_payload("'SKILL_LEVEL_UP'", "CASE WHEN k % 6 <= 4 THEN k % 6 ELSE 0 END")} AS skill_slot,
 {_payload("'ELITE_MONSTER_KILL'", "CASE monster WHEN 'DRAGON' THEN 2 WHEN 'BARON_NASHOR' THEN 3 WHEN 'RIFTHERALD' THEN 4 ELSE 5 END")} AS monster_type_id,
 {_payload("'ELITE_MONSTER_KILL'", "CASE monster WHEN 'DRAGON' THEN 5 WHEN 'BARON_NASHOR' THEN 10 WHEN 'RIFTHERALD' THEN 9 ELSE 11 END")} AS monster_subtype_id,
 {_payload("'BUILDING_KILL'", "CASE building WHEN 'TOWER_BUILDING' THEN 2 ELSE 3 END")} AS building_type_id, {_payload("'BUILDING_KILL'", "3")} AS lane_type_id, {_payload("'BUILDING_KILL'", "2")} AS tower_type_id, 0 AS ward_type_id FROM ev),
t1 AS (SELECT * FROM et WHERE actor BETWEEN 1 AND 10)"""
_NONE = ", ".join(f"0 AS {p}" for p in tokens.PAYLOADS)
_RECALLS = """rin AS (SELECT match_id, participant_slot, timestamp_ms, CASE WHEN team_id = 100 THEN (pos_x - 400) * (pos_x - 400) + (pos_y - 400) * (pos_y - 400) ELSE (pos_x - 14300) * (pos_x - 14300) + (pos_y - 14300) * (pos_y - 14300) END <= 2250000 AS now FROM fr),
rec AS (SELECT match_id, timestamp_ms, participant_slot AS actor FROM (SELECT *, lag(now) OVER (PARTITION BY match_id, participant_slot ORDER BY timestamp_ms) AS was FROM rin) WHERE now AND NOT was)"""
_ENGAGES = """kl AS (SELECT DISTINCT match_id, timestamp_ms, CASE WHEN killer_id <= 5 THEN 100 ELSE 200 END AS side, position_x, position_y, (timestamp_ms - 15000) // 60000 * 60000 AS seen_ms FROM ev
 WHERE event_type = 'CHAMPION_KILL' AND killer_id BETWEEN 1 AND 10 AND (killer_id <= 5) <> (victim_id <= 5) AND timestamp_ms >= 15000),
nr AS (SELECT kl.*, count(*) FILTER (fr.team_id = side) AS attackers, count(*) FILTER (fr.team_id <> side) AS defenders FROM kl JOIN fr ON fr.match_id = kl.match_id AND fr.timestamp_ms = seen_ms AND (pos_x - position_x) * (pos_x - position_x) + (pos_y - position_y) * (pos_y - position_y) <= 6250000 GROUP BY ALL),
eng AS (SELECT DISTINCT match_id, timestamp_ms, 17 AS kind_id, CASE WHEN side = 100 THEN 1 ELSE 6 END AS actor FROM nr WHERE attackers >= 3 AND defenders >= 2
 UNION SELECT DISTINCT match_id, timestamp_ms, 18, CASE WHEN side = 100 THEN 6 ELSE 1 END FROM nr WHERE attackers >= 3 AND defenders > attackers)"""
_STREAM = f"""{_ALL}, {_TOKENS}, {_RECALLS}, {_ENGAGES}, every AS (SELECT DISTINCT match_id, timestamp_ms, 0 AS kind_id, 0 AS actor, 0 AS target, {_NONE} FROM fr UNION ALL SELECT * FROM t1
 UNION ALL SELECT match_id, timestamp_ms, 16, actor, 0, {_NONE} FROM rec UNION ALL SELECT match_id, timestamp_ms, kind_id, actor, 0, {_NONE} FROM eng),
s0 AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY timestamp_ms, kind_id, actor, target, {", ".join(tokens.PAYLOADS)}) - 1 AS pos FROM every),
s AS (SELECT *, count(*) FILTER (kind_id = 0) OVER (PARTITION BY match_id ORDER BY pos) AS anchor FROM s0)"""


@query(f"WITH {_ALL}, {_TOKENS} SELECT * FROM t1")
def c11_event_tokens(x: Tables) -> DataFrame:
    return tokens.event_tokens(events(x))


@query(f"WITH {_FR}, {_RECALLS} SELECT * FROM rec")
def c12_recalls(x: Tables) -> DataFrame:
    return tokens.recalls(frames(x)).select("match_id", "timestamp_ms", "actor")


@query(f"WITH {_FR}, {_EV}, {_ENGAGES} SELECT * FROM eng")
def c13_engages(x: Tables) -> DataFrame:
    return tokens.engages(frames(x), events(x)).select("match_id", "timestamp_ms", "kind_id", "actor")


@query(f"WITH {_STREAM} SELECT * EXCLUDE (anchor) FROM s")
def c10_token_stream(x: Tables) -> DataFrame:
    return tokens.token_stream(frames(x), events(x))


@query(f"""WITH {_STREAM}, w AS (SELECT *, max(anchor) OVER (PARTITION BY match_id) AS top FROM s)
SELECT match_id, anchor, min(timestamp_ms) FILTER (kind_id < 8) AS timestamp_ms, coalesce(arg_min(kind_id - 7, pos) FILTER (kind_id >= 8), 0) AS next_label, coalesce(array_to_string(list_sort(list(DISTINCT kind_id) FILTER (kind_id >= 8)), ','), '') AS kinds FROM w WHERE anchor > 0 AND anchor < top GROUP BY ALL""")
def c14_anchor_labels(x: Tables) -> DataFrame:
    return tokens.anchor_labels(tokens.token_stream(frames(x), events(x))).withColumn("kinds", F.array_join(F.col("kinds").cast("array<string>"), ","))


@query(f"""WITH {_STREAM}, d AS (SELECT match_id, anchor, actor, arg_max(CASE kind_id WHEN 12 THEN 0 WHEN 13 THEN 1 WHEN 14 THEN 2 WHEN 16 THEN 3 WHEN 17 THEN 4 ELSE 5 END, pos) AS decision FROM s WHERE kind_id IN (12, 13, 14, 16, 17, 18) AND actor BETWEEN 1 AND 10 GROUP BY ALL),
a AS (SELECT DISTINCT match_id, anchor FROM s WHERE anchor > 0) SELECT match_id, anchor, actor, coalesce(decision, 6) AS decision FROM (SELECT * FROM a, range(1, 11) r(actor)) LEFT JOIN d USING (match_id, anchor, actor)""")
def c14_decision_labels(x: Tables) -> DataFrame:
    return tokens.decision_labels(tokens.token_stream(frames(x), events(x)))


@query(f"""WITH {_STREAM}, b AS (SELECT match_id, anchor, max((kind_id = 8 AND actor BETWEEN 1 AND 5)::INT) AS blue, max((kind_id = 8 AND actor BETWEEN 6 AND 10)::INT) AS red FROM s WHERE anchor > 0 AND kind_id <> 0 GROUP BY ALL)
SELECT match_id, anchor, t AS team_id, CASE t WHEN 100 THEN blue ELSE red END AS treated, (winning_team = t)::INT AS won FROM b JOIN g USING (match_id), (VALUES (100), (200)) v(t)""")
def c27_causal_rows(x: Tables) -> DataFrame:
    outcome = games(x).select("match_id", (F.col("winning_team") == 100).cast("int").alias("blue_win"))
    return tokens.causal_rows(tokens.token_stream(frames(x), events(x)), outcome, tokens.KINDS["CHAMPION_KILL"])


@query(f"""WITH {_STREAM}, p AS (SELECT match_id, list(kind_id ORDER BY pos) FILTER (pos < 30) AS k FROM s GROUP BY ALL) SELECT match_id, array_to_string(list_resize(k, 30, 1), ',') AS kinds, len(k) AS n FROM p""")
def c15_padded(x: Tables) -> DataFrame:
    return tokens.padded(tokens.token_stream(frames(x), events(x)), 30).withColumn("kinds", F.array_join(F.col("kinds").cast("array<string>"), ","))


@query(f"""WITH {_STREAM}, p AS (SELECT match_id, count(*) AS n, list(kind_id ORDER BY pos) AS k FROM s WHERE match_id LIKE '%1' GROUP BY ALL),
o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM p) SELECT match_id, begins::BIGINT AS begins, n, array_to_string(k, ',') AS kinds FROM o""")
def c15_flat_batch(x: Tables) -> DataFrame:
    """A batch of matches without padding: kinds one match after the other, and where each begins."""
    some = tokens.token_stream(frames(x), events(x)).filter("match_id LIKE '%1'")
    return tokens.flat_batch(some).withColumn("kinds", F.array_join(F.col("kinds").cast("array<string>"), ","))


@query(f"WITH {_FR} SELECT match_id, timestamp_ms, 2 * 10 + 1 AS width, round(sum(total_gold / 5000.0 * (participant_slot * 2 - 1) + pos_x / 15000.0 * participant_slot * 2) + max(timestamp_ms) / 60000.0 * 21, 6) AS weighed FROM fr GROUP BY match_id, timestamp_ms")
def c20_frame_tensor(x: Tables) -> DataFrame:
    """Every cell of the vector weighs as much as its place, so that the sum tells them apart."""
    rows = tokens.frame_tensor(frames(x), ["total_gold", "pos_x"], scale=tokens.FRAME_SCALE)
    return rows.select("match_id", "timestamp_ms", F.size("vector").alias("width"), F.round(_weighed(), 6).alias("weighed"))


def _weighed() -> F.Column:
    return F.aggregate(F.transform("vector", lambda v, at: v * (at + 1)), F.lit(0.0), lambda a, b: a + b)


_COUNTED = {"dragon": "monster = 'DRAGON'", "baron": "monster = 'BARON_NASHOR'", "herald": "monster = 'RIFTHERALD'", "grub": "monster = 'HORDE'", "tower": "building = 'TOWER_BUILDING'"}
_SIDE = "(SELECT count(*) FROM mk WHERE mk.match_id = b.match_id AND mk.timestamp_ms <= b.timestamp_ms AND mk.team_id = {team} AND {when})"


@query(f"""WITH {_ALL}, {_STATES}, b AS (SELECT match_id, timestamp_ms, sum(CASE WHEN team_id = 100 THEN total_gold ELSE -total_gold END) AS gold, sum(CASE WHEN team_id = 100 THEN total_xp ELSE -total_xp END) AS xp, sum(CASE WHEN team_id = 100 THEN kills ELSE -kills END) AS kill,
 max(centroid_x) FILTER (team_id = 100) AS bx, max(centroid_y) FILTER (team_id = 100) AS byy, max(spread) FILTER (team_id = 100) AS bs, max(centroid_x) FILTER (team_id = 200) AS rx, max(centroid_y) FILTER (team_id = 200) AS ry, max(spread) FILTER (team_id = 200) AS rs FROM st GROUP BY ALL),
c AS (SELECT b.*, {", ".join(f"{_SIDE.format(team=100, when=w)} AS {n}_1, {_SIDE.format(team=200, when=w)} AS {n}_2" for n, w in _COUNTED.items())} FROM b)
SELECT match_id, timestamp_ms, round(gold / 25000, 8) AS gold_diff, round(xp / 25000, 8) AS xp_diff, round(kill / 30, 8) AS kill_diff, round((tower_1 - tower_2) / 11, 8) AS tower_diff, 0.0 AS plate_diff, round((dragon_1 - dragon_2) / 6, 8) AS dragon_diff, round((baron_1 - baron_2) / 3, 8) AS baron_diff,
 round((herald_1 - herald_2) / 3, 8) AS herald_diff, round((grub_1 - grub_2) / 10, 8) AS grub_diff, round(dragon_1 / 6, 8) AS blue_dragon_count, round(dragon_2 / 6, 8) AS red_dragon_count, (baron_1 + baron_2 > 0)::INT::DOUBLE AS baron_present,
 round(bx / 15000, 8) AS blue_centroid_x, round(byy / 15000, 8) AS blue_centroid_y, round(bs / 8000, 8) AS blue_spread, round(rx / 15000, 8) AS red_centroid_x, round(ry / 15000, 8) AS red_centroid_y, round(rs / 8000, 8) AS red_spread FROM c""")
def c14_macro_state(x: Tables) -> DataFrame:
    rows = tokens.macro_state(frames(x), events(x))
    return rows.select("match_id", "timestamp_ms", *(F.round(F.col(c).cast("double"), 8).alias(c) for c in tokens.MACRO_SCALE))


@query(f"WITH {_FR}, {_EV} SELECT match_id, count(DISTINCT timestamp_ms) AS n_anchors, max(n) AS n_events FROM fr JOIN (SELECT match_id, count(*) AS n FROM ev GROUP BY ALL) USING (match_id) GROUP BY ALL")
def c32_match_cost(x: Tables) -> DataFrame:
    return engine.match_cost(frames(x), events(x))


@query("WITH s(step_s, steps) AS (VALUES (0.434, 13061), (0.9, 13061), (0.2, 100)) SELECT steps, round(step_s * steps / 60, 6) AS epoch_min, round(step_s * steps / 60 * 30 * 0.25 / 60, 6) AS early_stop_h, step_s * steps / 60 <= 180 AND step_s * steps / 60 * 30 * 0.25 / 60 <= 24 AS passes FROM s")
def c33_runtime_projection(x: Tables) -> DataFrame:
    rows = [(n, engine.runtime_projection(s, n, 30)) for s, n in ((0.434, 13_061), (0.9, 13_061), (0.2, 100))]
    return x.spark.createDataFrame([(n, round(r["epoch_min"], 6), round(r["early_stop_h"], 6), r["passes"]) for n, r in rows], "steps int, epoch_min double, early_stop_h double, passes boolean")


@query("SELECT tier, stagnant, grew, CASE WHEN grew THEN tier WHEN stagnant >= 2 THEN least(10, tier + 1) ELSE tier END AS next_tier, CASE WHEN grew OR stagnant >= 2 THEN 0 ELSE stagnant + 1 END AS next_stagnant FROM (VALUES (3), (10)) a(tier), (VALUES (0), (1), (2)) b(stagnant), (VALUES (true), (false)) c(grew)")
def c38_escalate(x: Tables) -> DataFrame:
    rows = [(t, n, g, *engine.escalate(t, n, g)) for t in (3, 10) for n in range(3) for g in (True, False)]
    return x.spark.createDataFrame(rows, "tier int, stagnant int, grew boolean, next_tier int, next_stagnant int")


@query(f"WITH {_G}, {_FR}, {_PLAYERS}, one AS (SELECT puuid, min(match_id) AS match_id FROM fr GROUP BY ALL) SELECT puuid, CASE WHEN match_id LIKE 'NA1%' THEN 'americas' WHEN match_id LIKE 'KR%' THEN 'asia' ELSE 'europe' END AS route FROM pl JOIN one USING (puuid) WHERE tier IS NULL")
def c35_rank_backlog(x: Tables) -> DataFrame:
    return engine.rank_backlog(_players(x), frames(x))


@query(f"WITH {_PLAYERS} SELECT puuid FROM pl WHERE n % 5 <> 0 AND NOT (n % 3 = 0 AND n * 10000 > 200000 - 86400)")
def c36_seed_batch(x: Tables) -> DataFrame:
    seeds = _players(x).select("puuid")
    running = _players(x).filter("last_updated % 5 = 0").select("puuid")
    seeded = _players(x).filter("last_updated % 3 = 0").select("puuid", (F.col("last_updated") * 10_000).alias("seeded_at"))
    return engine.seed_batch(seeds, running, seeded, 200_000)


@query(f"WITH {_PLAYERS}, q AS (SELECT puuid, n * 1.5 AS score FROM pl WHERE n % 2 = 0 UNION ALL SELECT puuid, 20.0 FROM pl WHERE n % 3 = 0) SELECT puuid, max(score)::DOUBLE AS score FROM q GROUP BY ALL ORDER BY score DESC, puuid LIMIT 9")
def c37_s10_recover_and_pop(x: Tables) -> DataFrame:
    """What a crash left in work goes back to the queue; then the highest are taken."""
    queue = _players(x).filter("last_updated % 2 = 0").select("puuid", (F.col("last_updated") * 1.5).alias("score"))
    return engine.pop_highest(engine.recover(queue, _players(x).filter("last_updated % 3 = 0"), 20.0), 9)


@query(f"WITH {_G} SELECT match_id FROM g WHERE (created_at // 3600000) % 4 = 0")
def s20_o3_unparsed(x: Tables) -> DataFrame:
    return engine.unparsed(games(x), games(x).filter("(created_at div 3600000) % 4 <> 0"))


def _match_documents(x: Tables) -> DataFrame:
    """The games as nested documents: one row a match, in the source's schema."""
    person = F.struct(
        F.col("participant_slot").alias("participantId"), "puuid", F.col("team_id").alias("teamId"),
        F.expr("CASE role WHEN 'JGL' THEN 'JUNGLE' WHEN 'MID' THEN 'MIDDLE' WHEN 'BOT' THEN 'BOTTOM' WHEN 'SUP' THEN 'UTILITY' ELSE role END").alias("teamPosition"),
        (F.col("team_id") == F.col("winning_team")).alias("win"), (F.col("participant_slot") * 10).alias("championId"), F.col("puuid").alias("riotIdGameName"), F.lit("T").alias("riotIdTagline"),
    )
    rows = frames(x).filter("timestamp_ms = 0").join(games(x), "match_id").groupBy("match_id").agg(F.array_sort(F.collect_list(person)).alias("people"), *(F.first(c).alias(c) for c in ("patch", "queue_id", "game_duration_s", "created_at")))
    info = F.struct(F.col("patch").alias("gameVersion"), F.col("queue_id").alias("queueId"), F.col("game_duration_s").alias("gameDuration"), F.col("created_at").alias("gameCreation"), F.lower(F.substring_index("match_id", "_", 1)).alias("platformId"), F.col("people").alias("participants"))
    return rows.select(F.struct(F.col("match_id").alias("matchId")).alias("metadata"), info.alias("info"))


def _timeline_documents(x: Tables) -> DataFrame:
    of = lambda e, name, kind="int": F.get_json_object(e, f"$.{name}").cast(kind).alias(name)
    e = _typed(_numbered(x), "events", EVENT | {"details": DETAILS}).withColumn("n", F.floor(F.col("timestamp_ms") / 60000).cast("int"))
    helpers = F.when(F.col("event_type") == "CHAMPION_KILL", F.array(F.expr("1 + (victim_id + 3) % 10"), F.expr("1 + (victim_id + 4) % 10")))
    move = F.struct(
        F.col("timestamp_ms").alias("timestamp"), F.col("event_type").alias("type"), F.col("participant_id").alias("participantId"), of("details", "creatorId"), F.col("killer_id").alias("killerId"), F.col("victim_id").alias("victimId"),
        F.col("killer_team").alias("killerTeamId"), F.col("team_id").alias("teamId"), helpers.alias("assistingParticipantIds"), F.when(F.col("position_x").isNotNull(), F.struct(F.col("position_x").alias("x"), F.col("position_y").alias("y"))).alias("position"),
        of("details", "itemId"), of("details", "skillSlot"), of("details", "monsterType", "string"), of("details", "buildingType", "string"), of("details", "wardType", "string"),
    )
    bundled = e.groupBy("match_id", "n").agg(F.array_sort(F.collect_list(move)).alias("events"))
    stats = F.struct(F.col("current_gold").alias("currentGold"), F.col("total_gold").alias("totalGold"), "xp", "level", F.col("cs").alias("minionsKilled"), F.col("jungle_cs").alias("jungleMinionsKilled"), F.struct(F.col("pos_x").alias("x"), F.col("pos_y").alias("y")).alias("position"))
    people = frames(x).groupBy("match_id", "timestamp_ms").agg(F.map_from_entries(F.collect_list(F.struct(F.col("participant_slot").cast("string"), stats))).alias("participantFrames"))
    one = people.withColumn("n", F.floor(F.col("timestamp_ms") / 60000).cast("int")).join(bundled, ["match_id", "n"], "left")
    # maps have no order, so frames are sorted by their time alone
    every = one.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct(F.col("timestamp_ms").alias("timestamp"), "events", "participantFrames")), lambda a, b: F.sign(a["timestamp"] - b["timestamp"]).cast("int")).alias("frames"))
    return every.select(F.struct(F.col("match_id").alias("matchId")).alias("metadata"), F.struct(F.lit(60000).cast("long").alias("frameInterval"), "frames").alias("info"))


def _documents(x: Tables) -> tuple[DataFrame, DataFrame]:
    """Both kinds of documents, written as JSON lines in the shared folder and read again by the sources."""
    from matchlake.sources.scratch import fresh_path

    paths = fresh_path(x.spark, "matches"), fresh_path(x.spark, "timelines")
    _match_documents(x).write.json(paths[0])
    _timeline_documents(x).write.option("compression", "gzip").json(paths[1])
    return matches.read_matches(x.spark, paths[0]), matches.read_timelines(x.spark, paths[1])


@query(f"WITH {_G} SELECT * FROM g")
def s5_c1_games(x: Tables) -> DataFrame:
    return matches.games(_documents(x)[0])


@query(f"WITH {_FR} SELECT match_id, participant_slot, puuid, team_id, role, puuid || '#T' AS riot_id FROM fr WHERE timestamp_ms = 0")
def c1_participants(x: Tables) -> DataFrame:
    return matches.participants(_documents(x)[0])


@query(f"WITH {_EV} SELECT match_id, timestamp_ms, event_type, participant_id, killer_id, victim_id, killer_team, team_id, position_x, position_y, monster, building, row_number() OVER (PARTITION BY match_id, timestamp_ms // 60000 ORDER BY timestamp_ms, event_type) - 1 AS place FROM ev")
def c1_events(x: Tables) -> DataFrame:
    rows = matches.events(_documents(x)[1])
    of = lambda name: F.get_json_object("details", f"$.{name}")
    return rows.select("match_id", "timestamp_ms", "event_type", "participant_id", "killer_id", "victim_id", "killer_team", "team_id", "position_x", "position_y", of("monsterType").alias("monster"), of("buildingType").alias("building"), "place")


_UPTO = "(SELECT count(*) FROM ev WHERE ev.match_id = fr.match_id AND ev.timestamp_ms // 60000 <= fr.timestamp_ms // 60000 AND {when})"


@query(f"""WITH {_FR}, {_EV} SELECT match_id, participant_slot, puuid, team_id, role, timestamp_ms, current_gold, total_gold, xp, level, cs, jungle_cs, pos_x, pos_y,
 {_UPTO.format(when="event_type = 'CHAMPION_KILL' AND killer_id = participant_slot")} AS kills, {_UPTO.format(when="event_type = 'CHAMPION_KILL' AND victim_id = participant_slot")} AS deaths,
 {_UPTO.format(when="event_type = 'CHAMPION_KILL' AND participant_slot IN (1 + (victim_id + 3) % 10, 1 + (victim_id + 4) % 10)")} AS assists,
 {_UPTO.format(when="(event_type = 'WARD_PLACED' AND 1 + k % 10 = participant_slot OR event_type = 'WARD_KILL' AND killer_id = participant_slot)")} AS ward_count,
 coalesce((SELECT string_agg(1000 + k * 700, ',' ORDER BY ev.timestamp_ms) FROM ev WHERE ev.match_id = fr.match_id AND event_type = 'ITEM_PURCHASED' AND participant_id = participant_slot AND ev.timestamp_ms // 60000 <= fr.timestamp_ms // 60000), '') AS items FROM fr""")
def c1_c2_frames(x: Tables) -> DataFrame:
    """Ten rows a frame, with the running counts of kills, deaths, assists and wards, and the items held."""
    m, t = _documents(x)
    return matches.frames(m, t).withColumn("items", F.array_join(F.col("item_ids").cast("array<string>"), ",")).drop("item_ids")


@query(f"WITH {_G} SELECT match_id, patch FROM g WHERE patch LIKE '14.3.%'")
def s3_s4_p9_blob_scan(x: Tables) -> DataFrame:
    """Stored gzip documents, of which only the match is read, and of these only one patch."""
    from matchlake.sources.scratch import fresh_path

    path = fresh_path(x.spark, "raw")
    docs = _match_documents(x).select(F.col("metadata.matchId").alias("match_id"), F.to_json(F.struct("metadata", "info")).alias("match_json"), F.lit("{}").alias("timeline_json"))
    files.gzipped(docs, ["match_json", "timeline_json"]).write.parquet(path)
    blobs = files.gunzipped(x.spark.read.parquet(path).select("match_id", "match_json"), ["match_json"])
    found = blobs.select(F.from_json("match_json", schemas.MATCH).alias("d")).select("d.*")
    return matches.games(matches.live_patch(found, "14.3")).select("match_id", "patch")


@query(f"""WITH {_G} SELECT match_id, timestamp_ms, 10.0 AS first_champion, CASE WHEN match_id LIKE 'NA1%' THEN 9.0 WHEN match_id LIKE 'KR%' THEN 5.0 ELSE 3.0 END AS region, 1 + ((created_at // 3600000) % 24) // 6 AS hours,
 5 AS n_red, 14 AS major, string_split(patch, '.')[2]::INT AS minor, 1047 AS width FROM g, (SELECT range * 60000 AS timestamp_ms FROM range(0, {FRAMES}))""")
def c16_c21_static_vectors(x: Tables) -> DataFrame:
    """The match's static vector at each of its anchors."""
    rows = static.static_anchors(static.static_vectors(_documents(x)[0]), frames(x))
    at = lambda k: F.get("vector", F.lit(k))
    red = F.aggregate(F.slice("vector", 11, 10), F.lit(0.0), lambda a, b: a + b).cast("int")
    return rows.select("match_id", "timestamp_ms", at(0).alias("first_champion"), at(21).alias("region"), at(22).cast("int").alias("hours"), red.alias("n_red"), at(143).cast("int").alias("major"), at(144).cast("int").alias("minor"), F.size("vector").alias("width"))


_CHAMPIONS = "ch AS (SELECT '14.' || v || '.1' AS version, (s * 10)::VARCHAR AS key, 500.0 + s + v AS hp FROM range(1, 10) a(v), range(1, 8) b(s))"


@query(f"""WITH {_G}, {_CHAMPIONS} SELECT match_id, round(coalesce(sum(hp * (s - 1)), 0), 6) AS weighed FROM g CROSS JOIN range(1, 11) b(s) LEFT JOIN ch ON ch.version = '14.' || string_split(patch, '.')[2] || '.1' AND key = (s * 10)::VARCHAR GROUP BY ALL""")
def j19_champion_lookup(x: Tables) -> DataFrame:
    """Champion statistics by key and patch; a slot without an entry has zeros."""
    keys = x.spark.range(1, 10).withColumnRenamed("id", "v").withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(7))))
    table = keys.select(F.expr("'14.' || v || '.1'").alias("version"), F.expr("CAST(s * 10 AS STRING)").alias("key"), F.create_map(F.lit("hp"), F.expr("CAST(500 + s + v AS DOUBLE)")).alias("stats"))
    rows = static.static_vectors(_documents(x)[0], champions=table)
    slot = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: F.get("vector", 23 + k * len(static.CHAMPION_STATS)) * k)
    return rows.select("match_id", F.round(F.aggregate(slot, F.lit(0.0), lambda a, b: a + b), 6).alias("weighed"))


@query(f"WITH {_PLAYERS} SELECT puuid, coalesce(CASE WHEN n % 7 = 0 THEN 'DIAMOND' END, tier) AS rank_tier, CASE WHEN n % 7 = 0 THEN 77 ELSE lp END AS lp FROM pl")
def k5_update_by_key(x: Tables) -> DataFrame:
    """Ranks that came late are put in their rows; other columns and rows stay, and unknown keys add none."""
    old = _players(x).select("puuid", "rank_tier", "lp")
    found = old.filter("CAST(substring(puuid, 2) AS INT) % 7 = 0").select("puuid", F.lit("DIAMOND").alias("rank_tier"), F.lit(77).alias("lp"))
    return upsert.update_by_key(old, found.unionByName(x.spark.createDataFrame([("nobody", "IRON", 1)], "puuid string, rank_tier string, lp int")), "puuid")


@query(f"""WITH {_ALL}, {_PLAYERS}, c AS (SELECT 'games' AS name, count(*) AS n, count(*) FILTER (patch = 'x') AS n_new FROM (SELECT match_id, patch FROM g WHERE match_id LIKE 'NA1%' UNION ALL SELECT match_id, 'x' FROM g WHERE match_id NOT LIKE 'NA1%' AND match_id NOT LIKE 'KR%')
 UNION ALL SELECT 'players', count(*), count(*) FILTER (n % 2 = 1 AND n >= 10) FROM pl
 UNION ALL SELECT 'frames', count(*), count(*) FILTER (match_id LIKE 'EUW1%') FROM fr WHERE match_id NOT LIKE 'KR%'
 UNION ALL SELECT 'events', count(*) FILTER (match_id LIKE 'NA1%') * 2 + count(*) FILTER (match_id LIKE 'EUW1%'), count(*) FILTER (match_id LIKE 'EUW1%') FROM ev
 UNION ALL SELECT 'raw_matches', count(*), count(*) FILTER (match_id LIKE 'EUW1%') FROM g WHERE match_id NOT LIKE 'KR%') SELECT * FROM c""")
def k6_merge_databases(x: Tables) -> DataFrame:
    """Five tables merged by their own rules; by table the rows after it, and those that only the other side had. Events have no key, so those of both sides are there twice."""
    one, two = F.col("match_id").like("NA1%"), ~F.col("match_id").like("KR%")
    g, f, e, p = games(x), frames(x), events(x), _players(x)
    raw = g.select("match_id", F.lit(None).cast("binary").alias("match_json"), F.lit(None).cast("binary").alias("timeline_json"), F.lit(0).cast("long").alias("stored_at"))
    main = {"games": g.filter(one), "players": p.filter("last_updated < 10 OR last_updated % 2 = 0"), "frames": f.filter(one), "events": e.filter(one), "raw_matches": raw.filter(one)}
    other = {"games": g.filter(two).withColumn("patch", F.lit("x")), "players": p.filter("last_updated % 2 = 1").withColumn("riot_id", F.lit("x")), "frames": f.filter(two), "events": e.filter(two), "raw_matches": raw.filter(two)}
    merged = upsert.merge_databases(main, other)
    out = None
    for name, table in merged.items():
        fresh = {"games": F.col("patch") == "x", "players": F.expr("last_updated % 2 = 1 AND last_updated >= 10"), "frames": ~one, "events": ~one, "raw_matches": ~one}.get(name)
        row = table.agg(F.count("*").alias("n"), F.count_if(fresh).alias("n_new")).select(F.lit(name).alias("name"), "n", "n_new")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"WITH {_PLAYERS} SELECT puuid, 'Name ' || n || '#T' AS riot_id, tier AS rank_tier, 'I' AS rank_division, lp FROM pl WHERE lower('Name ' || n) LIKE '%name 1%' ORDER BY riot_id, puuid LIMIT 20")
def c34_s19_search(x: Tables) -> DataFrame:
    """The reply to a search request, read back from its JSON."""
    reply = review.reply({"players": _players(x)}, {"action": "search", "query": "nAME 1"})
    return x.spark.createDataFrame([(reply,)], "j string").select(F.explode(F.from_json("j", "array<struct<puuid:string,riot_id:string,rank_tier:string,rank_division:string,lp:int>>")).alias("r")).select("r.*")


@query(f"""WITH {_ALL} SELECT g.match_id, f.team_id, winning_team = f.team_id AS won, f.role, (SELECT count(*) FROM fr WHERE fr.match_id = g.match_id) AS n_frames, (SELECT count(*) FROM ev WHERE ev.match_id = g.match_id AND event_type IN ('CHAMPION_KILL', 'ELITE_MONSTER_KILL', 'BUILDING_KILL')) AS n_objectives, NULL::VARCHAR AS error
 FROM g JOIN fr f ON f.match_id = g.match_id AND f.timestamp_ms = 0 AND f.participant_slot = 3 WHERE g.match_id IN (SELECT min(match_id) FROM g) UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, 'Unknown action: nothing'""")
def c34_s19_game_reply(x: Tables) -> DataFrame:
    """The replies to a game review and to an unknown request, read back from their JSON."""
    tables = {"players": _players(x), "games": games(x), "frames": frames(x), "events": events(x), "concepts": x.spark.createDataFrame(list(_CONCEPTS), schemas.table("concepts")), "key_moments": x.spark.createDataFrame([], schemas.table("key_moments"))}
    one = games(x).agg(F.min("match_id")).first()[0]
    who = frames(x).filter((F.col("match_id") == one) & (F.col("participant_slot") == 3)).first().puuid
    replies = [(review.reply(tables, {"action": "game", "match_id": one, "puuid": who}),), (review.reply(tables, {"action": "nothing"}),)]
    shape = "game struct<match_id:string>, won boolean, team_id int, role string, frames array<string>, objectives array<string>, error string"
    d = x.spark.createDataFrame(replies, "j string").select(F.from_json("j", shape).alias("d")).select("d.*")
    return d.select("game.match_id", "team_id", "won", "role", F.when(F.col("frames").isNotNull(), F.size("frames")).cast("long").alias("n_frames"), F.when(F.col("objectives").isNotNull(), F.size("objectives")).cast("long").alias("n_objectives"), "error")


_WHO = "(SELECT puuid FROM fr WHERE match_id = (SELECT min(match_id) FROM g) AND participant_slot = 3 LIMIT 1)"


@query(f"""WITH {_G}, {_FR}, km AS ({SQL["c6_key_moments"]}), c(concept_id, importance) AS (VALUES ('c_gold', 0.5), ('c_kill', 300.0), ('c_tower', 200.0)),
mine AS (SELECT DISTINCT match_id, f.team_id, f.role, winning_team, created_at FROM fr f JOIN g USING (match_id) WHERE puuid = {_WHO} ORDER BY created_at DESC, match_id LIMIT 20),
top AS (SELECT match_id, team_id, concept_id, impact_score, row_number() OVER (PARTITION BY match_id, team_id ORDER BY impact_score DESC, timestamp_ms, concept_id) AS place FROM km),
own AS (SELECT match_id, team_id FROM fr WHERE puuid = {_WHO}),
w AS (SELECT concept_id, count(*) AS n, any_value(importance) * count(*) AS weight FROM km JOIN own USING (match_id, team_id) JOIN c USING (concept_id) GROUP BY concept_id ORDER BY weight DESC, concept_id LIMIT 5)
SELECT mine.match_id, mine.team_id, role, winning_team = mine.team_id AS won, count(place) AS n_moments, max(concept_id) FILTER (place = 1) AS concept_id, round(max(impact_score) FILTER (place = 1), 4) AS impact, NULL::BIGINT AS n_rows
FROM mine LEFT JOIN top ON top.match_id = mine.match_id AND top.team_id = mine.team_id AND place <= 5 GROUP BY ALL
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, concept_id, round(weight, 4), n FROM w""")
def c34_review_reply(x: Tables) -> DataFrame:
    """The reply to a player's review, read back from its JSON: recent games with their largest moment, then the weightiest concepts."""
    concepts = x.spark.createDataFrame(list(_CONCEPTS), schemas.table("concepts"))
    tables = {"players": _players(x), "games": games(x), "frames": frames(x), "events": events(x), "concepts": concepts, "key_moments": c6_key_moments(x).drop("place")}
    one = games(x).agg(F.min("match_id")).first()[0]
    who = frames(x).filter((F.col("match_id") == one) & (F.col("participant_slot") == 3)).first().puuid
    answer = review.reply(tables, {"action": "review", "puuid": who})
    shape = "games array<struct<match_id:string,team_id:int,role:string,won:boolean,moments:array<struct<rank:int,concept_id:string,impact_score:double>>>>, concepts array<struct<concept_id:string,weight:double,n:bigint>>"
    d = x.spark.createDataFrame([(answer,)], "j string").select(F.from_json("j", shape).alias("d"))
    played = d.select(F.explode("d.games").alias("g")).select("g.match_id", "g.team_id", "g.role", "g.won", F.size("g.moments").cast("long").alias("n_moments"), F.get("g.moments", F.lit(0))["concept_id"].alias("concept_id"), F.round(F.get("g.moments", F.lit(0))["impact_score"], 4).alias("impact"), F.lit(None).cast("long").alias("n_rows"))
    heavy = d.select(F.explode("d.concepts").alias("c")).select("c.concept_id", F.round("c.weight", 4).alias("impact"), F.col("c.n").alias("n_rows"))
    return played.unionByName(heavy, allowMissingColumns=True)


@query(f"WITH {_G}, {_FR}, {_PLAYERS} SELECT DISTINCT tier AS band, match_id FROM fr JOIN pl USING (puuid) WHERE tier IN ('GOLD', 'IRON')")
def j6_tier_matches(x: Tables) -> DataFrame:
    ranked = _players(x).filter(F.col("rank_tier").isin("GOLD", "IRON")).withColumnRenamed("rank_tier", "band")
    return topk.band_keys(frames(x), ranked, "puuid", "band", "match_id")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - embedding[65 - i]::DOUBLE) * (embedding[i]::DOUBLE - embedding[65 - i]::DOUBLE)))), 6) AS d FROM embeddings")
def f13_distance(x: Tables) -> DataFrame:
    from matchlake.functions.scalars import distance

    return x.embeddings.select("vec_id", F.round(distance(F.col("embedding"), F.reverse("embedding")), 6).alias("d"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(lower(replace(p_type, ' ', '_')), '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM part")
def f25_titles(x: Tables) -> DataFrame:
    from matchlake.functions.scalars import title_of

    return x.part.select("p_partkey", title_of(F.lower(F.replace("p_type", F.lit(" "), F.lit("_")))).alias("title"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS a, 1 + l_tax AS b, l_quantity / 10 AS c, 2 - l_tax AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, round(0.5 * (ln(d / b) + (b * b + (a - c) * (a - c)) / (2 * d * d) - 0.5 + ln(b / d) + (d * d + (a - c) * (a - c)) / (2 * b * b) - 0.5), 6) AS kl FROM p""")
def f15_gaussian_kl(x: Tables) -> DataFrame:
    from matchlake.functions.scalars import symmetric_gaussian_kl

    kl = symmetric_gaussian_kl(F.col("l_discount") * 10, 1 + F.col("l_tax"), F.col("l_quantity") / 10, 2 - F.col("l_tax"))
    return x.lineitem.select("l_orderkey", "l_linenumber", F.round(kl, 6).alias("kl"))


@query("SELECT trim(s_name) AS value FROM supplier WHERE s_suppkey % 3 > 0")
def s11_k12_lines(x: Tables) -> DataFrame:
    """Sorted lines written and read again; blank ones and the blanks around others are gone."""
    from matchlake.sources.scratch import fresh_path

    path = fresh_path(x.spark, "lines")
    text = F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("  "), "s_name", F.lit(" "))).otherwise(F.lit("   "))
    files.write_lines(x.supplier.select(text.alias("line")), "line", path)
    return files.lines(x.spark, path)


@query("""WITH w AS (SELECT dim, avg(embedding[dim + 1]::DOUBLE) AS m, greatest(stddev_pop(embedding[dim + 1]::DOUBLE), 1e-6) AS sd FROM embeddings, range(0, 64) r(dim) GROUP BY ALL)
SELECT vec_id, label, round(sum((embedding[dim + 1]::DOUBLE - m) / sd * (dim + 1)), 5) AS weighed, 'v1' AS version, (SELECT count(*) FROM embeddings) AS n_rows FROM embeddings, w GROUP BY ALL""")
def s16_k15_index(x: Tables) -> DataFrame:
    """An index saved and loaded: its vectors are whitened by its own statistics, and its manifest says what it is."""
    from matchlake.operators import aggregates, knn
    from matchlake.sources.scratch import fresh_path

    path = fresh_path(x.spark, "index")
    files.save_index(x.embeddings, aggregates.whitening(x.embeddings, "embedding"), path, {"version": "v1", "rows": x.embeddings.count()})
    rows, stats, manifest = files.load_index(x.spark, path)
    keys = knn.whiten_vectors(rows, "embedding", stats).withColumnRenamed("key", "vector")
    return keys.select("vec_id", "label", F.round(_weighed(), 5).alias("weighed"), F.lit(manifest["version"]).alias("version"), F.lit(manifest["rows"]).cast("long").alias("n_rows"))


@query("SELECT mode, n_calls, (SELECT sum(s_suppkey) FROM supplier)::BIGINT AS total FROM (VALUES ('off', 2), ('readwrite', 1), ('readonly', 0), ('refresh', 2)) v(mode, n_calls)")
def s17_s18_k13_k14_sample_store(x: Tables) -> DataFrame:
    """How often each mode computes when it is asked twice for what depends on the same things, one after the other."""
    from matchlake.sources.scratch import fresh_path

    root, rows = fresh_path(x.spark, "store"), []
    for mode in ("off", "readwrite", "readonly", "refresh"):
        calls: list[int] = []
        store = files.SampleStore(x.spark, root, mode)
        got = [store.get(lambda: calls.append(1) or x.supplier.select("s_suppkey"), "suppliers", 1).agg(F.sum("s_suppkey")).first()[0] for _ in range(2)]  # noqa: B023
        rows.append((mode, len(calls), int(got[1])))
    return x.spark.createDataFrame(rows, "mode string, n_calls int, total long")


@query("SELECT step, value FROM (VALUES ('fetched', 1), ('young', 1), ('old', 3)) v(step, value)")
def s12_s13_k10_cached_json(x: Tables) -> DataFrame:
    """A cached file is fetched once, serves while it is young, and is fetched again when it is old."""
    from matchlake.sources.scratch import fresh_path

    path = fresh_path(x.spark, "cache.json")
    ask = lambda n, ttl: files.cached_json(x.spark, path, lambda: {"n": n}, ttl_s=ttl)["n"]
    return x.spark.createDataFrame([("fetched", ask(1, 1e6)), ("young", ask(2, 1e6)), ("old", ask(3, 0))], "step string, value int")
