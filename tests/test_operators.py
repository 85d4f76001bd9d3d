"""Hermetic fixtures for the telemetry operators."""

from __future__ import annotations

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlake import schemas
from matchlake.operators import causal, cohort, joins, knn, players, splits, teamstate, tokens, topk, upsert
from matchlake.sources import files, matches


def frame(match="M1", slot=1, ts=0, team=None, **more):
    row = dict.fromkeys((f.name for f in schemas.table("frames").fields), 0)
    return row | {"match_id": match, "participant_slot": slot, "puuid": f"p{slot}", "team_id": team or (100 if slot <= 5 else 200), "role": "MID", "timestamp_ms": ts, "item_ids": []} | more


def event(match="M1", ts=0, kind="CHAMPION_KILL", **more):
    return dict.fromkeys(f.name for f in schemas.table("events").fields) | {"match_id": match, "timestamp_ms": ts, "event_type": kind, "details": "{}"} | more


def table(spark, name, rows):
    names = [f.name for f in schemas.table(name).fields]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schemas.table(name))


def games(spark, rows):
    return spark.createDataFrame(rows, schemas.table("games"))


@pytest.fixture(scope="module")
def two_frames(spark):
    rows = [frame(slot=s, ts=0) for s in range(1, 11)]
    rows += [frame(slot=s, ts=600_000, total_gold=(4000 if s <= 5 else 3200), cs=80 if s <= 5 else 65, ward_count=5 if s <= 5 else 2, kills=2 if s <= 5 else 1, pos_x=7000 if s <= 5 else 8000, pos_y=7000 if s <= 5 else 8000) for s in range(1, 11)]
    marks = [event(ts=300_000, kind="ELITE_MONSTER_KILL", killer_team=100, details='{"monsterType":"DRAGON"}'), event(ts=480_000, kind="BUILDING_KILL", team_id=100, details='{"buildingType":"TOWER_BUILDING"}')]
    return table(spark, "frames", rows), table(spark, "events", marks), games(spark, [("M1", "14.1", 420, 1800, 100, 1)])


def test_two_frame_match(two_frames):
    frames, events, played = two_frames
    states = teamstate.game_states(frames, events)
    assert states.count() == 4
    vectors = teamstate.feature_vectors(states, played)
    assert vectors.count() == 4
    blue = vectors.filter("team_id = 100 AND timestamp_ms = 600000").first()
    assert (blue.won, blue.team_dragon_diff, blue.team_tower_diff, blue.team_gold_lead) == (1, 1, -1, 4000)
    assert blue.team_spread == 0


def test_state_includes_events_of_the_same_time(spark, two_frames):
    frames, _, _ = two_frames
    marks = table(spark, "events", [event(ts=600_000, kind="ELITE_MONSTER_KILL", killer_team=200, details='{"monsterType":"DRAGON"}')])
    got = {(r.team_id, r.timestamp_ms): r.dragon_count for r in teamstate.game_states(frames, marks).collect()}
    assert got == {(100, 0): 0, (200, 0): 0, (100, 600_000): 0, (200, 600_000): 1}


def test_concepts_find_what_tells_winners(spark):
    rows, marks, played = [], [], []
    for i in range(30):
        win = 200 if i % 3 == 0 else 100
        played.append((f"M{i}", "14.1", 420, 1800, win, i))
        for s in range(1, 11):
            up = (100 if s <= 5 else 200) == win
            rows.append(frame(match=f"M{i}", slot=s, ts=600_000, total_gold=3000 + 1000 * up, ward_count=4 * up, kills=3 if up else 1))
    vectors = teamstate.feature_vectors(teamstate.game_states(table(spark, "frames", rows), table(spark, "events", marks)), games(spark, played))
    found = [r.feature_key for r in teamstate.discover_concepts(vectors, list(teamstate.LEARNED)).collect()]
    assert any("gold" in f or "kill" in f for f in found)
    assert teamstate.discover_concepts(vectors.limit(5), list(teamstate.LEARNED)).count() == 0


def test_moments_keep_the_later_team(spark):
    rows = [("M1", ts, team, ts / 60000, float(v if team == 100 else -v)) for ts, v in ((0, 0), (60_000, 2000), (120_000, 2100)) for team in (100, 200)]
    vectors = spark.createDataFrame(rows, "match_id string, timestamp_ms long, team_id int, minutes double, team_gold_lead double")
    concepts = spark.createDataFrame([("c", "team_gold_lead", "Gold Advantage", 0.5, "More gold.")], "concept_id string, feature_key string, name string, importance double, explanation string")
    got = teamstate.key_moments(vectors, concepts).collect()
    assert [(r.timestamp_ms, r.team_id, r.impact_score) for r in got] == [(60_000, 200, 1000.0)]
    assert got[0].description == "At 1 min, your team lost gold advantage. More gold."
    assert teamstate.key_moments(vectors, concepts, keep_all_teams=True).count() == 2


def test_rollup_and_leak(spark):
    rows = [frame(ts=540_000, cs=12, total_gold=500, kills=1, assists=2), frame(ts=600_000, cs=24, total_gold=900, kills=2, deaths=1, assists=3), frame(ts=700_000, cs=99)]
    rows += [frame(match=m, ts=540_000, cs=10) for m in ("M2", "M3")]
    frames = table(spark, "frames", rows)
    played = games(spark, [(m, "14.1", 420, 1, 100, t) for m, t in (("M1", 10), ("M2", 20), ("M3", 30))])
    stats = players.match_rollup(frames, played)
    one = stats.filter("match_id = 'M1'").first()
    assert (one.window_10_rows, one.cs_10_sum, one.total_gold_10_sum, one.kda_10_sum) == (2, 36.0, 1400.0, 8.0)
    assert players.match_rollup(frames, played.filter("match_id <> 'M3'")).count() == 2  # no game row
    assert players.match_rollup(frames, played, done=stats.filter("match_id = 'M1'")).count() == 2
    who = spark.createDataFrame([("p1", "a#b", "GOLD", "I", 50, 1), ("nobody", None, None, None, None, 1)], schemas.table("players"))
    excluded = spark.createDataFrame([("M2",)], "match_id string")
    got = {r.puuid: r.vector for r in players.player_vectors(who, stats, excluded).collect()}
    assert got["p1"][0] == 4.0 and got["p1"][2] == pytest.approx(np.log1p(1)) and got["p1"][12] == 1.0  # M2 and M3 are gone
    assert got["nobody"] == [0.0] * 16


def test_recall_edges(spark):
    rows = [frame(slot=1, ts=t, pos_x=x, pos_y=x) for t, x in ((0, 400), (60_000, 5000), (120_000, 500), (180_000, 400))]
    rows += [frame(slot=6, ts=t, pos_x=x, pos_y=x) for t, x in ((0, 9000), (60_000, 400))]
    got = [(r.timestamp_ms, r.actor) for r in tokens.recalls(table(spark, "frames", rows)).collect()]
    assert got == [(120_000, 1)]


@pytest.mark.parametrize(("defenders", "near", "kind"), [(2, 100, ["ENGAGE"]), (5, 100, ["DISENGAGE", "ENGAGE"]), (2, 9000, [])])
def test_engage_geometry(spark, defenders, near, kind):
    rows = [frame(slot=s, ts=60_000, pos_x=7000 + near * (s <= 3), pos_y=7000) for s in (1, 2, 3)] + [frame(slot=5 + s, ts=60_000, pos_x=7000, pos_y=7000) for s in range(1, defenders + 1)]
    kills = table(spark, "events", [event(ts=80_000, killer_id=1, victim_id=6, position_x=7000, position_y=7000)])
    got = sorted((r.kind_id, r.actor, r.timestamp_ms) for r in tokens.engages(table(spark, "frames", rows), kills).collect())
    assert got == sorted((tokens.KINDS[k], 1 if k == "ENGAGE" else 6, 80_000) for k in kind)


def test_token_stream_and_ward_switch(spark):
    frames = table(spark, "frames", [frame(slot=1, ts=t, pos_x=5000) for t in (0, 60_000)])
    marks = table(spark, "events", [event(ts=0, killer_id=1, victim_id=6), event(ts=30_000, kind="WARD_PLACED", details='{"creatorId":2}'), event(ts=40_000, kind="SKILL_LEVEL_UP", participant_id=11)])
    kinds = [r.kind_id for r in tokens.token_stream(frames, marks).orderBy("pos").collect()]
    assert kinds == [tokens.ANCHOR, 8, tokens.ANCHOR]
    fixed = [r.kind_id for r in tokens.token_stream(frames, marks, fix_ward_actor=True).orderBy("pos").collect()]
    assert fixed == [tokens.ANCHOR, 8, 14, tokens.ANCHOR]
    label = tokens.anchor_labels(tokens.token_stream(frames, marks)).collect()
    assert [(r.anchor, r.next_label, r.kinds) for r in label] == [(1, 1, [8])]
    assert tokens.padded(tokens.token_stream(frames, marks), 5).first().kinds == [0, 8, 0, 1, 1]
    tensor = tokens.frame_tensor(frames, ["total_gold", "pos_x"]).orderBy("timestamp_ms").collect()[1].vector
    assert len(tensor) == 21 and tensor[1] == 5000.0 and tensor[-1] == 1.0 and tensor[2] == 0.0
    outcome = spark.createDataFrame([("M1", 1)], "match_id string, blue_win int")
    got = {(r.team_id, r.treated, r.won) for r in tokens.causal_rows(tokens.token_stream(frames, marks), outcome, 8).collect()}
    assert got == {(100, 1, 1), (200, 0, 0)}


def test_splits_follow_the_growth_rule(spark):
    import hashlib

    rng = np.random.default_rng(1)
    pairs = [(f"p{p}", f"g{g}") for g in range(400) for p in rng.choice(300, 5, replace=False)]
    df, played = spark.createDataFrame(pairs, "player string, game string"), spark.createDataFrame([(f"g{g}",) for g in range(400)], "game string")
    order = sorted({p for p, _ in pairs}, key=lambda p: hashlib.sha1(p.encode()).hexdigest())
    for fraction in (0.1, 0.3, 0.9):
        target, upper = int(400 * fraction), int(400 * fraction * 1.1)
        of = lambda k: {g for p, g in pairs if p in set(order[:k])}  # noqa: B023, E731
        k, chosen = max(1, target // 20), len(order)
        while k <= len(order):
            if len(of(k)) >= target:
                chosen = k
                break
            k = max(k + 1, int(k * 1.5))
        if len(of(chosen)) > upper:
            while chosen > 1 and len(of(chosen - 1)) >= target:
                chosen -= 1
        who, cold, n = splits.player_cold(df, played, "player", "game", fraction)
        assert n == chosen and {r.game for r in cold.collect()} == of(chosen) and {r.player for r in who.collect()} == set(order[:chosen])
        game = splits.game_cold(played, cold, "game", 0.2)
        assert splits.train(played, cold, game, game="game").count() + cold.count() + game.count() == 400


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype("float32")
    x[7] = x[3]
    corpus = spark.createDataFrame([(i, x[i].tolist(), i // 3) for i in range(300)], "row_id long, key array<float>, grp long")
    asks = corpus.filter("row_id < 20").withColumnRenamed("row_id", "query_id")
    got = {}
    for r in knn.nearest(asks, corpus, 5, exclude=("grp", "grp")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.row_id)
    for q in range(20):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[[i for i in range(300) if i // 3 == q // 3]] = np.inf
        assert got[q] == np.argsort(d, kind="stable")[:5].tolist()
    wide = {(r.query_id, r.row_id) for r in knn.nearest(asks, corpus, 9, exclude=("grp", "grp")).filter("rank <= 5").collect()}
    assert wide == {(q, r) for q, rs in got.items() for r in rs}  # the prefix of a wider list


def test_nearest_scalar_brute_force(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random(200).round(2), rng.random(60).round(2)
    left = spark.createDataFrame([(i, float(v)) for i, v in enumerate(a)], "i long, p double")
    right = spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "j long, q double")
    got = {r.i: r.nearest_id for r in joins.nearest_scalar(left, right, "p", "q", "j", cells=16).collect()}
    for i, v in enumerate(a):
        best = min(abs(b - v))
        assert abs(abs(b[got[i]] - v) - best) < 1e-12


def test_effects_recover_a_known_one(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4))
    t = (rng.random(600) < 1 / (1 + np.exp(-(0.7 * x[:, 0] - 0.3 * x[:, 1])))).astype(int)
    y = 0.5 * x[:, 0] + 0.2 * x[:, 2] + 0.3 * t + rng.normal(size=600) * 0.3
    rows = [("k", *map(float, x[i]), int(t[i]), float(y[i]), f"c{i // 2}") for i in range(600)]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double, d double, t int, y double, cl string")
    got = causal.agreement(causal.estimate_effects(df, ["g"], ["a", "b", "c", "d"], "t", "y", "cl")).first()
    for m in ("match", "dr", "dml"):
        assert abs(got[f"{m}_effect"] - 0.3) < 0.12
    assert got.verdict == "accept" and got.overlap > 0.9
    flags = causal.gate(spark.createDataFrame([("k", 0, "accept"), ("k", 1, "accept"), ("j", 0, "weak")], "kind string, band int, verdict string"), "kind", "band")
    assert {r.kind: r.passes for r in flags.collect()} == {"k": True, "j": False}


def test_lesson_flips_red(spark):
    rows = [("g", 0, 200, 0, 0.2, 0.9, 10), ("g", 1, 200, 0, 0.95, 0.75, 32)]
    got = cohort.lessons(spark.createDataFrame(rows, "game string, pos int, side int, won int, entropy double, rate double, size int"), "game").first()
    assert (got.pos, got.rate, got.kind, got.confidence, got.label) == (1, 0.25, "mistake", "weak", "8 of 32 cohort games ended in a win")


def test_upsert_wipes_names_but_keeps_ranks(spark):
    old = spark.createDataFrame([("p", "name#1", "GOLD", 5), ("q", "b#2", None, 1)], "puuid string, riot_id string, rank_tier string, last_updated long")
    new = spark.createDataFrame([("p", None, None, 3), ("r", "c#3", "IRON", 9)], old.schema)
    got = {r.puuid: tuple(r)[1:] for r in upsert.upsert(old, new, ["puuid"], {"riot_id": "take", "rank_tier": "keep", "last_updated": "take"}).collect()}
    assert got == {"p": (None, "GOLD", 3), "q": ("b#2", None, 1), "r": ("c#3", "IRON", 9)}
    merged = {r.puuid: r.last_updated for r in upsert.upsert(old, new, ["puuid"], {"riot_id": "keep", "rank_tier": "keep", "last_updated": "greatest"}).collect()}
    assert merged == {"p": 5, "q": 1, "r": 9}


def test_strided_and_balanced(spark):
    df = spark.range(100).withColumn("k", F.lit(1))
    assert [r.id for r in topk.strided(df, ["k"], ["id"], 8).orderBy("id").collect()] == list(range(0, 96, 12))
    labels = spark.range(50).withColumn("y", (F.col("id") < 10).cast("int"))
    assert {r.y: r["count"] for r in topk.balanced(labels, "y", "id", 1).groupBy("y").count().collect()} == {0: 10, 1: 10}


def timeline():
    stats = {"currentGold": 1, "totalGold": 2, "xp": 3, "level": 4, "minionsKilled": 5, "jungleMinionsKilled": 6, "position": {"x": 7, "y": 8}}
    item = lambda kind, i, **m: {"type": kind, "timestamp": 1, "participantId": 1, "itemId": i} | m
    first = [{"type": "CHAMPION_KILL", "timestamp": 70_000, "killerId": 1, "victimId": 6, "assistingParticipantIds": [2, 3], "position": {"x": 1, "y": 2}}, item("ITEM_PURCHASED", 10), item("ITEM_PURCHASED", 11), item("ITEM_PURCHASED", 10), item("ITEM_SOLD", 10)]
    second = [{"type": "ITEM_UNDO", "timestamp": 2, "participantId": 1, "beforeId": 11, "afterId": 12}, {"type": "WARD_PLACED", "timestamp": 3, "creatorId": 4, "wardType": "YELLOW"}]
    frames = [{"timestamp": 0, "events": [], "participantFrames": {str(s): stats for s in range(1, 11)}}, {"timestamp": 60_000, "events": first, "participantFrames": {str(s): stats for s in range(1, 11)}}, {"timestamp": 120_000, "events": second, "participantFrames": {str(s): stats for s in range(1, 11)}}, {"timestamp": 121_000, "events": [], "participantFrames": None}]
    return {"metadata": {"matchId": "NA1_1"}, "info": {"frameInterval": 60000, "frames": frames}}


def test_flatten_documents(spark, tmp_path):
    who = [{"participantId": s, "puuid": f"p{s}", "teamId": 100 if s <= 5 else 200, "teamPosition": "TOP", "win": s > 5, "championId": s, "riotIdGameName": "n", "riotIdTagline": "t"} for s in range(1, 11)]
    match = {"metadata": {"matchId": "NA1_1", "participants": []}, "info": {"gameVersion": "14.9.581.1", "queueId": 420, "gameDuration": 1800, "gameCreation": 5, "platformId": "NA1", "participants": who}}
    (tmp_path / "m.json").write_text(json.dumps(match))
    (tmp_path / "t.json.gz").write_bytes(gzip.compress(json.dumps(timeline()).encode()))
    m, t = matches.read_matches(spark, str(tmp_path / "m.json")), matches.read_timelines(spark, str(tmp_path / "t.json.gz"))
    assert matches.games(m).first().asDict() == {"match_id": "NA1_1", "patch": "14.9.581.1", "queue_id": 420, "game_duration_s": 1800, "winning_team": 200, "created_at": 5}
    assert matches.live_patch(m, "14.8").count() == 0 and matches.live_patch(m, "14.9").count() == 1
    rows = {(r.participant_slot, r.timestamp_ms): r for r in matches.frames(m, t).collect()}
    assert len(rows) == 30
    # the kill has a later time than its frame, and yet the frame shows it
    assert (rows[1, 60_000].kills, rows[6, 60_000].deaths, rows[2, 60_000].assists, rows[1, 0].kills) == (1, 1, 1, 0)
    assert rows[1, 60_000].item_ids == [11, 10] and rows[1, 120_000].item_ids == [10, 12] and rows[4, 120_000].ward_count == 1
    assert (rows[1, 0].cs, rows[1, 0].jungle_cs, rows[1, 0].role) == (5, 6, "TOP")
    got = matches.events(t).filter("event_type = 'WARD_PLACED'").first()
    assert json.loads(got.details) == {"creatorId": 4, "wardType": "YELLOW"} and got.participant_id is None
    assert matches.participants(m).first().riot_id == "n#t"


def test_blobs_lines_store(spark, tmp_path):
    rows = spark.createDataFrame([("a", "{}"), ("b", None)], "match_id string, j string")
    back = files.gunzipped(files.gzipped(rows, ["j"]), ["j"])
    assert back.collect() == rows.collect()
    assert files.gunzipped(spark.createDataFrame([("x", bytearray(b"no gzip"))], "k string, j binary"), ["j"]).first().j is None
    files.write_lines(spark.createDataFrame([("b",), ("a",)], "id string"), "id", str(tmp_path / "ids"))
    (tmp_path / "more.txt").write_text(" x \n\n y\n")
    assert [r.value for r in files.lines(spark, str(tmp_path / "more.txt")).collect()] == ["x", "y"]
    assert sorted(r.value for r in files.lines(spark, str(tmp_path / "ids")).collect()) == ["a", "b"]
    calls = []
    store = files.SampleStore(spark, str(tmp_path / "store"))
    make = lambda: calls.append(1) or spark.range(3).toDF("n")
    assert store.get(make, "v1", 2).count() == 3 and store.get(make, "v1", 2).count() == 3 and len(calls) == 1
    store.get(make, "v1", 3)
    store.drop("v1", 2)
    store.get(make, "v1", 2)
    assert len(calls) == 3
    path = str(tmp_path / "seed.json")
    assert files.cached_json(spark, path, lambda: {"a": 1}) == {"a": 1} and files.cached_json(spark, path, lambda: {"a": 2}) == {"a": 1}
    assert files.cached_json(spark, path, lambda: {"a": 2}, ttl_s=0) == {"a": 2}
    assert files.markdown([{"k": 16, "h": 0.65}], ["k", "h"]) == "| k | h |\n| --- | --- |\n| 16 | 0.650 |"
    locked = schemas.lock(schemas.table("games"))
    assert schemas.drift(schemas.table("games"), locked) == [] and schemas.drift(schemas.table("players"), locked)


def test_review_queries(spark, two_frames):
    from matchlake.plans import engine, review

    frames, events, played = two_frames
    concepts = spark.createDataFrame([("c1", "Gold", "", "team_gold_lead", 0.5, "", ""), ("c2", "Kills", "", "kill_diff", 0.2, "", "")], schemas.table("concepts"))
    told = spark.createDataFrame([("M1", 600_000, c, 100, "d", s) for c, s in (("c1", 9.0), ("c2", 1.0))], schemas.table("key_moments"))
    mine, weights = review.player_review(frames, played, told, concepts, "p1")
    row = mine.first()
    assert [m.concept_id for m in row.moments] == ["c1", "c2"]
    assert [(r.concept_id, r.n, r.weight) for r in weights.collect()] == [("c1", 2, 1.0), ("c2", 2, 0.4)]  # two frames fan out
    game = review.game_review(played, frames, events, told, concepts, "M1").first()
    assert len(game.frames) == 20 and len(game.events) == 2 and len(game.moments) == 2
    assert review.dispatch({}, {"action": "x"}) == {"error": "Unknown action: x"}
    tables = {"players": spark.createDataFrame([("p1", "n#t", "GOLD", "I", 5, 1)], schemas.table("players")), "games": played, "frames": frames, "events": events, "concepts": concepts, "key_moments": told}
    answer = json.loads(review.reply(tables, {"action": "review", "puuid": "p1"}))
    assert answer["player"]["rank_tier"] == "GOLD" and answer["games"][0]["won"] and [m["concept_id"] for m in answer["games"][0]["moments"]] == ["c1", "c2"] and len(answer["concepts"]) == 2
    assert json.loads(review.reply(tables, {"action": "review", "puuid": "x"})) == {"error": "Player not found"}
    assert len(json.loads(review.reply(tables, {"action": "game", "match_id": "M1", "puuid": "p1"}))["objectives"]) == 2
    cost = engine.match_cost(frames, events).first()
    assert (cost.n_anchors, cost.n_events) == (2, 2)
    assert engine.escalate(3, 2, False) == (4, 0) and engine.escalate(3, 1, True) == (3, 0)
    assert engine.runtime_projection(0.434, 13_061, 30)["passes"]
    queue = spark.createDataFrame([("a", 5.0), ("b", 9.0)], "puuid string, score double")
    busy = spark.createDataFrame([("c",)], "puuid string")
    assert engine.pop_highest(engine.recover(queue, busy)).first().puuid == "b"
    seeded = spark.createDataFrame([("a", 1_000)], "puuid string, seeded_at long")
    assert engine.seed_batch(queue, busy, seeded, 2_000).count() == 1 and engine.seed_batch(queue, busy, seeded, 90_000).count() == 2


def test_cooldown_stream(spark, tmp_path):
    from matchlake.streaming.workers import cooled_down, drain

    spark.createDataFrame([("a", 0), ("a", 50), ("a", 100), ("b", 10)], "k string, us long").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k string, us long").parquet(str(tmp_path / "in"))
    out = []
    drain(cooled_down(source, "k", "us", 100), lambda df, n: out.extend((r.k, r.us) for r in df.collect()), str(tmp_path / "ck"))
    assert sorted(out) == [("a", 0), ("a", 100), ("b", 10)]


def test_payloads_and_decisions(spark):
    frames = table(spark, "frames", [frame(slot=1, ts=t, pos_x=5000) for t in (0, 60_000, 120_000)])
    marks = table(spark, "events", [event(ts=1, kind="ELITE_MONSTER_KILL", killer_id=3, details='{"monsterType":"dragon","monsterSubType":"FIRE_DRAGON"}'), event(ts=2, kind="ITEM_PURCHASED", participant_id=3, details='{"itemId":20000}'), event(ts=3, kind="SKILL_LEVEL_UP", participant_id=3, details="no json"), event(ts=61_000, kind="BUILDING_KILL", killer_id=2, details='{"buildingType":"X","laneType":"MID_LANE"}')])
    rows = tokens.token_stream(frames, marks).orderBy("pos").collect()
    assert [(r.kind_id, r.monster_type_id, r.monster_subtype_id, r.item_id, r.building_type_id, r.lane_type_id, r.tower_type_id) for r in rows if r.kind_id] == [(10, 2, 5, 0, 0, 0, 0), (12, 0, 0, 0, 0, 0, 0), (13, 0, 0, 0, 0, 0, 0), (9, 0, 0, 0, 1, 3, 0)]
    made = {(r.anchor, r.actor): r.decision for r in tokens.decision_labels(tokens.token_stream(frames, marks)).collect()}
    assert made[1, 3] == 1 and made[1, 1] == 6 and made[2, 3] == 6 and len(made) == 30


def test_macro_state(spark, two_frames):
    frames, events, _ = two_frames
    more = table(spark, "events", [event(ts=100, kind="TURRET_PLATE_DESTROYED", details='{"teamId":200}'), event(ts=600_000, kind="ELITE_MONSTER_KILL", killer_team=200, details='{"monsterType":"BARON_NASHOR"}')])
    got = {r.timestamp_ms: r for r in tokens.macro_state(frames, events.unionByName(more)).collect()}
    last = got[600_000]
    assert last.gold_diff == pytest.approx(4000 / 25000) and last.kill_diff == pytest.approx(5 / 30) and last.tower_diff == pytest.approx(-1 / 11)
    assert (last.plate_diff, last.baron_present, last.blue_dragon_count) == (pytest.approx(1 / 15), 1.0, pytest.approx(1 / 6)) and last.baron_diff == pytest.approx(-1 / 3)
    assert got[0].baron_present == 0.0 and last.red_centroid_x == pytest.approx(8000 / 15000)


def test_static_vectors(spark, tmp_path):
    from matchlake.operators import static

    who = [{"participantId": s, "puuid": f"p{s}", "teamId": 100 if s <= 5 else 200, "championId": s * 10} for s in range(1, 4)]
    match = {"metadata": {"matchId": "EUW1_1"}, "info": {"gameVersion": "14.9.581.1", "queueId": 420, "gameCreation": 13 * 3_600_000, "platformId": "euw1", "participants": who}}
    (tmp_path / "m.json").write_text(json.dumps(match))
    m = matches.read_matches(spark, str(tmp_path / "m.json"))
    bare = static.static_vectors(m).first().vector
    assert len(bare) == 1047 and bare[:4] == [10.0, 20.0, 30.0, 0.0] and bare[20:23] == [420.0, 3.0, 3.0] and bare[23 + 120 : 23 + 123] == [14.0, 9.0, 1.0] and sum(bare[23 : 23 + 120]) == 0
    champions = spark.createDataFrame([("14.9.1", "20", {"hp": 600.0, "attackspeed": 0.6})], "version string, key string, stats map<string,double>")
    items = spark.createDataFrame([("14.9.1", {"FlatArmorMod": 30.0}), ("14.9.1", {"FlatArmorMod": 5.0, "x": 1.0})], "version string, stats map<string,double>")
    full = static.static_vectors(m, champions, items).first().vector
    assert full[23 + 10] == 600.0 and full[23 + 19] == 0.6 and full[23 + 102] == 35.0 and len(full) == 1047
    assert static.static_anchors(static.static_vectors(m), table(spark, "frames", [frame("EUW1_1", ts=t) for t in (0, 1)])).count() == 2


def test_rank_probe(spark):
    from matchlake.operators.probe import classify_rank_use, rank_probe

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=3) + (i % 3)], i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, v array<double>, band int")
    assert rank_probe(df, "k", "v", "band") > 0.75
    assert np.isnan(rank_probe(df.limit(50), "k", "v", "band"))
    assert classify_rank_use({"player_emb": 0.74, "h_t": 0.83, "post_mu": 0.6}, 0.06) == "mixed_or_unclear"
    assert classify_rank_use({"player_emb": 0.74, "h_t": 0.5}, 0.06) == "under_use" and classify_rank_use({"h_t": 0.8, "post_mu": 0.7}, 0.05) == "over_leak"


def test_hedges_and_labels(spark):
    from matchlake.functions import scalars as s

    row = spark.range(1).select(s.hedged(F.lit(" The fight goes your way "), F.lit("strong")).alias("a"), s.size_label(F.lit(16)).alias("b"), s.tier_band(F.lit(6)).alias("c"), s.band_distance(F.lit(-1), F.lit(2)).alias("d"), s.route_of(F.lit("KR_123")).alias("e"), s.route_of(F.lit("zz_1")).alias("f"), s.shifted_label(F.lit(8)).alias("g"), s.unshifted_label(F.lit(1)).alias("h"), s.remove_first(F.array(F.lit(1), F.lit(2), F.lit(1)), F.lit(1)).alias("i"), s.clamp(F.lit(None).cast("int"), 0, 1).alias("j"), s.symmetric_gaussian_kl(F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(1.0)).alias("k")).first()
    assert tuple(row) == ("In most cohort games, the fight goes your way.", "16 near-neighbors", 2, 4, "asia", "americas", 1, 8, [2, 1], None, 0.0)


def test_derived_match_tables_are_dealt_and_not_taken_for_small(spark, tmp_path):
    """Frames of many matches are made in many tasks, and their size isn't that of the suppliers' file, for which Spark would broadcast them."""
    from matchlake.plans import telemetry
    from matchlake.plans.registry import QUERIES, Tables

    spark.range(2_000).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    frames = telemetry.frames(Tables(spark, str(tmp_path)))
    each = frames.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in each) == 240_000 and len(each) > 2 and max(r["count"] for r in each) < 120_000
    for name in ("c10_token_stream", "c13_engages"):
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
