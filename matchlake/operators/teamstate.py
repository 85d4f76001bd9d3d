"""Team state per frame, team feature vectors, concepts and key moments."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.scalars import describe_move, minutes, title_of
from matchlake.operators.temporal import so_far

#: Objectives counted for a team, by monster. Fixed values.
OBJECTIVES = {"dragon_count": "DRAGON", "baron_count": "BARON_NASHOR", "herald_count": "RIFTHERALD", "horde_count": "HORDE"}
#: Differences to the other team, and the state that each is of. Fixed values.
DIFFS = {
    "team_gold_lead": "total_gold",
    "team_xp_lead": "total_xp",
    "team_cs_lead": "total_cs",
    "team_kill_lead": "kills",
    "team_ward_diff": "ward_count",
    "team_dragon_diff": "dragon_count",
    "team_tower_diff": "tower_count",
    "team_baron_diff": "baron_count",
    "team_herald_diff": "herald_count",
}
#: Own state in a vector, and its source. Fixed values.
OWN = {
    "team_total_gold": "total_gold",
    "team_avg_level": "avg_level",
    "team_dragons": "dragon_count",
    "team_towers": "tower_count",
    "team_barons": "baron_count",
    "team_wards": "ward_count",
    "team_spread": "spread",
}
#: What concepts are learned from, in this order. Fixed values.
LEARNED = ("team_gold_lead", "team_xp_lead", "team_cs_lead", "team_kill_lead", "team_ward_diff", "team_dragon_diff", "team_tower_diff", "team_baron_diff", "team_herald_diff", "team_spread")
#: Name, category and game phase of each concept. Fixed values.
MEANING = {
    "team_gold_lead": ("Gold Advantage", "economy", "all"),
    "team_xp_lead": ("Experience Lead", "economy", "early"),
    "team_kill_lead": ("Kill Pressure", "fighting", "all"),
    "team_dragon_diff": ("Dragon Control", "objectives", "mid"),
    "team_tower_diff": ("Tower Pressure", "objectives", "all"),
    "team_baron_diff": ("Baron Control", "objectives", "late"),
    "team_herald_diff": ("Rift Herald Usage", "objectives", "early"),
    "team_ward_diff": ("Vision Control", "vision", "all"),
    "team_cs_lead": ("Farming Efficiency", "economy", "early"),
    "team_spread": ("Team Positioning", "macro", "mid"),
}
#: Least change that makes a moment; 1 for any other feature. Fixed values.
THRESHOLDS = {
    "team_gold_lead": 1500.0,
    "team_xp_lead": 1000.0,
    "team_cs_lead": 15.0,
    "team_kill_lead": 2.0,
    "team_ward_diff": 3.0,
    "team_dragon_diff": 1.0,
    "team_tower_diff": 1.0,
    "team_baron_diff": 1.0,
    "team_herald_diff": 1.0,
    "team_spread": 1500.0,
}
DEFAULT_THRESHOLD = 1.0
MOMENTS = 10


def game_states(frames: DataFrame, events: DataFrame) -> DataFrame:
    """match_id, timestamp_ms, team_id with summed stats, spread, and objectives taken so far, ties included.

    A tower counts for the team that did not lose it.
    """
    state = frames.groupBy("match_id", "timestamp_ms", "team_id").agg(
        F.sum("total_gold").alias("total_gold"),
        F.sum("xp").alias("total_xp"),
        F.sum(F.col("cs") + F.col("jungle_cs")).alias("total_cs"),
        *(F.sum(c).alias(c) for c in ("ward_count", "kills", "deaths")),
        F.avg("pos_x").alias("centroid_x"),
        F.avg("pos_y").alias("centroid_y"),
        F.sqrt(F.var_pop("pos_x") + F.var_pop("pos_y")).alias("spread"),
        F.avg("level").alias("avg_level"),
    )
    kind = F.get_json_object("details", "$.monsterType")
    killed = F.col("event_type") == "ELITE_MONSTER_KILL"
    tower = (F.col("event_type") == "BUILDING_KILL") & (F.get_json_object("details", "$.buildingType") == "TOWER_BUILDING")
    scorer = F.when(killed, F.col("killer_team")).when(tower, F.when(F.col("team_id") == 100, 200).when(F.col("team_id") == 200, 100))
    counted = [F.coalesce((killed & (kind == m)).cast("int"), F.lit(0)).alias(n) for n, m in OBJECTIVES.items()]
    marks = events.select("match_id", "timestamp_ms", scorer.alias("team_id"), *counted, F.coalesce(tower.cast("int"), F.lit(0)).alias("tower_count")).filter(F.col("team_id").isin(100, 200))
    both = state.withColumn("_state", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    over = so_far(["match_id", "team_id"], "timestamp_ms")
    names = [*OBJECTIVES, "tower_count"]
    return both.withColumns({n: F.coalesce(F.sum(n).over(over), F.lit(0)) for n in names}).filter("_state").drop("_state")


def feature_vectors(states: DataFrame, games: DataFrame) -> DataFrame:
    """Two rows a timestamp, each team against the other; timestamps with one team only fall out (C4)."""
    other = states.select("match_id", "timestamp_ms", (300 - F.col("team_id")).alias("team_id"), *(F.col(c).alias(f"_{c}") for c in DIFFS.values()))
    rows = states.join(other, ["match_id", "timestamp_ms", "team_id"]).join(games.select("match_id", "winning_team"), "match_id")
    return rows.select("match_id", "timestamp_ms", "team_id", minutes(F.col("timestamp_ms")).alias("minutes"), *((F.col(c) - F.col(f"_{c}")).alias(n) for n, c in DIFFS.items()), *(F.col(c).alias(n) for n, c in OWN.items()), (F.col("team_id") == F.col("winning_team")).cast("int").alias("won"))


def discover_concepts(vectors: DataFrame, features: list[str], seed: int = 42, least: float = 0.01, rows: int = 20, trees: int = 100) -> DataFrame:
    """concept_id, feature_key, name, importance of the features that tell winners; none under so many rows."""
    spark = vectors.sparkSession
    schema = "concept_id string, name string, explanation string, feature_key string, importance double, game_phase string, category string"
    if vectors.count() < rows:
        return spark.createDataFrame([], schema)
    data = VectorAssembler(inputCols=features, outputCol="x", handleInvalid="skip").transform(vectors.withColumn("y", F.col("won").cast("double")))
    model = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, seed=seed).fit(data)
    found = sorted(((float(w), f) for f, w in zip(features, model.featureImportances.toArray(), strict=True) if w >= least), key=lambda x: (-x[0], x[1]))
    rows = [(f"concept_{f}", MEANING.get(f, (None,))[0], f"This measures {f.replace('_', ' ')}.", f, w, MEANING.get(f, ("", "", "all"))[2], MEANING.get(f, ("", "general"))[1]) for w, f in found]
    return spark.createDataFrame(rows, schema).withColumn("name", F.coalesce("name", title_of(F.col("feature_key"))))


def impurity_gains(vectors: DataFrame, features: list[str], label: str = "won", bins: int = 32) -> DataFrame:
    """feature_key, gain: the largest fall in Gini impurity of a 0/1 label that one cut of a feature brings, over the edges of equal bins of its range.

    One pass for the ranges, one for counts by feature and bin, of which there are `bins` a feature whatever the rows. Null values fall out.
    """
    tall = vectors.select(F.col(label).cast("long").alias("y"), F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("v")) for f in features))).alias("x")).select("y", "x.f", "x.v").filter("v IS NOT NULL AND y IS NOT NULL")
    ranges = tall.groupBy("f").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    cell = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = tall.join(F.broadcast(ranges), "f").groupBy("f", cell.alias("cell")).agg(F.count("*").alias("n"), F.sum("y").alias("w"))  # a range a feature
    upto, every = Window.partitionBy("f").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("f")
    cuts = counts.select("f", F.sum("n").over(upto).alias("n1"), F.sum("w").over(upto).alias("w1"), F.sum("n").over(every).alias("n"), F.sum("w").over(every).alias("w"))
    gini = lambda w, n: 2 * (w / n) * (1 - w / n)
    n1, w1, n, w = (F.col(c) for c in ("n1", "w1", "n", "w"))
    gain = F.when(n1 < n, gini(w, n) - n1 / n * gini(w1, n1) - (n - n1) / n * gini(w - w1, F.when(n1 < n, n - n1)))
    return cuts.groupBy(F.col("f").alias("feature_key")).agg(F.greatest(F.coalesce(F.max(gain), F.lit(0.0)), F.lit(0.0)).alias("gain"))


def concepts_by_impurity(vectors: DataFrame, features: list[str], least: float = 0.01, rows: int = 20, bins: int = 32) -> DataFrame:
    """discover_concepts() with each feature's share of all gains as its importance: no fit, no seed, one pass over the vectors."""
    gains = impurity_gains(vectors, features, bins=bins)
    total = vectors.agg(F.count("*").alias("_rows")).crossJoin(gains.agg(F.sum("gain").alias("_sum")))  # one row
    known = {f: MEANING.get(f, (None, "general", "all")) for f in features}
    of = lambda k: F.try_element_at(F.create_map(*(x for f in features for x in (F.lit(f), F.lit(known[f][k]).cast("string")))), F.col("feature_key"))
    shares = gains.crossJoin(F.broadcast(total)).withColumn("importance", F.when(F.col("_sum") > 0, F.col("gain") / F.col("_sum")))
    shares = shares.filter((F.col("_rows") >= rows) & (F.col("importance") >= least))
    explanation = F.concat(F.lit("This measures "), F.replace("feature_key", F.lit("_"), F.lit(" ")), F.lit("."))
    return shares.select(F.concat(F.lit("concept_"), "feature_key").alias("concept_id"), F.coalesce(of(0), title_of(F.col("feature_key"))).alias("name"), explanation.alias("explanation"), "feature_key", "importance", of(2).alias("game_phase"), of(1).alias("category"))


def key_moments(vectors: DataFrame, concepts: DataFrame, keep_all_teams: bool = False) -> DataFrame:
    """The MOMENTS largest changes of each match.

    The stored table's key lacks the team, so of two teams with the same time and concept the later one stays,
    team 200; keep_all_teams keeps both.
    """
    keys = [c for c in (*DIFFS, *OWN) if c in vectors.columns]
    names = F.array(*(F.lit(c) for c in keys))
    values = F.array(*(F.col(c).cast("double") for c in keys))
    tall = vectors.select("match_id", "timestamp_ms", "team_id", "minutes", F.explode(F.arrays_zip(names.alias("feature_key"), values.alias("value"))).alias("f")).select("match_id", "timestamp_ms", "team_id", "minutes", F.col("f.feature_key").alias("feature_key"), F.col("f.value").alias("value"))
    rows = tall.join(concepts, "feature_key")
    delta = F.col("value") - F.lag("value").over(Window.partitionBy("match_id", "team_id", "feature_key").orderBy("timestamp_ms"))
    least = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in THRESHOLDS.items() for x in p)), F.col("feature_key")), F.lit(DEFAULT_THRESHOLD))
    rows = rows.withColumn("delta", delta).filter(F.abs("delta") >= least)
    rows = rows.withColumn("impact_score", F.abs("delta") * F.col("importance")).withColumn("description", describe_move(F.col("name"), F.col("delta"), F.col("minutes"), F.col("explanation")))
    order = Window.partitionBy("match_id").orderBy(F.desc("impact_score"), F.desc("importance"), "concept_id", "team_id", "timestamp_ms")
    rows = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= MOMENTS)
    if not keep_all_teams:
        last = Window.partitionBy("match_id", "timestamp_ms", "concept_id").orderBy(F.desc("place"))
        rows = rows.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn")
    return rows.select("match_id", "timestamp_ms", "concept_id", "team_id", "description", "impact_score", "place")
