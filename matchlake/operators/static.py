"""Static vectors of a match: champions, sides, queue, region, hours, patch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.functions.scalars import asset_version, clamp, hour_bucket, lookup, version_parts

SLOTS, PATCH_WIDTH, MAX_QUEUE = 10, 1024, 2000
#: Platforms in the order of their region ids, from 1. Fixed values.
PLATFORMS = ("BR1", "EUN1", "EUW1", "JP1", "KR", "LA1", "LA2", "ME1", "NA1", "OC1", "PH2", "RU", "SG2", "TH2", "TR1", "TW2", "VN2")
#: Champion statistics in a patch vector, by slot. Fixed values.
CHAMPION_STATS = ("hp", "hpperlevel", "mp", "mpperlevel", "armor", "armorperlevel", "attackdamage", "attackdamageperlevel", "attackspeedoffset", "attackspeed")
#: Item statistics summed over a patch's items, in order. Fixed values.
ITEM_STATS = (
    "FlatPhysicalDamageMod", "FlatMagicDamageMod", "FlatArmorMod", "FlatSpellBlockMod", "FlatHPPoolMod", "FlatMPPoolMod", "PercentAttackSpeedMod",
    "FlatCritChanceMod", "FlatMovementSpeedMod", "FlatHPRegenMod", "PercentLifeStealMod", "FlatBlockMod", "FlatEnergyPoolMod", "FlatMagicPenetrationMod",
    "FlatPhysicalDamageReduction", "FlatArmorPenetrationMod", "PercentMovementSpeedMod", "PercentArmorMod", "PercentMagicPenetrationMod", "PercentCritChanceMod",
)


def item_totals(items: DataFrame) -> DataFrame:
    """version, totals: sums of the item statistics of each asset version (A33). items: version, stats map."""
    sums = [F.sum(F.coalesce(F.try_element_at(F.col("stats"), F.lit(k)), F.lit(0.0))) for k in ITEM_STATS]
    return items.groupBy("version").agg(F.array(*sums).alias("totals"))


def _padded(values: Column, width: int) -> Column:
    return F.slice(F.concat(values, F.array_repeat(F.lit(0.0), F.lit(width))), F.lit(1), F.lit(width))


def static_vectors(matches: DataFrame, champions: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """match_id, vector: champion ids, red flags, queue, region, hours, then the patch vector.

    With champions (version, key, stats map) and items (version, stats map) the patch vector is full: slots'
    champion statistics and item totals; without them it holds the version's parts only. Both tables are one
    patch's worth of rows a version.
    """
    people = F.slice("info.participants", 1, SLOTS)
    numbers = lambda f: _padded(F.transform(people, lambda p: f(p).cast("double")), SLOTS)
    version = asset_version(F.coalesce("info.gameVersion", F.lit("")))
    version = F.when(F.coalesce("info.gameVersion", F.lit("")) == "", F.lit("14.14.1")).otherwise(version)
    region = F.coalesce(lookup(F.upper(F.col("info.platformId")), {p: k for k, p in enumerate(PLATFORMS, 1)}), F.lit(0))
    rows = matches.select(
        F.col("metadata.matchId").alias("match_id"),
        version.alias("version"),
        F.transform(people, lambda p: p["championId"].cast("string")).alias("_keys"),
        F.concat(
            numbers(lambda p: F.coalesce(p["championId"], F.lit(0))),
            numbers(lambda p: F.when(p["teamId"] == 200, 1.0).otherwise(0.0)),
            F.array(clamp(F.coalesce("info.queueId", F.lit(0)), 0, MAX_QUEUE).cast("double"), region.cast("double"), hour_bucket(F.col("info.gameCreation")).cast("double")),
        ).alias("_head"),
    )
    blank = F.array_repeat(F.lit(0.0), F.lit(SLOTS * len(CHAMPION_STATS)))
    if champions is not None:
        stat = F.array(*(F.coalesce(F.try_element_at(F.col("stats"), F.lit(k)), F.lit(0.0)) for k in CHAMPION_STATS))
        wide = champions.groupBy("version").agg(F.map_from_entries(F.collect_list(F.struct(F.col("key").cast("string"), stat))).alias("_champions"))
        rows = rows.join(wide, "version", "left")
        zero = F.array_repeat(F.lit(0.0), F.lit(len(CHAMPION_STATS)))
        own = _padded(F.flatten(F.transform("_keys", lambda k: F.coalesce(F.try_element_at(F.col("_champions"), k), zero))), SLOTS * len(CHAMPION_STATS))
        blank = F.when(F.col("_champions").isNotNull(), own).otherwise(blank)
    totals = F.array_repeat(F.lit(0.0), F.lit(len(ITEM_STATS)))
    if items is not None:
        rows = rows.join(item_totals(items), "version", "left")
        totals = F.coalesce("totals", totals)
    patch = _padded(F.concat(blank, totals, F.transform(version_parts(F.col("version")), lambda x: x.cast("double"))), PATCH_WIDTH)
    return rows.select("match_id", F.concat("_head", patch).alias("vector"))


def static_anchors(vectors: DataFrame, frames: DataFrame) -> DataFrame:
    """The match's static vector at each of its anchors."""
    return frames.select("match_id", "timestamp_ms").distinct().join(vectors, "match_id")
