"""Scalar columns of the telemetry model: versions, ids, ranks, clocks, text, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rank tiers in ascending order. Fixed values.
TIERS = ("IRON", "BRONZE", "SILVER", "GOLD", "PLATINUM", "EMERALD", "DIAMOND", "MASTER", "GRANDMASTER", "CHALLENGER")
#: Routing region of each platform prefix. Fixed values.
ROUTES = {
    "americas": ("na1", "br1", "la1", "la2"),
    "asia": ("kr", "jp1"),
    "europe": ("euw1", "eun1", "tr1", "ru", "me1"),
    "sea": ("oc1", "ph2", "sg2", "th2", "tw2", "vn2"),
}


def lookup(key: Column, table: dict, default: object = None) -> Column:
    """table[key], default where the key is null or unknown."""
    pairs = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    found = F.element_at(pairs, key) if default is None else F.coalesce(F.element_at(pairs, key), F.lit(default))
    return found


def lookup_any_case(key: Column, table: dict[str, int], unknown: int = 1) -> Column:
    """table[key] or table[upper(key)]; unknown where neither is there; 0 for null."""
    return F.when(key.isNull(), F.lit(0)).otherwise(F.coalesce(lookup(key, table), lookup(F.upper(key), table), F.lit(unknown)))


def major_minor(version: Column) -> Column:
    """a.b of a.b.c; anything with fewer parts passes through (F1)."""
    return F.substring_index(version, ".", 2)


def asset_version(version: Column, default: str = "14.14.1") -> Column:
    """a.b.1, or the default where there are not two parts (F2)."""
    parts = F.split(version, r"\.")
    return F.when(F.size(parts) >= 2, F.concat_ws(".", parts[0], parts[1], F.lit("1"))).otherwise(F.lit(default))


def version_parts(version: Column, n: int = 3) -> Column:
    """The first n parts as integers; a part that is not all digits, or is missing, is 0."""
    parts = F.split(version, r"\.")
    number = lambda k: F.when(F.get(parts, F.lit(k)).rlike("^[0-9]+$"), F.get(parts, F.lit(k)).try_cast("int"))
    return F.array(*(F.coalesce(number(k), F.lit(0)) for k in range(n)))


def route_of(match_id: Column, default: str = "americas") -> Column:
    """Routing region of the platform before the underscore."""
    return lookup(F.lower(F.substring_index(match_id, "_", 1)), {p: r for r, ps in ROUTES.items() for p in ps}, default)


def tier_number(tier: Column) -> Column:
    return lookup(tier, {t: k for k, t in enumerate(TIERS, 1)}, 0)


def tier_band(number: Column) -> Column:
    """Bands of tiers: -1 unranked, then 0 to 3."""
    return F.when(number <= 0, -1).when(number <= 3, 0).when(number <= 5, 1).when(number <= 7, 2).otherwise(3)


def band_distance(a: Column, b: Column, apart: int = 4) -> Column:
    """Steps between two bands; apart where either is unranked."""
    return F.when((a < 0) | (b < 0), F.lit(apart)).otherwise(F.abs(a - b))


def seed_priority(tier: Column, lp: Column) -> Column:
    """1000 a tier and the league points, if any (F6, seeding)."""
    return 1000 * tier + F.greatest(F.coalesce(lp, F.lit(0)), F.lit(0))


def parse_priority(tier: Column, lp: Column) -> Column:
    """1, 100 a tier and the league points, if any (F6, parsing)."""
    return 1 + 100 * tier + F.greatest(F.coalesce(lp, F.lit(0)), F.lit(0))


def minutes(ms: Column) -> Column:
    return ms / F.lit(60000.0)


def anchor_minute(ms: Column) -> Column:
    """The nearest minute; half goes to even (F8)."""
    return F.bround(ms / F.lit(60000.0)).cast("int")


def hour_bucket(ms: Column) -> Column:
    """0 for no time; then UTC hours 0-5, 6-11, 12-17, 18-23."""
    hour = F.pmod(F.floor(ms / 3600000), F.lit(24))
    return F.when(ms.isNull() | (ms == 0), 0).when(hour < 6, 1).when(hour < 12, 2).when(hour < 18, 3).otherwise(4)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def in_range_or_zero(x: Column, low: int, high: int) -> Column:
    """x, or 0 outside its range rather than the nearest bound."""
    return F.when(x.between(low, high), x).otherwise(F.lit(0))


def binary_entropy(p: Column) -> Column:
    """Bits of a coin with probability p; 0 at the ends."""
    inner = -(p * F.log2(p) + (1 - p) * F.log2(1 - p))
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(inner)


def bernoulli_kl(p: Column, q: Column, floor: float = 1e-6) -> Column:
    """KL(p || q) in nats, both clamped off the ends."""
    p, q = clamp(p, floor, 1 - floor), clamp(q, floor, 1 - floor)
    return p * F.log(p / q) + (1 - p) * F.log((1 - p) / (1 - q))


def gaussian_kl(mu: Column, sd: Column, mu2: Column, sd2: Column) -> Column:
    return F.log(sd2 / sd) + (sd * sd + (mu - mu2) * (mu - mu2)) / (2 * sd2 * sd2) - 0.5


def symmetric_gaussian_kl(mu: Column, sd: Column, mu2: Column, sd2: Column) -> Column:
    return 0.5 * (gaussian_kl(mu, sd, mu2, sd2) + gaussian_kl(mu2, sd2, mu, sd))


def hash_share(key: Column) -> Column:
    """The low 32 bits of SHA-1, as a share of all such numbers."""
    return F.conv(F.right(F.sha1(F.encode(key, "UTF-8")), F.lit(8)), 16, 10).cast("double") / F.lit(float(1 << 32))


def seeded(seed: int, *keys: Column) -> Column:
    """SHA-1 of a seed and keys: an order that depends on nothing else."""
    return F.sha1(F.encode(F.concat_ws(":", F.lit(seed).cast("string"), *(k.cast("string") for k in keys)), "UTF-8"))


def content_key(*parts: Column) -> Column:
    """First 16 hex digits of SHA-256 over the parts with a NUL after each."""
    joined = F.concat(*(x for p in parts for x in (F.encode(p.cast("string"), "UTF-8"), F.lit(bytearray(b"\x00")))))
    return F.left(F.sha2(joined, 256), F.lit(16))


def remove_first(items: Column, item: Column) -> Column:
    """An array without the first element equal to item; itself where there is none."""
    at = F.array_position(items, item).cast("int")
    return F.when(at > 0, F.concat(F.slice(items, F.lit(1), at - 1), F.slice(items, at + 1, F.size(items)))).otherwise(items)


def inventory(moves: Column) -> Column:
    """Items left after ordered moves (kind, item, before, after): buy, drop, undo."""

    def step(items: Column, move: Column) -> Column:
        back = F.when(move["before"] > 0, remove_first(items, move["before"])).otherwise(items)
        undone = F.when(move["after"] > 0, F.array_append(back, move["after"])).otherwise(back)
        bought, dropped = F.array_append(items, move["item"]), remove_first(items, move["item"])
        return F.when(move["kind"] == "buy", bought).when(move["kind"] == "drop", dropped).when(move["kind"] == "undo", undone).otherwise(items)

    return F.aggregate(moves, F.array().cast("array<int>"), step)


def slug(text: Column, longest: int = 64, default: str = "unknown") -> Column:
    """Lower case, runs of other characters to one dash, dashes off the ends, cut."""
    lowered = F.lower(F.trim(text))
    dashed = F.left(F.regexp_replace(lowered, "[^a-z0-9_-]+", "-"), F.lit(longest))
    return F.when(dashed.isNull() | (dashed == ""), F.lit(default)).otherwise(dashed)


def is_email(text: Column) -> Column:
    mail = F.lower(F.trim(text))
    return mail.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$") & (F.length(mail) <= 254)


def confidence_band(entropy: Column) -> Column:
    """strong under 0.3 bits, moderate under 0.7, else weak."""
    return F.when(entropy < 0.3, "strong").when(entropy < 0.7, "moderate").otherwise("weak")


def hedged(claim: Column, confidence: Column) -> Column:
    """A claim, first letter lowered, behind the words that fit the confidence."""
    bare = F.trim(claim)
    bare = F.when(F.left(bare, F.lit(1)).rlike("^[A-Z]"), F.concat(F.lower(F.left(bare, F.lit(1))), F.substring(bare, F.lit(2), F.length(bare)))).otherwise(bare)
    lead = F.when(confidence == "strong", "In most cohort games, ").when(confidence == "moderate", "Cohort evidence suggests ").otherwise("This signal is noisy, but ")
    return F.concat(lead, bare, F.lit("."))


def size_label(size: Column) -> Column:
    """How a cohort's size is named: 64 and more, 16 and more, fewer."""
    return F.concat_ws(" ", size.cast("string"), F.when(size >= 64, "similar games").when(size >= 16, "near-neighbors").otherwise("cohort games"))


def wins_label(rate: Column, size: Column) -> Column:
    """Wins of a cohort, rounded half up as browsers do."""
    return F.format_string("%d of %d cohort games ended in a win", F.floor(rate * size + 0.5), size)


def time_encoding(ms: Column, width: int = 8) -> Column:
    """Sines and cosines of a time at geometric rates."""
    angle = lambda k: (ms / F.lit(1000.0)) * F.exp(k.cast("double") * (-9.210340371976184 / width))
    steps = F.sequence(F.lit(0), F.lit(width - 2), F.lit(2))
    return F.flatten(F.transform(steps, lambda k: F.array(F.sin(angle(k)), F.cos(angle(k)))))


def shifted_label(kind: Column, first: int = 8) -> Column:
    """Dense label of an event kind from 1; 0 for kinds that are no events."""
    return F.when(kind >= first, kind - first + 1).otherwise(0)


def unshifted_label(label: Column, first: int = 8) -> Column:
    return F.when(label <= 0, F.raise_error(F.lit("label 0 is reserved for no event")).cast("int")).otherwise(label + first - 1)


def rank_threshold(tier: Column) -> Column:
    """Where a tier begins on the points ladder (F32)."""
    return tier * 10_000


def t_stat(effect: Column, se: Column) -> Column:
    """effect / se, 0 where the error isn't positive."""
    return F.when(se > 0, effect / se).otherwise(F.lit(0.0))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    square = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, x: s + x))


def whitened(x: Column, mean: Column, sd: Column) -> Column:
    """(x - mean) / sd by element, in doubles."""
    return F.zip_with(F.zip_with(x, mean, lambda a, m: a.cast("double") - m), sd, lambda d, s: d / s)


def describe_move(name: Column, delta: Column, minute: Column, explanation: Column) -> Column:
    """What happened in a moment, in words: gained where the change is positive, else lost."""
    return F.format_string("At %d min, your team %s %s. %s", minute.cast("int"), F.when(delta > 0, "gained").otherwise("lost"), F.lower(name), explanation)


def title_of(key: Column) -> Column:
    """A readable name of a snake_case key."""
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))
