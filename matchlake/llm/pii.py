"""Personal data: fixed patterns, and information-theoretic sanitisation around them.

Every value that a pattern finds is a protected entity, and so is what values have in common: the domain of an
e-mail address, the first three numbers of an IP address, a card's issuer, a phone number's country and area. Over the
whole corpus, counts of documents with a term, with an entity, and with both anywhere in their text give pointwise
mutual information; a term discloses an entity when PMI(term; entity) reaches ALPHA of the entity's own information
content -log p(entity). A pair needs MIN_DOCS documents of support, one more where the entity is a class: a single
document can't tell a disclosing word from any other rare one. Texts are counted whole; equal texts are worked on once
and counted as often as they occur. DataFrame functions only.

find_personal_data() finds every occurrence of a disclosing term in the documents that hold its entity;
sanitise() generalises every occurrence in every document, whether or not that holds the entity.

Spans come from one regular-expression pass a kind: matches are fenced, the text is split at the fences, and
running lengths give code-point offsets; these sums are windows over the matches, never over the texts.

Defined results: null text is empty and has no spans; repeated rows count as documents of their own and give
repeated results; an empty table gives an empty result. Other columns pass through sanitise(), whatever their
names; a fence character (U+0001) in a text that sanitise() rewrites becomes U+0002.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.shared import boxed, lookup_hot_safe, materialise, once, scratch, text_or_empty, unboxed

KINDS = ("email", "ip", "card", "phone", "term")
#: The fixed patterns. A match begins where its run begins or the last match ended, so that a failing run is
#: read once; loops are possessive wherever giving back could not help.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = (EMAIL, IP, CARD, PHONE)
FENCE, STAND_IN = "\x01", "\x02"

WORD = r"[\p{L}\p{N}]+"
#: The words of sanitise(); the marks that generalise() leaves are matched as wholes, so that they hold none.
WORD_OR_MARK = r"<(?:EMAIL|IP|CARD|PHONE)>|[\p{L}\p{N}]+"
#: Documents in which a term and an entity must meet; one more where the entity is a class of values.
MIN_DOCS = 2
ALPHA = 0.8
#: Terms that a lookup in all words is broadcast for, at most; beyond, words are counted first.
BROADCAST_TERMS = 500_000


def fenced(text: Column, kind: int) -> Column:
    """The text's parts: gap, match, gap, match, ..., gap. A fence in the text becomes a character that, like it, no pattern has."""
    clean = F.translate(text, FENCE, STAND_IN)
    need = {0: clean.contains("@"), 1: clean.rlike(r"[0-9]\.[0-9]"), 3: clean.contains("+")}.get(kind, clean.rlike("[0-9][\\x20-]?[0-9]"))
    return F.when(need, F.split(F.regexp_replace(clean, PATTERNS[kind], f"{FENCE}$0{FENCE}"), FENCE, -1)).otherwise(F.array(clean))


def valid(match: Column, kind: int) -> Column:
    """Whether a match of the kind's pattern holds what the pattern can't say."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        parts = F.transform(F.split(match, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.when(p == "", 0).otherwise(F.substring(p, 1, 3).try_cast("int")), F.lit(0)) <= 255))
    if kind == 3:
        return F.length(digits).between(8, 15)
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    odd = lambda d, at: F.when(at % 2 == 1, doubled(d)).otherwise(d)
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), lambda d, at: odd(d.try_cast("int"), at))
    luhn = F.aggregate(each, F.lit(0), lambda total, d: total + d)
    return F.length(digits).between(16, 19) & (luhn % 10 == 0)


def _matches(text: Column, kind: int) -> Column:
    """Each match with the length of the gap before it."""
    one = lambda parts: F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.size(parts) / 2).cast("int"))),
        lambda k: F.when(
            F.size(parts) > 1,
            F.struct(F.lit(kind).alias("kind"), k.cast("long").alias("nth"), F.length(F.get(parts, 2 * k - 2)).alias("gap"), F.get(parts, 2 * k - 1).alias("match")),
        ),
    )
    return F.filter(once(fenced(text, kind), one), lambda m: m.isNotNull())


def base_matches(docs: DataFrame) -> DataFrame:
    """Written table of a row for each document: row, doc_id, text_key, found (its matches), text (null without any)."""
    text = F.col("_text")
    rows = docs.select("doc_id", text_or_empty().alias("_text"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha1(F.encode("_text", "UTF-8")).alias("text_key"), F.concat(*(_matches(text, k) for k in range(4))).alias("found"), "_text")
    return materialise(rows.select("row", "doc_id", "text_key", "found", F.when(F.size("found") > 0, text).alias("text")), "matches")


def base_spans(matches: DataFrame) -> DataFrame:
    """row, kind, start, stop and match of the matches that hold."""
    ahead = Window.partitionBy("row", "kind").orderBy("nth")
    rows = matches.select("row", F.explode("found").alias("m")).select("row", "m.*")
    rows = rows.withColumn("stop", F.sum(F.col("gap") + F.length("match")).over(ahead)).withColumn("start", F.col("stop") - F.length("match"))
    holds = F.lit(False)
    for kind in range(4):
        holds = F.when(F.col("kind") == kind, valid(F.col("match"), kind)).otherwise(holds)
    return rows.filter(holds).select("row", "kind", "start", "stop", "match")


def entities(spans: DataFrame) -> DataFrame:
    """Distinct row, entity: a hash whose last bit is 1 for a class of values, 0 for a value."""
    kind, match = F.col("kind"), F.col("match")
    digits = F.regexp_replace(match, "[^0-9]", "")
    common = F.when(kind == 0, F.substring_index(F.lower(match), "@", -1)).when(kind == 1, F.substring_index(match, ".", 3)).when(kind == 2, F.left(digits, F.lit(6))).otherwise(F.left(digits, F.lit(4)))
    value, among_classes = F.xxhash64(kind, F.lower(match)), F.xxhash64(F.lit("class"), kind, common)
    one = F.lit(1).cast("long")
    both = F.array(value.bitwiseAND(F.lit(-2).cast("long")), among_classes.bitwiseOR(one))
    return spans.select("row", F.explode(both).alias("entity")).distinct()


def support(min_docs: int) -> Column:
    """Documents that a pair with the entity needs: one more for a class."""
    return F.lit(min_docs).cast("long") + F.col("entity").bitwiseAND(F.lit(1).cast("long"))


def runs_of(text: Column) -> Column:
    """The distinct lower-cased runs of letters and digits of a text, and perhaps an empty one."""
    return F.array_distinct(F.transform(F.split(text, r"[^\p{L}\p{N}]+"), F.lower))


def words_of(text: Column) -> Column:
    """The distinct lower-cased words of a text: runs that begin with a letter."""
    return F.filter(runs_of(text), lambda w: w.rlike(r"^\p{L}"))


def holders(matches: DataFrame, spans: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Written table row, text_key, n, found: each distinct text (its first row stands for its n rows) with the entities in it
    that enough documents hold, one for all that are in the same texts, and the number of those documents (n_entity)."""
    texts = matches.filter(F.col("text").isNotNull()).groupBy("text_key").agg(F.min("row").alias("row"), F.count("*").alias("n"))
    rows = materialise(entities(spans).join(texts, "row"), "entities")
    total = matches.count()
    # entities that are in the same texts have the same counts with every term, and a term that discloses one discloses all in the same places: one stands
    # for them, so that a text of n addresses, however often copied, isn't words times addresses. A set of texts is told by two sums of their hashes
    texts_of = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"_texts{k}") for k in range(2)]
    many = rows.groupBy("entity").agg(F.sum("n").alias("n_entity"), *texts_of).filter((F.col("n_entity") >= support(min_docs)) & (F.col("n_entity") < total))
    is_class = F.col("entity").bitwiseAND(F.lit(1).cast("long"))
    many = many.groupBy("_texts0", "_texts1", "n_entity", is_class.alias("_class")).agg(F.min("entity").alias("entity")).select("entity", "n_entity")
    # a key of this join is held by as many texts as hold the entity
    rows = lookup_hot_safe(rows, many.withColumn("_w", F.col("n_entity")), "entity", "_w", total).filter(F.col("n_entity").isNotNull())
    return materialise(rows.groupBy("row", "text_key", "n").agg(F.collect_list(F.struct("entity", "n_entity")).alias("found")), "holders")


def held_words(matches: DataFrame, held: DataFrame) -> DataFrame:
    """Written table row, n, found, term: the distinct words of the holders' texts. What a word needs of its text goes with it."""
    texts = matches.filter(F.col("text").isNotNull()).select("row", "text").join(held.select("row", "n", "found"), "row")
    return materialise(texts.select("row", "n", "found", F.explode(words_of(F.col("text"))).alias("term")), "words")


def disclosing_terms(docs: DataFrame, words: DataFrame, n_docs: int, alpha: float = ALPHA, min_docs: int = MIN_DOCS) -> DataFrame:
    """Written table of the pairs entity, term whose mutual information reaches the threshold. Counts are of documents, over all of them.

    log(n_both n / (n_term n_entity)) >= alpha log(n / n_entity), solved for n_term.
    """
    n = float(max(1, n_docs))
    pairs = words.select("n", "term", F.explode("found").alias("e")).groupBy("e.entity", "e.n_entity", "term").agg(F.sum("n").alias("n_both"))
    most = F.col("n_both") * F.pow(n / F.col("n_entity"), F.lit(1 - alpha)) * (1 + 1e-12)
    pairs = materialise(pairs.filter(F.col("n_both") >= support(min_docs)).select("entity", "term", most.alias("most")), "pairs")
    # documents with a term and any entity are too many for most terms; a term may be in as many pairs as there are entities
    near = words.groupBy("term").agg(F.sum("n").alias("n_near")).join(pairs.groupBy("term").agg(F.count("*").alias("_w")), "term")
    rows = lookup_hot_safe(pairs, near, "term", "_w", pairs.count())
    rows = materialise(rows.filter(F.col("n_near") <= F.col("most")).select("entity", "term", "most"), "likely")
    every = docs.select(F.explode(runs_of(text_or_empty())).alias("term"))  # what is wanted begins with a letter
    counts = among(every, rows.select("term").distinct()).groupBy("term").agg(F.count("*").alias("n_term"))
    return materialise(rows.join(counts, "term").filter(F.col("n_term") <= F.col("most")).select("entity", "term"), "told")


def among(words: DataFrame, wanted: DataFrame) -> DataFrame:
    """The words whose term, or entity and term, is wanted. Few terms are broadcast; for many, Spark joins by term and splits hot ones."""
    small = wanted.count() <= BROADCAST_TERMS
    return words.join(F.broadcast(wanted) if small else wanted, wanted.columns, "left_semi")


def term_spans(matches: DataFrame, spans: DataFrame, held: DataFrame, words: DataFrame, told: DataFrame) -> DataFrame:
    """text_key, added (array of kind, start, stop), n: all occurrences of the terms that disclose an entity of the text, but for those that overlap
    a base span. Occurrences are rows: they meet the text's terms by a join and its base spans in one ordered pass, so long texts cost what they hold."""
    has = among(words.select("row", "term", F.explode("found.entity").alias("entity")), told).select("row", "term").distinct()
    texts = matches.select("row", "text").join(has.select("row").distinct(), "row", "left_semi")
    fenced_words = F.split(F.regexp_replace(F.translate("text", FENCE, STAND_IN), WORD, f"{FENCE}$0{FENCE}"), FENCE, -1)
    parts = texts.select("row", F.posexplode(fenced_words).alias("at", "part")).select("row", "at", F.length("part").alias("size"), F.when(F.col("at") % 2 == 1, F.lower("part")).alias("term"))
    parts = parts.join(has.withColumn("hit", F.lit(True)), ["row", "term"], "left")
    found = parts.withColumn("stop", F.sum("size").over(Window.partitionBy("row").orderBy("at"))).filter("hit").select("row", (F.col("stop") - F.col("size")).alias("start"), "stop", F.col("stop").alias("pos"), F.lit(None).cast("long").alias("taken"))
    # a base span that begins before a term ends, and ends after it begins, overlaps it
    base = spans.join(has.select("row").distinct(), "row", "left_semi").select("row", "start", "stop", F.col("start").alias("pos"), F.col("stop").cast("long").alias("taken"))
    order = Window.partitionBy("row").orderBy("pos", F.col("taken").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    free = found.unionByName(base).withColumn("upto", F.max("taken").over(order)).filter(F.col("taken").isNull() & (F.coalesce("upto", F.lit(0)) <= F.col("start")))
    lists = free.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.lit(4).alias("kind"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")))).alias("added"))
    return lists.join(held.select("row", "text_key", "n"), "row").select("text_key", "added", "n")


def find_personal_data(docs: DataFrame, alpha: float = ALPHA, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text_key, base and spans for each row: arrays of (kind number, start, stop) in kind order, then start."""
    with scratch() as keep:
        matches = keep(base_matches(docs))
        spans = keep(materialise(base_spans(matches), "spans"))
        held = holders(matches, spans, min_docs)
        words = held_words(matches, held)
        told = disclosing_terms(docs, words, matches.count(), alpha, min_docs)
        added = keep(materialise(term_spans(matches, spans, held, words, told), "added"))
    kind = "array<struct<kind:int,start:bigint,stop:bigint>>"
    lists = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")))).alias("base"))
    rows = matches.select("row", "doc_id", "text_key").join(lists, "row", "left").withColumn("base", F.coalesce("base", F.array().cast(kind)))
    rows = lookup_hot_safe(rows, added, "text_key", "n", matches.count())
    return rows.select("doc_id", "text_key", "base", F.concat("base", F.coalesce("added", F.array().cast(kind))).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:stop, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def generalise(text: Column) -> Column:
    """The text with each valid base match replaced by its kind in angle brackets."""
    for kind in range(4):
        text = once(text, _generalised(kind))  # the next kind names its text several times
    return text


def _generalised(kind: int) -> Callable[[Column], Column]:
    return lambda text: F.array_join(F.transform(fenced(text, kind), _swap(kind)), "")


def _swap(kind: int) -> Callable[[Column, Column], Column]:
    def swap(part: Column, at: Column) -> Column:
        return F.when((at % 2 == 1) & valid(part, kind), F.lit(f"<{KINDS[kind].upper()}>")).otherwise(part)

    return swap


def terms_of_texts(docs: DataFrame, alpha: float = ALPHA, min_docs: int = MIN_DOCS) -> DataFrame:
    """Written table text_key, _terms, _rows: each text that holds a term which discloses an entity, with all such terms and its number of rows."""
    with scratch() as keep:
        matches = base_matches(docs)
        held = holders(matches, base_spans(matches), min_docs)
        told = disclosing_terms(docs, held_words(matches, held), matches.count(), alpha, min_docs).select("term").distinct()
        rows = docs.select(text_or_empty().alias("_text")).select(F.sha1(F.encode("_text", "UTF-8")).alias("text_key"), F.explode(runs_of(F.col("_text"))).alias("term"))
        hits = among(rows, told).groupBy("text_key", "term").agg(F.count("*").alias("n"))
        return keep(materialise(hits.groupBy("text_key").agg(F.collect_set("term").alias("_terms"), F.max("n").alias("_rows")), "terms"))


def _without(terms: Column, text: Column) -> Column:
    """The text with each word that is one of the terms replaced; words in the marks that generalise() leaves are kept."""
    clean = F.regexp_replace(F.translate(text, FENCE, STAND_IN), WORD_OR_MARK, f"{FENCE}$0{FENCE}")
    swap = lambda part, at: F.when((at % 2 == 1) & F.array_contains(terms, F.lower(part)), F.lit("<TERM>")).otherwise(part)
    return F.array_join(F.transform(F.split(clean, FENCE, -1), swap), "")


def sanitise(docs: DataFrame, alpha: float = ALPHA, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with disclosing terms and personal data in text generalised. Null text stays null."""
    terms = terms_of_texts(docs, alpha, min_docs).withColumnRenamed("text_key", "_key")
    rows = boxed(docs, _text=F.col("text").cast("string"), _key=F.sha1(F.encode(text_or_empty(), "UTF-8")))
    rows = lookup_hot_safe(rows, terms, "_key", "_rows", docs.select("doc_id").count())
    both = once(generalise(F.col("_text")), lambda text: F.when(F.col("_terms").isNull(), text).otherwise(_without(F.col("_terms"), text)))
    return unboxed(rows.withColumn("_row", F.col("_row").withField("text", F.when(F.col("_text").isNotNull(), both))))
