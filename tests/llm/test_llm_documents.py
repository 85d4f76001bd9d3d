"""Rules, classifiers, joins, decontamination and tokenizing against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from matchlake.llm import bpe, decontam, ngram_join, ordinal, quality, rules, toxicity
from tests.llm.fixtures import DOCS, docs, odd_texts, words

LABELS = "doc_id long, quality int, toxic int"


def measures(t: str) -> tuple:
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c, inside, seen, dup = Counter(zip(w, w[1:], w[2:], strict=False)), set(), set(), 0
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside)


def test_quality_rules(spark):
    good = [(20 + k, " ".join(words(80, 1))[k:] + " " + " ".join(words(60, 900 + k))) for k in range(12)]
    junk = [(50 + k, " ".join(f"{w}###" for w in words(90, 200 + k))) for k in range(12)]
    loop = [(80, "x y z " * 40), (81, "same line here\nsame line here\n \n \nother")]
    df = docs(spark, odd_texts() + good + junk + loop, extra=True)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(20, 1, 0), (None, 1, 0), (50, 0, 0)], LABELS)
    got = rules.quality_rules(df, labels).collect()
    text = Counter((i, measures(t or "")) for i, t in odd_texts() + good + junk + loop)
    assert Counter((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got) == text
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.llr >= rules.MIN_LLR)
    by = {r.doc_id: r for r in got}
    assert all(by[i].kept for i, _ in good) and not any(by[i].kept for i, _ in junk) and by[80].base_failed


def test_ratio_is_that_of_the_counts(spark, monkeypatch):
    texts = [(k, " ".join(words(30, k))) for k in range(8)]
    df, labels = docs(spark, texts), spark.createDataFrame([(0,), (3,)], "doc_id long")
    got = rules.fit_ratio(df, labels, buckets=512)
    hashes, raw, target = rules._Hashes(), np.zeros(512), np.zeros(512)
    for k, t in texts:
        grams = np.bincount(rules.ngram_buckets(t, hashes, 512), minlength=512)
        raw += grams
        target += grams * (k in (0, 3))
    share = lambda x: (x + rules.SMOOTH * x.sum() / 512) / (x.sum() * (1 + rules.SMOOTH))
    assert np.allclose(got, np.log(share(target)) - np.log(share(raw)))
    monkeypatch.setattr(rules, "BROADCAST_IDS", 0)  # more ids than are broadcast
    assert np.array_equal(rules.fit_ratio(df, labels, buckets=512), got)
    monkeypatch.undo()
    assert not rules.fit_ratio(df, labels.limit(0), buckets=512).any()
    assert rules.quality_rules(df.limit(0), spark.createDataFrame([], LABELS)).count() == 0


def test_ordinal_model_orders_grades():
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(1500):
        g = int(rng.integers(0, 4))
        have = {int(x) for x in rng.integers(1000, 9000, 20)} | {k for k in range(8) if rng.random() < 0.1 + 0.25 * g}
        rows.append(np.array(sorted(have)))
        grades.append(g)
    model = ordinal.fit_model(rows, np.array(grades), 4)
    assert (np.diff(model.thresholds) > 0).all()
    score = np.array([sum(model.table.get(int(b), 0.0) for b in r) for r in rows])
    tails = model.tails(score)
    assert (np.diff(tails, axis=1) <= 0).all()
    means = [tails.sum(axis=1)[np.array(grades) == g].mean() for g in range(4)]
    assert means == sorted(means) and np.corrcoef(tails.sum(axis=1), grades)[0, 1] > 0.75
    assert not len(ordinal.fit_model(rows[:5], np.zeros(5, int), 4).weights) and not len(ordinal.fit_model([], np.zeros(0, int), 3).weights)


@pytest.mark.parametrize("which", ["quality", "toxicity"])
def test_classifiers_on_held_out_rows(spark, which):
    rng = random.Random(3)
    texts, labels = [], []
    for k in range(400):
        base, bad = words(60, k), k % 3 == 0
        if bad:
            base[5:5] = ["vileword", "nastyword"] if which == "toxicity" else []
        t = " ".join(f"{w}$$$" if bad and which == "quality" else w for w in base)
        texts.append((k, t))
        if k < 250:
            labels.append((k, int(not (bad and which == "quality")), int(bad and which == "toxicity")))
    rng.shuffle(texts)
    df = docs(spark, texts + [(1000 + i, t) for i, (_, t) in enumerate(odd_texts())], extra=True)
    table = spark.createDataFrame([*labels, (0, 0, 0), (None, 1, 1), (5, None, None)], LABELS)
    out = quality.classify_quality(df, table) if which == "quality" else toxicity.grade_toxicity(df, table)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == 400 + len(odd_texts())
    for k in range(250, 400):
        assert (not got[k].selected if which == "quality" else got[k].is_toxic) == (k % 3 == 0)
    empty = spark.createDataFrame([], LABELS)
    assert (quality.classify_quality(df, empty) if which == "quality" else toxicity.grade_toxicity(df.limit(0), empty)).count() in (0, len(got))


def loss(rows, grades, weights, thresholds, l2=ordinal.L2):
    """Penalised negative log-likelihood, term by term."""
    total = l2 / 2 * sum(w * w for w in weights.values())
    for have, g in zip(rows, grades, strict=True):
        score = sum(weights.get(b, 0.0) for b in have)
        tail = [1.0, *(1 / (1 + np.exp(t - score)) for t in thresholds), 0.0]
        total -= np.log(tail[g] - tail[g + 1])
    return total


@pytest.mark.parametrize("name", ["op8_quality", "op9_toxicity"])
def test_classifiers_against_plain_python(spark, name):
    sf = "/root/testdata/sf0.01"
    table = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels")}
    features = quality.features if name == "op8_quality" else toxicity.features
    text = {r.doc_id: r.text or "" for r in table["documents"].collect()}
    own = {}
    for r in table["labels"].collect():
        g = r.toxic if name == "op9_toxicity" else 0 if r.quality == 0 else None if r.quality != 1 else 2 if r.toxic != 1 else 1
        if g is not None and r.doc_id in text:
            own[r.doc_id] = max(g, own.get(r.doc_id, 0))
    rows, grades = [{ordinal.bucket_of(f) for f in features(text[i])} for i in own], list(own.values())
    n, n_grades, mean = len(grades), 3 if name == "op8_quality" else 2, sum(grades) / len(grades)
    spread, of = (sum((g - mean) ** 2 for g in grades) / n) ** 0.5, {}
    for have, g in zip(rows, grades, strict=True):
        for b in have:
            of.setdefault(b, []).append(g)
    far = lambda gs: abs(sum(gs) / len(gs) - mean) * len(gs) ** 0.5 / spread
    wanted = {b for b, gs in of.items() if len(gs) >= ordinal.MIN_DOCS and far(gs) >= ordinal.MIN_Z}
    frame = spark.createDataFrame(list(own.items()), "doc_id long, grade int")
    model = ordinal.fit_on_labels(table["documents"], frame, features, n_grades)
    assert wanted and set(model.table) == wanted
    # the loss is convex: no step along any axis lowers it, so this is its minimum
    weights, least = model.table, loss(rows, grades, model.table, model.thresholds)
    for step in (-0.05, 0.05):
        for b in sorted(weights)[::7]:
            assert loss(rows, grades, weights | {b: weights[b] + step}, model.thresholds) > least
        for k in range(n_grades - 1):
            assert loss(rows, grades, weights, model.thresholds + step * (np.arange(n_grades - 1) == k)) > least
    from matchlake.llm import queries

    got = {r.doc_id: r for r in queries.queries()[name](spark, sf).collect()}
    assert set(got) == set(text)
    for i, t in text.items():
        score = sum(weights.get(ordinal.bucket_of(f), 0.0) for f in features(t))
        tails = [1 / (1 + np.exp(k - score)) for k in model.thresholds]
        expected, tail = got[i][1:3]
        assert expected == pytest.approx(sum(tails), abs=1e-6) and tail == pytest.approx(tails[0], abs=1e-6)
        assert got[i][3] == (tail >= (quality.MIN_TAIL if n_grades == 3 else toxicity.MIN_TAIL))


def test_screen_is_a_parameter():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 40, 9)) for _ in range(200)]
    grades = np.array([int(0 in r) for r in rows])
    assert ordinal.fit_model(rows, grades, 2, 1, 0.0).buckets.tolist() == sorted(set(np.concatenate(rows).tolist()))
    assert 0 in ordinal.fit_model(rows, grades, 2).buckets


def sets_of(t: str) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(zip(w, w[1:], w[2:], w[3:], w[4:], strict=False))


def brute_components(texts):
    s = [sets_of(t or "") for _, t in texts]
    root = list(range(len(s)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            if s[a] and s[b]:
                both = len(s[a] & s[b])
                if 100 * both >= 80 * (len(s[a]) + len(s[b]) - both):
                    root[find(a)] = find(b)
    lows = {}
    for k, (i, _) in enumerate(texts):
        r = find(k)
        if i is not None:
            lows[r] = min(lows.get(r, i), i)
    return Counter((i, len(s[k]), lows.get(find(k)) if s[k] else i) for k, (i, _) in enumerate(texts))


def near_texts(seed: int, copies: int, edits: int, n: int = 60):
    rng = random.Random(seed)
    body, out = words(n, seed), []
    for _ in range(copies):
        own = list(body)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(n)] = "".join(rng.choice("qrstuvwxyz") for _ in range(8))
        out.append(" ".join(own))
    return out


def test_ngram_join_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LONG", 6)
    monkeypatch.setattr(ngram_join, "FREQUENT", 4)
    texts = odd_texts()
    for g in range(12):
        texts += [(1000 * g + k + 20, t) for k, t in enumerate(near_texts(g, 25 if g < 2 else 6, 3, 150 if g < 6 else 12))]
    passage = " ".join(words(40, 77))
    texts += [(50_000 + k, f"{' '.join(words(20 + k, 500 + k))} {passage}") for k in range(15)]
    texts += [(60_000 + k, passage) for k in range(10)] + [(70_000 + k, " ".join(words(3, k % 2))) for k in range(4)]
    random.Random(0).shuffle(texts)
    df = docs(spark, texts, extra=True).repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df).collect())
    assert got == brute_components(texts)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    want = Counter(c for _, n, c in brute_components(texts).elements() if n)
    ids = [r.doc_id for r in kept.collect()]
    blank = sum(not sets_of(t or "") for _, t in texts)
    assert len(ids) == len(want) + blank


def test_ngram_join_in_blocks_and_fine_buckets(spark, monkeypatch):
    """Long lists in several blocks that meet in pairs, and entries dealt out twice, lose no link either."""
    monkeypatch.setattr(ngram_join, "LONG", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    monkeypatch.setattr(ngram_join, "FREQUENT", 4)
    monkeypatch.setattr(ngram_join, "COARSE_BITS", 3)
    monkeypatch.setattr(ngram_join, "HELD_ENTRIES", 300)
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    texts = odd_texts()
    for g in range(5):
        texts += [(1000 * g + k + 20, t) for k, t in enumerate(near_texts(g, 30 if g < 2 else 6, 4, 90))]
    passage = " ".join(words(60, 77))
    # mostly one passage: the same list, and yet not similar
    texts += [(50_000 + k, f"{' '.join(words(9 + k % 9, 500 + k))} {passage} {' '.join(words(6, 900 + k % 7))}") for k in range(40)]
    texts += [(60_000 + k, " ".join(words(3, k % 2))) for k in range(4)]
    random.Random(1).shuffle(texts)
    df = docs(spark, texts).repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df).collect())
    assert got == brute_components(texts)
    twice = ngram_join.describe(df, 4, 8)[1]
    monkeypatch.setattr(ngram_join, "COARSE_BITS", 12)
    assert len(twice) > 20 and (twice == ngram_join.describe(df, 4, 8)[1]).all()


def test_keep_one_of_rows_that_differ_elsewhere(spark):
    text = " ".join(words(30, 1))
    rows = [(1, text, "en", f"s{k}", 5) for k in range(20)] + [(2, text, "en", "t", 5)]
    kept = {tuple(ngram_join.keep_one(spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), DOCS).repartition(3)).collect()) for seed in range(3)}
    assert len(kept) == 1 and len(next(iter(kept))) == 1


def test_ngram_join_of_nothing(spark):
    df = docs(spark, [(1, None), (2, "")])
    assert ngram_join.ngram_components(df).count() == 2 and ngram_join.ngram_components(df.limit(0)).count() == 0
    assert ngram_join.keep_one(df).count() == 2


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, k) for k in range(101, 140)] + [(200, 200), (300, 301), (301, 300)]
    got = {r.node: r.root for r in ngram_join.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(1, 31)) and all(got[k] == 100 for k in range(101, 140)) and got[301] == 300 and 200 not in got


def item_words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def test_decontamination_is_exact(spark):
    items = [(k, " ".join(words(n, 900 + k))) for k, n in enumerate((5, 6, 9, 20, 33, 60, 130))] + [(20, "too short"), (21, None), (22, ""), (3, " ".join(words(20, 903)))]
    items += [(30 + n, " ".join(words(n, 950 + n))) for n in (1, 2, 3, 4)] + [(40, "Who wrote Hamlet?"), (41, "one"), (42, "...")]
    texts = odd_texts()
    rng = random.Random(8)
    for k in range(120):
        own = words(rng.randint(0, 200), 3000 + k)
        passage = item_words(rng.choice(items)[1])
        for _ in range(rng.randint(0, 2)):
            if passage:
                passage[rng.randrange(len(passage))] = "changed"
        at = rng.randint(0, len(own))
        texts.append((100 + k, " ".join(own[:at] + [w.upper() + "," for w in passage] + own[at:])))
    texts += [(300, "they asked who wrote hamlet again"), (301, "who wrote the hamlet"), (302, "hamlet who wrote"), (303, "who wrote hamlet")]
    df = docs(spark, texts, extra=True)
    table = spark.createDataFrame(items, "item_id long, text string")
    cut = lambda t, n: {tuple(w[k : k + n]) for w in [item_words(t)] for k in range(len(w) - n + 1)}
    want = {}
    for i, t in texts:
        for j, u in items:
            width = min(5, len(item_words(u)))
            g = cut(u, width) if width else set()
            both = len(g & cut(t, width)) if width else 0
            if g and 100 * both >= 80 * len(g):
                want[i, j] = max(want.get((i, j), (0, 0)), (both, len(g)))
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item_shingles) for r in decontam.leaks(df, table).collect()}
    assert want and got == want and (300, 40) in got and (303, 40) in got and (301, 40) not in got and (302, 40) not in got
    clean = decontam.decontaminate(df, table)
    assert clean.columns == df.columns and clean.count() == sum(not any((i, j) in want for j, _ in items) for i, _ in texts)
    assert decontam.leaks(df, table.limit(0)).count() == 0 and decontam.leaks(df.limit(0), table).count() == 0


def test_bpe_matches_tiktoken(spark, monkeypatch):
    import public_tokenizers as p
    import tiktoken

    monkeypatch.setattr(bpe, "CHUNK_CHARS", 5_000)
    path = p.path("byte_bpe_50k.tiktoken")
    rng = random.Random(5)
    bits = ["the ", " ", "  ", "\n\n", "don't", "'ll", "é", "𝒳", "漢字", "123", "#!?", "<|endoftext|>", "\x1c", " ", " ", "́", "Ⅷ", "\t", "ab" * 40]
    texts = odd_texts() + [(100 + k, "".join(rng.choice(bits) for _ in range(80))) for k in range(60)]
    df = docs(spark, texts, extra=True).repartition(2)
    encoded = bpe.encode_documents(df, path, p.PATTERN)
    got = Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in bpe.decode_documents(encoded, path).collect())
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=bpe.read_ranks(spark, path), special_tokens={})
    assert got == Counter((i, tuple(enc.encode_ordinary(t or "")), (t or "").encode()) for i, t in texts)
    one = bpe.encode_documents(df, path, p.PATTERN, decode=True)
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in one.collect()) == got
    assert bpe.encode_documents(df.limit(0), path, p.PATTERN).count() == 0


def test_all_trusted_rows_are_counted(spark):
    df = spark.range(20_050).selectExpr("id AS doc_id", "concat('w', id % 977, ' v', id) AS text")
    assert not rules.fit_ratio(df, df.select("doc_id").unionByName(df.select("doc_id")), buckets=512).any()
