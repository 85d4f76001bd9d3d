"""PII and secrets against plain regular expressions, and their methods on planted cases."""

from __future__ import annotations

import random
import re
from collections import Counter

from matchlake.llm import pii, secrets
from tests.llm.fixtures import docs, odd_texts, words


def luhn(s: str) -> bool:
    d = [int(c) for c in s if c.isdigit()]
    return 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for k, x in enumerate(reversed(d))) % 10 == 0


def base(text: str) -> list[tuple[int, int, int]]:
    found = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if luhn(m[0])]
    found += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def soup(seed: int, n: int) -> str:
    rng = random.Random(seed)
    bits = ["@", ".", "a", "b-c", "%", "_", "é", "1", "255", "256", "007", " ", "-", "+", "(", ")", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 010-9999", "x@y.zz", "1.2.3.4", "\n", "\x01", "𝒳"]
    return "".join(rng.choice(bits) for _ in range(n))


def test_base_spans_match_plain_patterns(spark):
    texts = odd_texts() + [(100 + k, soup(k, 120)) for k in range(60)] + [(300, "a" * 50_000 + "@"), (301, "1" * 40_000), (302, "a@b" + ".c" * 20_000), (303, "1.2.3.4.5.6.7.8 0255.0000001.2.3"), (304, "a@b@c.d%x@y.z_q@r.s")]
    got = pii.find_personal_data(docs(spark, texts, extra=True)).collect()
    assert len(got) == len(texts)
    want = Counter((i, tuple(base(t or ""))) for i, t in texts)
    assert Counter((r.doc_id, tuple(map(tuple, r.base))) for r in got) == want
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in got)


def test_terms_that_reveal_an_entity(spark):
    rare, common = "zanzibarite", "about"
    texts = [(k, f"{common} {' '.join(words(12, k))} {rare} wrote jo@ex.org from {common} town") for k in range(5)]
    texts += [(100 + k, f"{common} {' '.join(words(30, 50 + k))} town wrote from") for k in range(60)]
    df = docs(spark, texts)
    got = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    for k in range(5):
        terms = {texts[k][1][s.start : s.stop] for s in got[k].spans if s.kind == 4}
        assert terms == {rare}
    assert all(not got[100 + k].spans for k in range(60))
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[0] == texts[0][1].replace(rare, "<TERM>").replace("jo@ex.org", "<EMAIL>") and clean[100] == texts[5][1]


def test_terms_far_off_and_classes_of_entities(spark):
    far = " ".join(["about town"] * 30)
    texts = [(k, f"Zanzibarite {far} {k}.person{k}@zanzi.example {far} x zanzibarite, Zanzi") for k in range(3)]
    texts += [(9, f"zanzibarite {far}"), (10, f"qux {far} lone@only.example"), (11, f"qux {far} lone@only.example"), (12, f"solo {far} solo@solo.example")]
    texts += [(100 + k, f"about town x {' '.join(words(9, k))} zanzi@{k}") for k in range(200)]
    got = {r.doc_id: [texts_of(texts, r.doc_id, s) for s in r.spans if s.kind == 4] for r in pii.find_personal_data(docs(spark, texts)).collect()}
    assert all(got[k] == ["Zanzibarite", "zanzibarite"] for k in range(3))  # three documents of one domain
    assert got[10] == got[11] == ["qux"]  # two documents of one address
    assert not got[12] and not got[9] and not any(got[100 + k] for k in range(200))  # one document says nothing
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(spark, texts)).collect()}
    assert clean[9] == f"<TERM> {far}" and clean[12] == f"solo {far} <EMAIL>" and clean[10] == f"<TERM> {far} <EMAIL>"


def texts_of(texts, doc_id, span):
    return dict(texts)[doc_id][span.start : span.stop]


def test_counts_behind_the_threshold(spark):
    rng = random.Random(4)
    vocabulary = words(40, 7)
    texts = [(k, " ".join([*rng.choices(vocabulary, k=6), rng.choice(["a@b.cc", "1.2.3.4", "x"]), *rng.choices(vocabulary, k=6)])) for k in range(120)]
    n, terms, pairs, entities = len(texts), Counter(), Counter(), Counter()
    for _, t in texts:
        ws = set(t.split())
        terms.update(ws)
        for e in {"a@b.cc", "1.2.3.4"} & ws:
            entities[e] += 1
            pairs.update((e, w) for w in ws - {e})
    alpha, least = 0.3, 2
    want = {(e, w) for (e, w), c in pairs.items() if c >= least and (c * n / (terms[w] * entities[e])) >= (n / entities[e]) ** alpha}
    got = pii.find_personal_data(docs(spark, texts), alpha, least).collect()
    text = dict(texts)
    found = {(next(e for e in ("a@b.cc", "1.2.3.4") if e in text[r.doc_id]), text[r.doc_id][s.start : s.stop]) for r in got for s in r.spans if s.kind == 4}
    assert want and found == want


def test_sanitise_reads_whole_texts(spark):
    far = " ".join(["about town"] * 20)
    texts = [(k, f"Zanzibarite {far} jo@ex.org Qx <EMAIL> {far} zanzibarite, qx") for k in range(5)]
    texts += [(5, f"the zanzibarite of {far}"), (6, None)] + [(100 + k, f"about town {' '.join(words(9, k))}") for k in range(60)]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(spark, texts)).collect()}
    assert clean[0] == f"<TERM> {far} <EMAIL> <TERM> <EMAIL> {far} <TERM>, <TERM>"
    assert clean[5] == f"the <TERM> of {far}" and clean[6] is None
    assert all(clean[i] == t for i, t in texts if i >= 100)


def test_sanitise_counts_documents(spark):
    rng = random.Random(6)
    vocabulary = words(60, 8) + ["ab", "é", "x1"]
    texts = [(k, " ".join([*rng.choices(vocabulary, k=30), *rng.choices(["a@b.cc", "1.2.3.4", "x", "yy"], k=2), *rng.choices(vocabulary[: 5 + k % 50], k=9)])) for k in range(150)]
    texts += texts[:9]
    n, entities = len(texts), ("a@b.cc", "1.2.3.4")
    sets = [set(t.split()) for _, t in texts]
    alpha, least = 0.1, 12
    told = set()
    for e in entities:
        n_entity = sum(e in s for s in sets)
        for w in set().union(*sets) - set(entities):
            both, term = sum(e in s and w in s for s in sets), sum(w in s for s in sets)
            if both >= least and term <= both * (n / n_entity) ** (1 - alpha):
                told.add(w)
    mark = {"a@b.cc": "<EMAIL>", "1.2.3.4": "<IP>"}
    want = Counter((i, " ".join(mark.get(w, "<TERM>" if w in told else w) for w in t.split())) for i, t in texts)
    assert told and set().union(*sets) - told - set(entities)
    assert Counter((r.doc_id, r.text) for r in pii.sanitise(docs(spark, texts), alpha, least).collect()) == want


def test_sanitise_keeps_columns_and_nulls(spark):
    df = docs(spark, odd_texts(), extra=True)
    out = pii.sanitise(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert out.filter("doc_id = 1").first().text is None
    assert pii.sanitise(df.limit(0)).count() == 0


def brute_secrets(t: str) -> list[tuple[int, int, int]]:
    key = r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    f = [(m.start(), 0, m.end()) for m in re.finditer(key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    f += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    f += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(f)


def secret_soup(seed: int) -> str:
    rng = random.Random(seed)
    bits = ["password", "ToKeN", "api_key", "ſecret", "toKen", " = ", ": ", '"', "'", "abc", "deadbeef" * 3, "AKIA" + "X" * 16, "AKIA", "0123456789abcdef", "short", "\n", "é", " the ", "=", "Q9/x+z_"]
    return "".join(rng.choice(bits) for _ in range(60))


def test_secret_base_spans_and_exact_decoding(spark):
    texts = odd_texts() + [(100 + k, secret_soup(k)) for k in range(80)]
    df = docs(spark, texts, extra=True)
    field = secrets.fit_on_documents(df)
    assert field.weights
    got = secrets.find_secrets(df, field).collect()
    want = Counter((i, tuple((secrets.KINDS[k], s, e) for s, k, e in brute_secrets(t or ""))) for i, t in texts)
    assert Counter((r.doc_id, tuple(map(tuple, r.base))) for r in got) == want
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in got)
    assert secrets.find_secrets(df.limit(0), field).count() == 0 and secrets.find_secrets(df).columns == [*(c for c in df.columns if c != "base"), "base", "spans"]


def test_field_is_fitted_on_whole_texts(spark):
    texts = [f"{'plain words here ' * 2500}{k} token = \"{k:08d}Q9xz\" end {'and more ' * k}" for k in range(6)] + ["nothing here", "x1 y2"]
    got = secrets.fit_on_documents(docs(spark, list(enumerate(texts)) + [(90, texts[0])]))
    assert got.weights and set(got.weights) == set(secrets.fit_field(texts).weights)
    assert both_ways(["the token 4711Q9xz here"], got)


def both_ways(texts, field):
    """The spans of all texts, after a check that open stretches decode as whole texts do, one by one and together."""
    scorer = secrets.Scorer(field)
    found = secrets.scan(texts, scorer)
    assert found == secrets.scan(texts, scorer, True) == [secrets.scan([t], secrets.Scorer(field))[0] for t in texts]
    return found


def test_stretches_decode_as_whole_texts():
    rng = random.Random(1)
    plain = words(300, 3)
    texts = [" ".join(rng.choice([*plain, 'token = "24be64439e3e49cf46b2d7c90f3602a3"', "4785380592391139", "key:"]) for _ in range(80)) for _ in range(60)]
    field = secrets.fit_field(texts)
    both_ways([*texts, "", " ", "one"], field)
    hit = 'the token was 24be64439e3e49cf46b2d7c9 and = "9f8e7d6c5b4a39281706f5e4" here'
    assert both_ways([hit], field)[0][0]


def names_of(texts):
    """The features of all tokens of some texts."""
    names = set()
    for t in texts:
        tokens = secrets.TOKEN.findall(t)
        for k in range(len(tokens)):
            names.update(secrets.features_at(tokens, k, secrets.file_features(t)))
    return names


def test_any_weights_decode_as_whole_texts():
    import numpy as np

    rng = np.random.default_rng(8)
    around = ["tokens", "Passwords", "secretary", "my-password", "xapikeys", "token", "api_keys", "a1", "Q9x", "=", "word", "long-word-of-many-letters", "\"", "7"]
    texts = [" ".join(rng.choice(around, 40)) for _ in range(12)] + ["my secretary here", " ".join(["a1"] * 500)]
    names = names_of(texts)
    tagged = 0
    for scale in (0.3, 1, 3, 9):
        for tilt in (0, 4):
            weights = {n: tuple(rng.normal(size=3) * scale + np.array([tilt * scale / 4, 0, 0])) for n in sorted(names)}
            tagged += sum(len(every) for _, every in both_ways(texts, secrets.Field(weights, rng.normal(size=(3, 3)) * scale)))
    assert tagged > 100


def test_scores_are_sums_of_features():
    import numpy as np

    texts = ['the token = "a1b2" end', "x", "tokens, passwd:Q9", ""]
    rng = np.random.default_rng(3)
    names = names_of(texts)
    field = secrets.Field({n: tuple(rng.normal(size=3)) for n in sorted(names)}, np.zeros((3, 3)))
    scorer = secrets.Scorer(field)
    ids = [scorer.ids(secrets.TOKEN.findall(t)) for t in texts]
    got, walls = scorer.scores(ids, [secrets.file_features(t) for t in texts])
    for t, wall in zip(texts, walls[:-1], strict=True):
        tokens = secrets.TOKEN.findall(t)
        for k in range(len(tokens)):
            assert np.allclose(got[wall + secrets.WALL + k], np.sum([field.weights[n] for n in secrets.features_at(tokens, k, secrets.file_features(t))], axis=0))


def test_words_around_key_words_decode_as_whole_texts():
    import numpy as np

    around = ["tokens", "Passwords", "secretary", "my-password", "xapikeys", "token", "api_keys"]
    field = secrets.Field({"plain 1": (5.0, 0.0, 0.0), "own key": (0.0, 20.0, 0.0), "after key": (0.0, 9.0, 0.0)}, np.zeros((3, 3)))
    for word in around:
        text = f"one two three four {word} five six seven eight"
        assert not secrets.plain(word) and both_ways([text], field)[0][1]
    free = secrets.Field({"plain 1": (10.0, 0.0, 0.0), "own key": (0.0, 50.0, 0.0)}, np.zeros((3, 3)))
    assert [(s, e) for s, _, e in both_ways(["my secretary here"], free)[0][1]] == [(3, 12)]


def test_dense_runs_are_long_stretches():
    rows = secrets.stretches_of(" ".join(["a1"] * 1000), [(0, 2)])
    assert len(rows) == -(-1000 // secrets.LONGEST) and sum(len(tags) for _, _, tags, _ in rows) == 1000 and rows[0][2][0] == secrets.BEGIN


def test_held_out_secrets_that_no_pattern_knows():
    """Recall on texts, values and forms that the fit has not seen, and false alarms on clean texts."""
    rng = random.Random(2)
    plain = words(900, 5)
    prose = lambda k: " ".join(rng.choices(plain, k=k))
    train, test, clean = ([prose(rng.randint(60, 400)) for _ in range(n)] for n in (500, 150, 150))
    known = tuple(f for f in secrets.SECRETS if f not in secrets.HELD_OUT)
    scorer = secrets.Scorer(secrets.fit_field(train, known))
    for forms in (known, secrets.HELD_OUT):
        hit = total = 0
        for t in test:
            copy, spans = secrets.planted(t, 7, forms)
            base, (found,) = secrets.base_spans(copy), secrets.field_spans([copy], scorer)
            for a, b, _ in spans:
                if not any(s < b and a < e for s, _, e in base):
                    total += 1
                    hit += any(s <= a and b <= e <= b + 32 for s, e in found)
        assert total > 300 and hit >= 0.9 * total
    assert sum(map(len, secrets.field_spans(clean, scorer))) == 0


def test_viterbi_matches_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(20):
        scores, moves = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
        value = lambda p: moves[0, p[0]] + sum(scores[k, t] for k, t in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p)) + moves[p[-1], 0]  # noqa: B023, E731
        assert tuple(secrets.viterbi(scores, moves)) == max(itertools.product(range(3), repeat=5), key=value)


def test_entities_of_the_same_texts_count_once(spark):
    """A contact list of 8,000 addresses, twice in the table: rows of words grow with its words, not with words times addresses; one minute."""
    import time

    contacts = " ".join(f"name{k} mail{k}x@host{k % 50}.example" for k in range(8000))
    texts = [(1, contacts), (2, contacts)] + [(10 + k, f"other words{k} here and there") for k in range(38)]
    df = docs(spark, texts)
    matches = pii.base_matches(df)
    held = pii.holders(matches, pii.base_spans(matches))
    pairs = pii.held_words(matches, held).selectExpr("sum(size(found))", "count(*)").first()
    assert pairs[0] <= 2 * pairs[1], "words times entities of one text"
    began = time.time()
    got = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    assert time.time() - began < 60
    assert len(got[1].base) == 8000 and got[1].spans == got[2].spans and [s.kind for s in got[1].spans].count(4) == 8000


def test_grouped_entities_find_the_terms_of_each(spark):
    """Random texts over few addresses: terms are those of a plain count of every pair of entity and term."""
    rng = random.Random(6)
    people = [f"p{k}@h{k % 3}.org" for k in range(12)]
    texts = []
    for k in range(150):
        some = rng.sample(range(12), rng.choice([0, 1, 1, 2, 4]))
        texts.append((k, " ".join([w for p in some for w in (people[p], f"nick{p}", f"pair{p // 2}")] + rng.sample(["alpha", "beta", "gamma", "delta", "rare%d" % (k // 2)], 3))))
    texts += texts[:20]
    n = len(texts)
    held = [({e for m in re.finditer(r"[a-z0-9]+@([a-z0-9]+\.org)", t) for e in ((m[0], 0), (m[1], 1))}, {w for w in re.findall(r"[^\W_]+", t) if w[0].isalpha()}) for _, t in texts]
    count_e, count_t, both = Counter(), Counter(), Counter()
    for es, ws in held:
        count_e.update(es)
        count_t.update(ws)
        both.update((e, w) for e in es for w in ws)
    told = {(e, w) for (e, w), b in both.items() if b >= pii.MIN_DOCS + e[1] and count_e[e] >= pii.MIN_DOCS + e[1] and count_e[e] < n and count_t[w] <= b * (n / count_e[e]) ** (1 - pii.ALPHA) * (1 + 1e-12)}
    got = pii.find_personal_data(docs(spark, texts)).collect()
    assert len(got) == n
    want = []
    for (i, text), (es, _) in zip(texts, held, strict=True):
        bases = [(s, e) for k, s, e in base(text)]
        terms = {w for e, w in told if e in es}
        want.append((i, sorted((m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text) if m[0].lower() in terms and not any(s < m.end() and m.start() < e for s, e in bases))))
    assert sorted((r.doc_id, sorted((s.start, s.stop) for s in r.spans if s.kind == 4)) for r in got) == sorted(want)
    assert sum(map(len, (w for _, w in want))) > 100
