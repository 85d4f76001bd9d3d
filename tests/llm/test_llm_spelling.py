"""Spelling variants against a brute-force version, deletion keys against strings, and the registered SQL."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from matchlake.llm import queries, spelling
from tests.conftest import duck, rows_of
from tests.llm.fixtures import docs, odd_texts

UPPER = str.maketrans(spelling.UPPER, spelling.LOWER)


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(texts):
    n = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    by = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w in n:
        top = min(by[w], key=lambda v: (-n[v], v), default=None)
        form[w] = top if top and n[top] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(by[w]), n[form[w]] if form[w] else None))
    return out


def spelled(seed: int) -> list[tuple[int | None, str]]:
    """Words of few letters, their copies with one and two edits, chains of frequencies, and one word of 3,000 letters."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abß") for _ in range(rng.randint(7, 9))) for _ in range(60)]
    words = []
    for k, stem in enumerate(stems):
        words += [stem] * rng.choice([1, 2, 3, 30, 400])
        edited = stem[:3] + rng.choice(["", "x", "ab"]) + stem[3 + rng.randint(0, 1) :]
        words += [edited] * rng.choice([1, 2, 4, 40])
        words += [stem.upper() if k % 3 else stem.capitalize()]
    long = "".join(rng.choice("abcé") for _ in range(3000))
    words += [long, long, long[:77] + long[78:], long[:77] + long[78:], "Ärgernis×÷", "Ärgernis×÷", "aaaaaaaa", "aaaaaaaa", "aaaaaaa", "aaaaaaa", "short", "short"]
    words += ["zzyyxxw"] * 900 + ["zzyyxxwq"] * 60 + ["zzyyxxwqk"] * 4  # a chain of two forms
    rng.shuffle(words)
    return [(i, " ".join(words[i::7]) + "; 12") for i in range(7)]


def test_deletion_keys_are_those_of_strings():
    words = ["aabbccdd", "abcdefg", "aaaaaaa", "", "é", "ab"]
    key, of, place = spelling.deletion_keys(words)
    seen: dict[tuple, set[int]] = {}
    for k, w, p in zip(key.tolist(), of.tolist(), place.tolist(), strict=True):
        word = words[w]
        at = p if p >= 0 else spelling.INSERTED - p
        text = word if p == spelling.WORD else word[:at] + word[at + 1 :]
        seen.setdefault((p if p >= 0 else -1, text), set()).add(k)
    assert all(len(v) == 1 for v in seen.values()) and len({min(v) for v in seen.values()}) == len(seen)
    assert Counter(of.tolist())[2] == 1 + 1 + 7
    assert len(spelling.shared_keys(np.array([5, 5, 6, 7, 7, 8, 8]), np.array([2, 2, 1, -1, -4, -4, -9]))) == 4


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_equal_brute_force(spark, seed):
    texts = spelled(seed) + odd_texts() + [(50, None), (51, ""), (None, "abcdefgh abcdefgh")]
    got = spelling.spelling_variants(docs(spark, texts, extra=True)).collect()
    assert len(got) == len({r.word for r in got})
    want = brute(texts)
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want
    assert any(f and r != f for _, f, r, *_ in want), "no chain of two forms in this fixture"


def test_equal_hashes_of_different_strings_join_nothing(spark, monkeypatch):
    """All words under one base: with a base of 1 hashes forget the order of letters, and strings decide."""
    texts = [(1, "abcdefgx abcdefgx gfedcbax gfedcbax abcdefgy abcdefgy gfedcbaz xgfedcba xgfedcba")]
    key = spelling.deletion_keys
    monkeypatch.setattr(spelling, "BASE", 1)
    assert key(["abcdefgx"])[0][0] == key(["xgfedcba"])[0][0]
    words = spelling.count_words(docs(spark, texts), damage=False).collect()
    table = spark.createDataFrame([(k, r.word, r.n) for k, r in enumerate(words)], "id long, word string, n long")
    ids = table.toPandas()

    def weak(batches):
        spelling.BASE = 1
        yield from spelling._make_keys(batches)

    monkeypatch.setattr(spelling, "tidied", lambda f: weak if f is spelling._make_keys else f)
    got = {ids.word[ids.id == r.id].item(): r.n_near for r in spelling.near_words(table).collect()}
    names = list(ids.word)
    assert got == {w: k for w in names if (k := sum(near(w, v) for v in names))}


def test_empty_table(spark):
    empty = docs(spark, [])
    assert spelling.spelling_variants(empty).count() == 0
    assert spelling.spelling_variants(docs(spark, [(1, "no letters run here")])).count() == 0


def test_spelling_sql(spark):
    sf = "/root/testdata/sf0.001"
    want = duck(sf).sql(queries.SQL["op12_spelling_variants"]).df()
    assert rows_of(queries.op12_spelling_variants(spark, sf).toPandas()) == rows_of(want) and len(want) > 100
