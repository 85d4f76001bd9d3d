"""Lattice scores against plain Python: all segmentations written out, expected counts by hand, and the base by counting."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from matchlake.llm import lattice, queries
from tests.llm.fixtures import docs, odd_texts

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pieces():
    return lattice.read_pieces(PATH)


def segmentations(word: bytes, pieces: dict[bytes, int]):
    if not word:
        yield ()
    for k in range(1, len(word) + 1):
        if word[:k] in pieces:
            for rest in segmentations(word[k:], pieces):
                yield (pieces[word[:k]], *rest)


def plain(words: Counter, pieces, ends: int, rounds: int, prior: float):
    """Weights and log10 probabilities by writing out every segmentation."""
    number = {s: k for k, s in enumerate(pieces.surfaces, 1)}
    ways = {w: list(segmentations(lattice.MARK + w, number)) for w in words}
    weight = pieces.first
    for _ in range(rounds):
        counts = np.zeros(len(weight))
        for w, c in words.items():
            if c:
                p = [math.prod(weight[k] for k in way) for way in ways[w]]
                for way, x in zip(ways[w], p, strict=True):
                    for k in way:
                        counts[k] += c * x / sum(p)
        counts[0] = ends
        weight = (counts + prior * pieces.first) / (counts.sum() + prior)
    return weight, {w: math.log10(sum(math.prod(weight[k] for k in way) for way in ways[w])) for w in words}


def test_forward_sums_all_segmentations(pieces):
    number = {s: k for k, s in enumerate(pieces.surfaces, 1)}
    words = [b"a", b"the", b"then", "é".encode(), b"\xff\x00", b"x1,", "▁a".encode(), b"", b"inning"]
    got, counts = pieces.forward(words, pieces.first, np.arange(len(words)))
    every = [[math.prod(pieces.first[k] for k in way) for way in segmentations(lattice.MARK + w, number)] for w in words]
    assert np.allclose(got, [math.log(sum(p)) for p in every], rtol=1e-12)
    want = Counter()
    for c, (w, p) in enumerate(zip(words, every, strict=True)):
        for way, x in zip(segmentations(lattice.MARK + w, number), p, strict=True):
            for k in way:
                want[k] += c * x / sum(p)
    assert np.allclose(counts, [want[k] for k in range(len(counts))], rtol=1e-9)
    assert max(len(p) for p in every) > 30 and abs(pieces.first.sum() - 1) < 1e-12


def test_long_word_and_its_parts(pieces):
    """One word of 60,000 letters goes with short ones; probabilities of a repeated letter fall steadily."""
    long = b"ab" * 30_000
    got, _ = pieces.forward([b"a", long, b"the"], pieces.first)
    alone = [pieces.forward([w], pieces.first)[0][0] for w in (b"a", long, b"the")]
    assert np.allclose(got, alone) and np.isfinite(got).all() and got[1] < -30_000


def test_probabilities_of_all_words_sum_to_one():
    """Over a tiny vocabulary: the strings that the model can draw before the end have probability one together."""
    tiny = lattice.Pieces({lattice.MARK: 1.0, b"a": 2.0, b"b": 1.0, b"ab": 3.0}, 4.0)
    free = [lattice.MARK + bytes(w) for n in range(13) for w in itertools.product(b"ab", repeat=n)]
    first = np.exp(tiny.forward([w[len(lattice.MARK) :] for w in free], tiny.first)[0])
    # a word is its mark, then letters until the next mark or the end
    letters = sum(tiny.first[[k for k, s in enumerate(tiny.surfaces, 1) if s != lattice.MARK]])
    assert abs(first.sum() / tiny.first[1 + tiny.surfaces.index(lattice.MARK)] - 1 / (1 - letters)) < 0.02


def test_words_of_a_text():
    rng = random.Random(2)
    data = "".join(rng.choice("aB é\t\n\x0b\x0c\r   \x1c1") for _ in range(5000)).encode()
    want = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), data))
    for step in (1, 7, 1 << 20):
        assert [w for part in lattice.tokens(data, step) for w in part] == want


def test_scores_equal_plain_python(spark, pieces, monkeypatch):
    rng = random.Random(5)
    pool = ["the", "The", "then", "né", "a", "x1", "ab,", "on", "ﬀ", "in"]
    texts = [(k, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) + f" w{k}") for k in range(40)]
    texts += [(k, t) for k, t in odd_texts() if t is None or len(t) < 100] + [(3, "\x1c the")]
    monkeypatch.setattr(lattice, "CHUNK_TOKENS", 50)
    got = lattice.score_documents(docs(spark, texts, extra=True).repartition(3), PATH, prior=10.0).collect()
    held = {k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in texts}
    words = [[w for part in lattice.tokens((t or "").encode()) for w in part] for _, t in texts]
    train = Counter(w for (k, _), ws in zip(texts, words, strict=True) if not held[k] for w in ws)
    ends = sum(not held[k] for k, _ in texts)
    n, v = sum(train.values()) + ends, len(train) + 1
    every = Counter({w: train[w] for ws in words for w in ws})
    weight, p = plain(every, pieces, ends, lattice.ROUNDS, 10.0)
    want = sorted(
        (str(k), held[k], len(ws) + 1, sum(train[w] > 0 for w in ws) + 1, n, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1)), 6), round(sum(p[w] for w in ws) + math.log10(weight[0]), 4))
        for (k, _), ws in zip(texts, words, strict=True)
    )
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 4)) for r in got) == want
    assert any(held.values())


def test_query_base_equals_counting(spark):
    """op11_lm_scoring's counts and base over the whole table; and the fitted weights beat the vocabulary's own on held-out rows."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows}
    words = {r.doc_id: [w for part in lattice.tokens((r.text or "").encode()) for w in part] for r in rows}
    train = Counter(w for i, ws in words.items() if not held[i] for w in [*ws, None])
    n, v = sum(train.values()), len(train)
    got = {r.doc_id: r for r in queries.op11_lm_scoring(spark, SF).collect()}
    assert got.keys() == words.keys()
    for i, ws in words.items():
        ws = [*ws, None]
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(ws), sum(train[w] > 0 for w in ws), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
    own = {r.doc_id: r.score for r in lattice.score_documents(spark.read.parquet(f"{SF}/documents.parquet"), PATH, rounds=0).collect()}
    assert sum(got[i].score for i in own if held[i]) > sum(own[i] for i in own if held[i])


def test_empty_table_and_no_training_rows(spark):
    from pyspark.sql import functions as F

    assert lattice.score_documents(docs(spark, []), PATH).count() == 0
    row = lattice.score_documents(docs(spark, [(1, "a b")]), PATH, held=F.lit(True)).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0) and math.isfinite(row.score)
