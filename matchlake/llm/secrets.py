"""Secret scan: fixed patterns, and a linear-chain conditional random field beside them.

The field tags every token of every text as beginning a secret, inside one, or outside. A token's features
are its own shape, its neighbours' shapes and key words, and features of the whole file. It is fitted on a
bounded sample of documents. Besides the patterns' own spans the sample teaches what patterns can't say: each text
also comes in a copy in which secrets of many forms are planted behind words that no pattern knows, or behind none,
and beside them numbers, names, addresses and paths that look like secrets and aren't. Such a copy's spans are known.

Decoding is Viterbi's over all tokens and exact for any weights. Every token's scores are computed; a run of
tokens that isn't outside gains at most its tokens' margins and a bound on its moves, so running sums show which tokens
no such run can cover (see open_tokens()). These are outside on the best path, and the chain falls apart into
stretches between them.

Defined results: null and empty text has no spans; repeated rows give repeated results; an empty table gives
an empty result; an empty sample gives a field that tags nothing. Other columns pass through;
columns named base or spans give way to the result's.
"""

from __future__ import annotations

import json
import random
import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.shared import boxed, small_batches, text_or_empty, tidied, unboxed, widened

#: Documents of the sample, and stretches of them that the field is fitted on, at most.
FIT_ROWS, FIT_STRETCHES = 3_000, 2_400
#: Tokens on either side of a marked one that a stretch of the sample has, and the longest stretch.
AROUND, LONGEST = 5, 32
STEPS, RATE, L2 = 120, 0.3, 5e-4
#: The sample has far more secrets than texts have; a span must make up for so many nats before it begins.
RARER = 2.0
KINDS = ("assign", "access", "hex", "crf")
OUT, BEGIN, INSIDE = 0, 1, 2

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+|[^\sA-Za-z0-9+/_=-]")
KEYWORD = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE)
#: Not plain: words that hold a key word, letters in long runs, runs with a digit or a mark in them, quotes and colons.
MARKED = re.compile(r"(?<![A-Za-z0-9+/_=-])(?:[A-Za-z-]{16,}|[A-Za-z-]*[0-9+/_=]|[A-Za-z-]*(?i:password|passwd|secret|token|apikey))[A-Za-z0-9+/_=-]*|[\"':]")
REACH = 2
#: Tokens with up to REACH more on either side, the place of the first one that counts, tags of those that count, file features.
Stretch = tuple[list[str], int, list[int], tuple[str, ...]]
_CLASSES_KEPT = 200_000
#: Places between two texts that are scored together: as far as features reach. Tokens scored at a time, unless one text has more.
WALL, SCORED = REACH, 200_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, in order of start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


_CHARS = {"l": re.compile("[a-z]"), "U": re.compile("[A-Z]"), "d": re.compile("[0-9]"), "s": re.compile("[+/_=]")}
_HEX = re.compile("[0-9a-f]+")


def shape(token: str) -> str:
    """The class of a token's characters and its length in steps."""
    size = min(6, len(token).bit_length())
    if token.isalpha() and token.islower():  # most tokens
        return f"l{size}"
    if len(token) == 1 and not token.isalnum():
        return f"mark{token}" if token in "\"':=,;()[]{}.@<>" else "mark"
    kind = "".join(name for name, has in _CHARS.items() if has.search(token))
    return f"hex{size}" if kind == "ld" and _HEX.fullmatch(token) else f"{kind}{size}"


def plain(token: str) -> bool:
    return not MARKED.fullmatch(token)


def classed(token: str) -> tuple[str, str, str, str, str]:
    """What the features know of a token: as a neighbour, whether it is plain, as itself, how varied it is, its kind beside file features."""
    near = "key" if KEYWORD.search(token) else shape(token)
    kind = near.rstrip("0123456789")
    varied = f"{kind}{8 * len(set(token)) // len(token)}" if len(token) >= 16 else "-"
    return near, f"plain {int(plain(token))}", f"own {near}", f"varied {varied}", kind + "!" * (not plain(token))


def features_at(tokens: list[str], at: int, file: tuple[str, ...]) -> list[str]:
    def near(k: int) -> str:
        return classed(tokens[at + k])[0] if 0 <= at + k < len(tokens) else "edge"

    own, is_plain, itself, varied, kind = classed(tokens[at])
    out = [is_plain, itself, varied, f"before {near(-1)}", f"after {near(1)}", f"before2 {near(-2)}", f"after2 {near(2)}", f"pair {near(-1)} {own}"]
    return [*out, *(f"file {x} {kind}" for x in file)]


def file_features(text: str) -> tuple[str, ...]:
    marks = sum(map(text.count, "=:{}\"'"))
    return (f"keys{min(3, sum(1 for _ in KEYWORD.finditer(text)))}", f"marks{min(6, (200 * marks // (len(text) + 1)).bit_length())}")


@dataclass(frozen=True)
class Field:
    weights: dict[str, tuple[float, float, float]]
    moves: np.ndarray  # [from, to]


class Scorer:
    """A field's scores of all tokens of a text. Tokens with the same features as neighbours and themselves share a class."""

    def __init__(self, field: Field):
        self.field = field
        self.of: dict[str, int] = {}  # token to class
        self.known: dict[tuple, int] = {}  # features to class
        self.rows: list[tuple] = []
        self.names: dict[str, int] = {"edge": 0}
        self.pairs = [(x.split(" ")[1], x.split(" ")[2], w) for x, w in field.weights.items() if x.startswith("pair ")]
        self.built = -1
        self.files: dict[tuple[str, ...], np.ndarray] = {}

    def _weight(self, name: str) -> tuple[float, float, float]:
        return self.field.weights.get(name, (0.0, 0.0, 0.0))

    def class_of(self, token: str) -> int:
        if len(self.of) > _CLASSES_KEPT:
            self.of.clear()
        found = classed(token)
        if found not in self.known:
            self.known[found] = len(self.rows)
            self.rows.append(found)
            self.names.setdefault(found[0], len(self.names))
        self.of[token] = k = self.known[found]
        return k

    def _build(self) -> None:
        sums = lambda names: np.sum([self._weight(n) for n in names], axis=0)
        self.own = np.array([sums(r[1:4]) for r in self.rows])
        self.side = {s: np.array([self._weight(f"{s} {n}") for n in self.names]) for s in ("before", "after", "before2", "after2")}
        self.name = np.array([self.names[r[0]] for r in self.rows])
        self.pair = np.zeros((len(self.names), len(self.names), 3))
        for a, b, w in self.pairs:
            if a in self.names and b in self.names:
                self.pair[self.names[a], self.names[b]] = w
        self.files.clear()
        self.built = len(self.rows)

    def ids(self, tokens: list[str]) -> np.ndarray:
        of = self.of
        return np.fromiter((k if (k := of.get(t)) is not None else self.class_of(t) for t in tokens), np.int64, len(tokens))

    def scores(self, texts: list[np.ndarray], files: list[tuple[str, ...]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the three tags for the tokens of some texts, given by their ids, one text after the other with a
        wall before, between and after them; and the places of the walls, where outside is certain."""
        if self.built != len(self.rows):
            self._build()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        walls = np.concatenate([[0], np.cumsum(sizes + WALL)])
        ids = np.zeros(int(walls[-1]) + WALL, np.int64)
        inside = np.zeros(len(ids), bool)
        for at, own in zip(walls[:-1].tolist(), texts, strict=True):
            ids[at + WALL : at + WALL + len(own)] = own
            inside[at + WALL : at + WALL + len(own)] = True
        of_file: dict[tuple[str, ...], int] = {}
        which = np.fromiter((of_file.setdefault(f, len(of_file)) for f in files), np.int64, len(files))
        for f in of_file:
            if f not in self.files:
                self.files[f] = np.array([np.sum([self._weight(f"file {x} {r[4]}") for x in f], axis=0) for r in self.rows])
        by_file = np.stack([self.files[f] for f in of_file])
        kept = ids[inside]
        out = np.zeros((len(ids), 3))
        name = np.where(inside, self.name[ids], 0)  # 0 is the edge
        at = np.flatnonzero(inside)
        side, mid = self.side, name[at]
        out[at] = self.own[kept] + by_file[np.repeat(which, sizes), kept] + self.pair[name[at - 1], mid] + side["before"][name[at - 1]] + side["after"][name[at + 1]] + side["before2"][name[at - 2]] + side["after2"][name[at + 2]]
        out[~inside, OUT] = 1000.0
        return out, walls


def open_tokens(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Whether the best path may leave outside at each token.

    Take a run of tokens that aren't outside, and make them outside: emissions lose at most the sum of their margins x, and
    moves at most first + (n - 1) * inner, by the best moves into, within and out of a run. A run on the best path loses
    nothing by staying, so its sum of x + inner is at least inner - first. The largest such sum over the runs that cover a token
    is that of its best run's end less that of its best run's start, both running extremes of one cumulative sum.
    """
    some = [BEGIN, INSIDE]
    stay = moves[OUT, OUT]
    first = moves[OUT, some].max() + moves[some, OUT].max() - 2 * stay
    inner = moves[np.ix_(some, some)].max() - stay
    total = np.concatenate([[0.0], np.cumsum(np.maximum(scores[:, BEGIN], scores[:, INSIDE]) - scores[:, OUT] + inner)])
    start = np.minimum.accumulate(total[:-1])
    stop = np.maximum.accumulate(total[:0:-1])[::-1]
    return stop - start >= inner - first - 1e-6


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """The best tags of a stretch that has outside before and after it."""
    best, back = scores[0] + moves[OUT], []
    for row in scores[1:]:
        step = best[:, None] + moves
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + row
    tags = [int((best + moves[:, OUT]).argmax())]
    for way in reversed(back):
        tags.append(int(way[tags[-1]]))
    return tags[::-1]


def field_spans(texts: list[str], scorer: Scorer, whole: bool = False) -> list[list[tuple[int, int]]]:
    """Spans that the field tags in each text. whole: decode every text as one stretch, as if all its tokens were open."""
    out: list[list[tuple[int, int]]] = []
    ids: list[np.ndarray] = []
    files: list[tuple[str, ...]] = []
    waiting = 0
    for text in texts if scorer.field.weights else ():
        ids.append(scorer.ids(TOKEN.findall(text)))
        files.append(file_features(text))
        waiting += len(ids[-1])
        if waiting >= SCORED:
            out += _tagged(texts[len(out) : len(out) + len(ids)], ids, files, scorer, whole)
            ids, files, waiting = [], [], 0
    if ids:
        out += _tagged(texts[len(out) : len(out) + len(ids)], ids, files, scorer, whole)
    return out or [[] for _ in texts]


def _tagged(texts: list[str], ids: list[np.ndarray], files: list[tuple[str, ...]], scorer: Scorer, whole: bool) -> list[list[tuple[int, int]]]:
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not sum(map(len, ids)):
        return out
    (scores, walls), moves = scorer.scores(ids, files), scorer.field.moves
    live = np.ones(len(scores), bool) if whole else open_tokens(scores, moves)
    for k in range(WALL):
        live[walls + k] = False
    edges = np.flatnonzero(np.diff(np.concatenate([[False], live, [False]])))
    tokens: dict[int, list[tuple[int, int]]] = {}  # of each text the first and last tokens of its spans
    for low, high in edges.reshape(-1, 2).tolist():
        at = int(np.searchsorted(walls, low, "right")) - 1
        begun, base = None, int(walls[at]) + WALL
        for k, tag in enumerate([*viterbi(scores[low:high], moves), OUT], low - base):
            if begun is not None and tag != INSIDE:
                tokens.setdefault(at, []).append((begun, k - 1))
                begun = None
            if tag != OUT and begun is None:
                begun = k
    for at, found in tokens.items():
        places = [m.span() for m in TOKEN.finditer(texts[at])]
        out[at] = [(places[a][0], places[b][1]) for a, b in found]
    return out


def scan(texts: list[str], scorer: Scorer, whole: bool = False) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Of each text its base spans, and all spans: those of the field that overlap no base span are added."""
    out = []
    for text, found in zip(texts, field_spans(texts, scorer, whole), strict=True):
        base = base_spans(text)
        free = [(a, 3, b) for a, b in found if not any(s < b and a < e for s, _, e in base)]
        out.append((base, sorted(base + free)))
    return out


def value_spans(text: str) -> list[tuple[int, int]]:
    """Where the patterns' secrets themselves lie: of an assignment its value, not its name."""
    return [ASSIGN.match(text, s).span(2) if kind == 0 else (s, e) for s, kind, e in base_spans(text)]


def stretches_of(text: str, secrets: list[tuple[int, int]]) -> list[Stretch]:
    """Stretches of tokens around every marked token of a whole text, tagged by the given spans. A stretch goes on
    while marked tokens follow closely, up to LONGEST tokens."""
    rows: list[Stretch] = []
    places = [m.span() for m in TOKEN.finditer(text)]
    tokens = [text[a:b] for a, b in places]
    tags = [OUT] * len(tokens)
    starts = [a for a, _ in places]
    for s, e in secrets:
        # a token that began before the value, such as name=value, is its beginning
        first = max(0, bisect_left(starts, s + 1) - 1)
        for k in range(first, len(places)):
            if places[k][0] >= e:
                break
            tags[k] = BEGIN if k == first else INSIDE
    file, spans = file_features(text), []
    for k in (i for i, t in enumerate(tokens) if not plain(t)):
        low, high = max(0, k - AROUND), min(len(tokens), k + AROUND + 1)
        if spans and low <= spans[-1][1]:
            spans[-1][1] = high
        else:
            spans.append([low, high])
    for low, high in spans:
        for a in range(low, high, LONGEST):
            b, start = min(high, a + LONGEST), max(0, a - REACH)
            rows.append((tokens[start : b + REACH], a - start, tags[a:b], file))
    return rows


#: Ways to name a secret that no pattern knows, and forms of what isn't one.
NAMES = ("pwd", "pass", "credential", "credentials", "auth", "bearer", "Authorization: Bearer", "private key", "access", "client key", "signing key", "login", "pin code", "license key", "passphrase", "connection string", "key", "session", "cookie", "salt")
JOINS = ("{n} {v}", "{n}: {v}", "{n}={v}", '{n} = "{v}"', "{n} is {v}", "{n}: '{v}'", "<{n}>{v}</{n}>", "{v}", "{v}", "({v})", '"{v}"')
_LOWER, _UPPER, _DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits


def _some(rng: random.Random, letters: str, low: int, high: int) -> str:
    return "".join(rng.choices(letters, k=rng.randint(low, high)))


def _mixed(rng: random.Random, letters: str, low: int, high: int) -> str:
    """Letters with two digits or more among them."""
    value = list(_some(rng, letters, low, high))
    for k in rng.sample(range(len(value)), 2):
        value[k] = rng.choice(_DIGITS)
    return "".join(value)


#: Forms of secrets. Those of HELD_OUT are left out of fits whose recall on unseen forms is measured.
SECRETS = {
    "alnum": lambda r: _mixed(r, _LOWER + _UPPER + _DIGITS, 14, 44),
    "base64": lambda r: _mixed(r, _LOWER + _UPPER + _DIGITS + "+/", 20, 60) + "=" * r.randint(0, 2),
    "prefixed": lambda r: _some(r, _LOWER, 2, 4) + r.choice("_-") + _mixed(r, _LOWER + _UPPER + _DIGITS, 16, 40),
    "upper": lambda r: _mixed(r, _UPPER + _DIGITS, 16, 32),
    "upper hex": lambda r: _mixed(r, _DIGITS + "ABCDEF", 24, 48),
    "short hex": lambda r: _mixed(r, _DIGITS + "abcdef", 18, 23),
    "lower": lambda r: _mixed(r, _LOWER + _DIGITS, 16, 36),
    "grouped": lambda r: "-".join(_mixed(r, _UPPER + _DIGITS, 5, 6) for _ in range(r.randint(4, 5))),
    "dotted": lambda r: "eyJ" + ".".join(_mixed(r, _LOWER + _UPPER + _DIGITS + "_-", 18, 40) for _ in range(3)),
    "underscored": lambda r: "_".join([_some(r, _LOWER, 2, 3), _some(r, _LOWER, 4, 4), _mixed(r, _LOWER + _UPPER + _DIGITS, 20, 30)]),
}
HELD_OUT = ("grouped", "underscored", "upper")
DECOYS = (
    lambda r: _some(r, _DIGITS, 1, 19),
    lambda r: " ".join(_some(r, _DIGITS, 4, 4) for _ in range(4)),
    lambda r: ".".join(str(r.randint(0, 255)) for _ in range(4)),
    lambda r: f"+{r.randint(1, 99)} ({r.randint(100, 999)}) {r.randint(100, 999)}-{r.randint(1000, 9999)}",
    lambda r: f"{r.randint(1900, 2099)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
    lambda r: f"{r.randint(0, 23)}:{r.randint(0, 59):02}:{r.randint(0, 59):02}",
    lambda r: f"{_some(r, _LOWER, 3, 9)}.{r.randint(0, 99)}@{_some(r, _LOWER, 3, 9)}{r.randint(0, 9)}.example.com",
    lambda r: f"https://www.{_some(r, _LOWER, 4, 12)}.org/{_some(r, _LOWER, 3, 12)}/{_some(r, _LOWER, 3, 12)}-{_some(r, _LOWER, 3, 9)}/{r.randint(1, 9999)}",
    lambda r: "/" + "/".join(_some(r, _LOWER, 2, 12) for _ in range(r.randint(2, 5))),
    lambda r: "_".join(_some(r, _LOWER, 2, 9) for _ in range(r.randint(2, 4))) + r.choice(["", "()", f"_{r.randint(0, 9)}"]),
    lambda r: "".join(_some(r, _LOWER, 2, 8).title() for _ in range(r.randint(2, 5))),
    lambda r: "-".join(_some(r, _LOWER, 2, 9) for _ in range(r.randint(2, 5))),
    lambda r: _some(r, _UPPER, 2, 14),
    lambda r: _some(r, _LOWER, 16, 34),
    lambda r: f"v{r.randint(0, 20)}.{r.randint(0, 40)}.{r.randint(0, 99)}",
    lambda r: f"{r.randint(1, 999)}{r.choice(['kg', 'km', 'th', 'px', 'GB', '%'])}",
    lambda r: f"{r.choice(NAMES)}: {_some(r, _LOWER, 3, 12)} {_some(r, _LOWER, 3, 9)}",
    lambda r: f'{r.choice(["the", "a", "this"])} {r.choice(["token", "password", "secret", "key"])} {_some(r, _LOWER, 2, 9)}',
    lambda r: f'{_some(r, _LOWER, 3, 9)} = "{_some(r, _LOWER, 3, 12)}"',
    lambda r: f"{_some(r, _LOWER, 3, 9)}={r.randint(0, 99999)}",
    lambda r: f'"{_some(r, _LOWER, 3, 9)}": {r.randint(0, 999)}',
)


def planted(text: str, seed: int, forms: tuple[str, ...] = tuple(SECRETS)) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with secrets and decoys among its words, and where the secrets are, with their forms. It depends on text and seed only."""
    rng = random.Random(f"{seed} {len(text)} {text[:64]}")
    gaps = [m.end() for m in re.finditer(r"\s+", text)] or [len(text)]
    picked = sorted(rng.sample(gaps, min(len(gaps), 6 + min(12, len(gaps) // 60))))
    parts, spans, at, last = [], [], 0, 0
    for gap in picked:
        parts.append(text[last:gap])
        at += gap - last
        last = gap
        if rng.random() < 0.4:
            form = rng.choice(forms)
            value = SECRETS[form](rng)
            told = rng.choice(JOINS).replace("{n}", rng.choice(NAMES))
            spans.append((at + told.index("{v}"), at + told.index("{v}") + len(value), form))
            piece = told.replace("{v}", value)
        else:
            piece = rng.choice(DECOYS)(rng)
        parts.append(piece + " ")
        at += len(piece) + 1
    return "".join([*parts, text[last:]]), spans


def lessons_of(text: str, forms: tuple[str, ...] = tuple(SECRETS)) -> list[Stretch]:
    """Stretches of a text with the patterns' spans as its secrets, and of its planted copy."""
    copy, spans = planted(text, 0, forms)
    return stretches_of(text, value_spans(text)) + stretches_of(copy, [(a, b) for a, b, _ in spans] + [s for s in value_spans(copy) if not any(a < s[1] and s[0] < b for a, b, _ in spans)])


def bounded_lessons(rows: list[Stretch], most: int = FIT_STRETCHES) -> list[Stretch]:
    """At most so many different stretches, half of them with a secret, those with the smallest hashes."""
    import hashlib

    order = sorted({json.dumps(r) for r in rows}, key=lambda x: hashlib.blake2b(x.encode(), digest_size=8).digest())
    held = [json.loads(x) for x in order]
    some, none = ([r for r in held if any(r[2]) == want] for want in (True, False))
    return some[: most // 2] + none[: most // 2]


def fit_field(texts: list[str], forms: tuple[str, ...] = tuple(SECRETS)) -> Field:
    return fit_stretches(bounded_lessons([s for text in texts for s in lessons_of(text, forms)]))


def fit_stretches(stretches: list[Stretch]) -> Field:
    """Full-batch Adam."""
    rows = [([features_at(tokens, i, tuple(file)) for i in range(first, first + len(tags))], tags) for tokens, first, tags, file in stretches]
    moves = np.zeros((3, 3))
    if not any(t != OUT for _, tags in rows for t in tags):
        return Field({}, moves)
    names: dict[str, int] = {}
    longest, n = max(len(t) for _, t in rows), len(rows)
    # a token has as many features as any other
    cols = np.array([[names.setdefault(f, len(names)) for f in fs] for r, _ in rows for fs in r])
    at = np.array([i * longest + k for i, (r, _) in enumerate(rows) for k in range(len(r))])
    gold = np.full((n, longest), -1)
    for i, (_, tags) in enumerate(rows):
        gold[i, : len(tags)] = tags
    live = gold >= 0
    onehot = np.where(live[:, :, None], np.eye(3)[np.maximum(gold, 0)], 0.0)
    both = live[:, 1:] & live[:, :-1]
    seen = np.einsum("nka,nkb->ab", onehot[:, :-1] * both[:, :, None], onehot[:, 1:] * both[:, :, None])
    free = np.zeros(3 * len(names) + 9)
    m, v = np.zeros_like(free), np.zeros_like(free)
    for step in range(1, STEPS + 1):
        w, t = free[:-9].reshape(-1, 3), free[-9:].reshape(3, 3)
        score = np.zeros((n * longest, 3))
        score[at] = w[cols].sum(axis=1)
        score = score.reshape(n, longest, 3)
        ahead = np.empty_like(score)
        ahead[:, 0] = score[:, 0]
        turn = np.exp(t)
        for k in range(1, longest):
            top = ahead[:, k - 1].max(axis=1, keepdims=True)
            new = np.log(np.exp(ahead[:, k - 1] - top) @ turn) + top + score[:, k]
            ahead[:, k] = np.where(live[:, k, None], new, ahead[:, k - 1])
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        behind = np.zeros_like(score)
        for k in range(longest - 2, -1, -1):
            after = score[:, k + 1] + behind[:, k + 1]
            top = after.max(axis=1, keepdims=True)
            new = np.log(np.exp(after - top) @ turn.T) + top
            behind[:, k] = np.where(live[:, k + 1, None], new, 0.0)
        share = np.where(live[:, :, None], np.exp(ahead + behind - total[:, None, None]), 0.0)
        pairs = np.exp(ahead[:, :-1, :, None] + t[None, None] + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None])
        off = np.repeat((onehot - share).reshape(-1, 3)[at], cols.shape[1], axis=0)
        g = np.concatenate([np.stack([np.bincount(cols.ravel(), weights=off[:, c], minlength=len(names)) for c in range(3)], axis=1).ravel(), (seen - np.where(both[:, :, None, None], pairs, 0.0).sum(axis=(0, 1))).ravel()])
        g = g / n - L2 * free
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        free = free + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w = free[:-9].reshape(-1, 3)
    moves = free[-9:].reshape(3, 3).copy()
    moves[OUT, BEGIN] -= RARER
    return Field({f: tuple(w[k].tolist()) for f, k in names.items()}, moves)


def fit_on_documents(docs: DataFrame, fit_rows: int = FIT_ROWS, fit_stretches_most: int = FIT_STRETCHES) -> Field:
    """Fit on stretches of at most fit_rows whole documents: a third or more of them with one of the patterns' own marks.

    Hashes of all texts choose the documents, hashes of all their stretches the stretches; only these reach the driver.
    """
    text = text_or_empty()
    likely = text.rlike(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}|(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]")
    rows = docs.select(F.xxhash64(text).alias("_at"), likely.alias("_likely")).distinct()
    part = lambda want, n: rows.filter(F.col("_likely") == want).select("_at").orderBy("_at").limit(n)
    keys = part(True, fit_rows * 2 // 3).unionByName(part(False, fit_rows // 3)).distinct()
    whole = docs.select(F.xxhash64(text).alias("_at"), text.alias("_text")).join(F.broadcast(keys), "_at", "left_semi")
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                found = lessons_of(cell.as_py())
                for at in range(0, len(found), 1000):
                    some = found[at : at + 1000]
                    yield pa.RecordBatch.from_arrays([pa.array([any(s[2]) for s in some], pa.bool_()), pa.array([json.dumps(s) for s in some], pa.string())], ["_has", "_cut"])

    cuts = whole.select("_text").mapInArrow(tidied(cut), "_has boolean, _cut string").select("_has", F.xxhash64("_cut").alias("_at"), "_cut")
    cuts = cuts.groupBy("_has", "_at").agg(F.min("_cut").alias("_cut"))
    half = lambda want: cuts.filter(F.col("_has") == want).orderBy("_at").limit(fit_stretches_most // 2)
    held = half(True).unionByName(half(False)).orderBy("_has", "_at").toArrow()
    return fit_stretches([json.loads(c.as_py()) for c in held.column("_cut")])


def find_secrets(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with base and spans: array<struct<kind string, start int, stop int>>, code points, stop exclusive."""
    field = fit_on_documents(docs) if field is None else field
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(field)
    rows = boxed(docs, _text=text_or_empty())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            both = scan(batch.column(batch.num_columns - 1).to_pylist(), scorer)
            lists = [pa.array([[{"kind": KINDS[k], "start": s, "stop": e} for s, k, e in x[i]] for x in both], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *lists], schema=pa.schema([*list(batch.schema)[:-1], ("base", kind), ("spans", kind)]))

    spans = "array<struct<kind:string,start:int,stop:int>>"
    return unboxed(rows.mapInArrow(tidied(find), widened(rows.drop("_text"), f"base {spans}, spans {spans}")), "base", "spans")
