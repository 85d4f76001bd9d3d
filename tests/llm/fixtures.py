"""Small tables with every odd case: nulls, empty and blank texts, ties, repeats, long texts, clashing columns."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra: bool = False):
    """texts: (doc_id, text) pairs. extra: columns whose names the operators use themselves."""
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for name in ("kind", "hash", "bucket", "list", "start", "stop", "_row", "_text", "_key", "_id", "_hash", "_text_hash", "item", "n", "size", "llr", "kept", "tails", "base", "dotted.name"):
            df = df.withColumn(name, F.lit(7))
    return df


def words(n: int, seed: int = 0) -> list[str]:
    import random

    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n)]


def odd_texts() -> list[tuple[int | None, str | None]]:
    long = " ".join(words(4000, 9))
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "héllo wörld"), (6, long), (6, long), (None, "no id here at all"), (8, "\x01\x02 odd \x00 marks"), (9, "a b c d e f g h"), (10, "A B C D E F G H")]
