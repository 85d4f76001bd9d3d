"""Quality classifier: ordinal regression on graded ratings.

Grades: 0 poor, 1 good but toxic, 2 good and clean (from labels.quality and labels.toxic). The features are
hashed pieces of the text and a few hashed marks of its shape. Every document gets its expected grade and
P(grade >= 1), by which it is selected.

Defined results: null and empty text has the shape marks of an empty text only; repeated rows give repeated
results; an empty table gives an empty result; without labels every document gets the same score. Other
columns of the documents pass through; one that has the name of an output column gives way to it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.ordinal import MIN_DOCS, MIN_Z, fit_on_labels, score_rows
from matchlake.llm.shared import unboxed

PIECES = re.compile(r"\w+|[^\w\s]+")
#: Tail probability from which a document is selected.
MIN_TAIL = 0.5


def features(text: str) -> set[str]:
    """Distinct lower-cased pieces, and marks of length, repetition, capitals and symbols in steps."""
    pieces = PIECES.findall(text)
    found = {p.lower() for p in pieces}
    n = len(pieces)
    words = [p for p in pieces if p[0].isalpha()]
    found.add(f"\x00long{n.bit_length()}")
    if n:
        found.add(f"\x00distinct{10 * len(found) // (n + 1)}")
        found.add(f"\x00marks{20 * (n - len(words)) // n}")
        found.add(f"\x00again{10 * sum(a == b for a, b in zip(pieces, pieces[1:], strict=False)) // n}")
    if words:
        found.add(f"\x00capitals{10 * sum(w.isupper() for w in words) // len(words)}")
    return found


def classify_quality(docs: DataFrame, labels: DataFrame, min_tail: float = MIN_TAIL, min_docs: int = MIN_DOCS, min_z: float = MIN_Z) -> DataFrame:
    """docs with expected_grade, p_good = P(grade >= 1), and selected."""
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 2)
    model = fit_on_labels(docs, labels.select("doc_id", grade.alias("grade")), features, 3, min_docs=min_docs, min_z=min_z)
    out = score_rows(docs, model, features)
    out = out.withColumn("p_good", F.col("tails")[0]).withColumn("selected", F.col("p_good") >= min_tail)
    return unboxed(out, "expected_grade", "p_good", "selected")
