"""Toxicity: ordinal regression of severity grades on sparse text features.

Weights are shared by all thresholds; every document gets its expected severity and the probability of each
grade's tail. The labels table grades 0 and 1 only; a finer scale needs nothing but more grades in it.

Defined results: null and empty text has no features, and the score of the thresholds alone; repeated rows give
repeated results; an empty table gives an empty result; without labels, or with one grade only, every document gets
the same score; of several grades of one id the largest counts. Other columns of the documents pass through; one that
has the name of an output column gives way to it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.ordinal import MIN_DOCS, MIN_Z, fit_on_labels, score_rows
from matchlake.llm.shared import unboxed

WORDS = re.compile(r"\w+")
#: Lengths of the beginnings that longer words have as features beside themselves.
STEMS = (4, 6)
#: Probability of grade 1 or more from which a document is flagged.
MIN_TAIL = 0.4


def features(text: str) -> set[str]:
    """Distinct lower-cased words and, of those that are longer, their beginnings: inflected forms share them."""
    found = set(WORDS.findall(text.lower()))
    return found.union(*({f"{w[:n]}\x00" for w in found if len(w) > n} for n in STEMS))


def grade_toxicity(docs: DataFrame, labels: DataFrame, n_grades: int = 2, min_tail: float = MIN_TAIL, min_docs: int = MIN_DOCS, min_z: float = MIN_Z) -> DataFrame:
    """docs with expected_severity, p_toxic = P(severity >= 1), and toxic."""
    grades = labels.select("doc_id", F.col("toxic").cast("int").alias("grade"))
    model = fit_on_labels(docs, grades, features, n_grades, min_docs=min_docs, min_z=min_z)
    out = score_rows(docs, model, features).withColumnRenamed("expected_grade", "expected_severity")
    out = out.withColumn("p_toxic", F.col("tails")[0]).withColumn("is_toxic", F.col("p_toxic") >= min_tail)
    return unboxed(out, "expected_severity", "p_toxic", "is_toxic")
