"""Toxicity of documents: an ordinal regression of severity grades on the words of a text.

A feature is a word, in lower case, that occurs in the text, however often and however
long the text is. Only words count whose labelled texts have clearly other grades than
the rest; most words of a text say nothing about its severity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorleaf.llm import ordinal
from mirrorleaf.llm.arrow import words


def features(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    hashes, _, _, offsets = words(pa.array([(t or "").lower() for t in texts], pa.large_string()))
    rows = [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return [(r, np.ones(len(r))) for r in rows]


def toxicity_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_id_col: str = "doc_id", grade_col: str = "toxic", **options) -> ordinal.Ordinal:
    """Fit the severities of ``labels`` on the texts of ``docs``; see ordinal.train."""
    options = {"screen": 4.0, "penalty": 1e-6, "steps": 400, **options}
    return ordinal.train(docs, labels, features, id_col, text_col, label_id_col, grade_col, **options)


def grade_toxicity(docs: DataFrame, model: ordinal.Ordinal, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3) -> DataFrame:
    """(id, expected_severity, p_toxic, toxic) for each row of ``docs``.

    p_toxic is the probability of more than the lowest grade; a row is toxic from
    ``least`` on. Null and empty texts have no features and get the grade of such a
    text. If the labels have fewer than two grades, p_toxic is null and no row is toxic.
    Repeated rows get a row each; an empty table gives none.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = ordinal.graded(rows, model, features)
    p = F.try_element_at("tail", F.lit(1))
    return out.select(
        "id", F.col("expected_grade").alias("expected_severity"), p.alias("p_toxic"), F.coalesce(p >= least, F.lit(False)).alias("toxic")
    )
