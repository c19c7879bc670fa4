"""Quality classifier: naive Bayes support vectors.

N-gram indicators (of words, and of word shapes) are scaled by their class log-count
ratios, and a linear hinge-loss model is fitted to them by dual coordinate descent; margins
of folds left out calibrate the score. The model is fitted on at most ``most_rows``
labelled rows, chosen by a hash; every document is scored by its whole text.

Defined results: a null or empty text has no features and the score of the bias; without
labels of both classes every score is the smoothed share of label 1 (0.5 without any);
repeated rows are scored as rows; of repeated labels of a doc_id the largest counts, of
repeated training documents the smallest text; a null doc_id is never held out; a very
long text is scored whole, a text being in memory at a time; an empty table gives an empty
result. ``classify`` replaces columns called held_out, score and predicted and keeps all
others; ``keep_good`` keeps every column as it is, those too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import linear
from corpusloom.llm.text_features import QUALITY_FEATURES, add_scores, held_out, keep_scored, quality_features, training_sample

MOST_ROWS = 12_000
THRESHOLD = 0.7


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS) -> linear.LinearModel:
    rows, target = training_sample(docs, labels, label, quality_features, most_rows)
    return linear.fit(rows, target, target, QUALITY_FEATURES)


def classify(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` and held_out, score, predicted."""
    scored = add_scores(docs, fit(train_docs, labels, label), quality_features)
    return scored.withColumns({"held_out": held_out(), "predicted": (F.col("score") >= threshold).cast("int")})


def keep_good(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are predicted to be good, with their own columns."""
    return keep_scored(docs, fit(train_docs, labels, label), quality_features, threshold)
