"""A training corpus from documents: each stage is one operator, applied to all that the last one kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of
documents; the last adds the pieces of each text, and whether decoding gives it back.

Defined results, for every stage: a null text counts as empty; other columns, whatever
their names, keep their values; an empty table gives an empty result; very long texts are
taken whole. Null keys, ties and repeated rows are as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import exact_dedup, mixing, near_join, pieces, quality
from corpusloom.llm.queries import vocabulary
from corpusloom.llm.shared import materialize, scratch, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good stay; it learns from labelled rows of the whole table.

    Repeated rows are judged alike; a score of exactly the threshold stays; without labels
    of both classes all documents have one score.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: that of the longest original, then of the smallest doc_id (null last); one of its repeated rows."""
    return exact_dedup.keep_one(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked texts stays: that of the smallest doc_id (all of its repeated rows; rows without a doc_id where the class has no other)."""
    return near_join.keep_one(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: repeated rows one by one, a null source as a source of its own, texts without words never."""
    return mixing.mixture(docs)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids, score and whether decoding gives the text back; columns of these names are replaced."""
    return pieces.encode(docs, vocabulary("piece_bpe_32k.model"), check=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("source mixture", source_mixture),
    ("SentencePiece encoding", sentence_pieces),
]

#: SQL can't express the classifier; tests hold each stage's operator against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), scratch(spark, "pipeline"))
    return STAGES[-1][1](spark, docs, sf_dir)
