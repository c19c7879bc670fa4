"""Exact duplicates by content sort, with DataFrame functions only.

Texts are normalised by deleting ASCII white space. Sampled splitters range-partition
the normalised texts (Spark's range exchange over a short prefix, a hash and a salt), an
external sort inside each range brings equal texts together, and the sorted aggregation
compares each whole text with its neighbour; a run keeps one identifier.

A group that holds a large part of all rows is salted: it becomes several adjacent runs
in different ranges, whose one-row results are stitched together. Which groups are that
large is counted first on digests, and there are at most ``HOT_GROUPS`` of them.

Texts are normalised and hashed once, into a table in the shared folder.

Defined results: a null text counts as empty; all empty texts are one group; among equal
texts the row with the most code points in the original stays, then the smallest doc_id
(a null doc_id comes last); repeated rows of one doc_id share their decision (``keep_one``
keeps one of them); a very long text is compared whole; an empty table gives an empty
result; other columns, whatever their names, are ignored, and kept by ``keep_one``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import shared
from corpusloom.llm.shared import SPACE, free_name, join_counted, materialize, scratch, text_or_empty

SALTS = 64


def normalised(name: str = "text"):
    return F.regexp_replace(text_or_empty(name), SPACE, "")


def exact_groups(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, text_sha256, keep_id, group_size, kept."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.char_length(text_or_empty()).cast("long").alias("n_chars"), normalised().alias("norm"))
    # the splitters see the first characters and a hash; the comparison sees whole texts
    texts = texts.select("doc_id", "n_chars", F.sha2("norm", 256).alias("text_sha256"), F.substring("norm", 1, 16).alias("prefix"), F.xxhash64("norm").alias("hashed"), "norm")
    texts = materialize(texts, scratch(spark, "exact-texts"))
    base = texts.select("doc_id", "n_chars", "text_sha256")
    rows = texts.count()
    hot = base.groupBy("text_sha256").agg(F.count("*").alias("n")).filter(F.col("n") > max(shared.HOT_ROWS, rows // shared.HOT_GROUPS))
    hot = materialize(hot.select("text_sha256"), scratch(spark, "exact-hot"))
    salted = texts.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "text_sha256", "left").select(
        "prefix",
        "hashed",
        F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "n_chars"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int").alias("salt"),
        "norm",
        "text_sha256",
        F.struct((-F.col("n_chars")).alias("fewer"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id")).alias("order"),
    )
    keys = ["prefix", "hashed", "salt"]
    runs = (
        salted.repartitionByRange(*keys)
        .sortWithinPartitions(*keys, "norm")
        .groupBy(*keys, "norm", "text_sha256")
        .agg(F.min("order").alias("order"), F.count("*").alias("n"))
    )
    groups = runs.groupBy("text_sha256").agg(F.min("order").alias("order"), F.sum("n").alias("group_size"))
    groups = groups.filter(F.col("group_size") > 1).select("text_sha256", F.col("order.doc_id").alias("keep_id"), "group_size")
    groups = materialize(groups, scratch(spark, "exact-groups"))
    return join_counted(base, groups, "text_sha256", "group_size", rows, "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
        "n_chars",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns; of repeated rows of one doc_id, one stays."""
    number, sha, size, same, own_sha, own_size = (free_name(docs, x) for x in ("id", "sha", "size", "same", "own_sha", "own_size"))
    kept = exact_groups(docs).filter("kept").groupBy("doc_id", "text_sha256", "n_chars").agg(F.count("*").alias(same))
    kept = kept.select(F.col("doc_id").alias(number), F.col("text_sha256").alias(sha), F.col("n_chars").alias(size), same)
    keyed = docs.withColumns({own_sha: F.sha2(normalised(), 256), own_size: F.char_length(text_or_empty()).cast("long")})
    found = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col(number)) & (F.col(own_sha) == F.col(sha)) & (F.col(own_size) == F.col(size)))
    again = found.filter(F.col(same) > 1).dropDuplicates([number, own_sha, own_size])
    return found.filter(F.col(same) == 1).unionByName(again).select(*[F.col(f"`{c}`") for c in docs.columns])
