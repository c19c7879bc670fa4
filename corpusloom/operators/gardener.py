"""Upkeep of the graph: proposals of links for notes without any."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.retrieval import knn
from corpusloom.operators.scans import first_per


def similar_notes(of: DataFrame, visible_vectors: DataFrame, least: float, limit: int) -> DataFrame:
    """query_id, id, similarity of the closest notes above the threshold, a note itself aside."""
    near = knn(of.select(F.col("id").alias("query_id"), "embedding"), visible_vectors, limit, exclude_self=True, least=least)
    return near.withColumn("similarity", 1 - F.col("distance"))


def suggestions(orphans: DataFrame, visible_vectors: DataFrame, least: float = 0.7, per_note: int = 5, most: int = 50) -> DataFrame:
    """Pairs of an orphan and a similar note: first nomination of a pair in note order, up to ``most``."""
    found = similar_notes(orphans, visible_vectors, least, per_note)
    pairs = found.select("query_id", "rank", F.least("query_id", "id").alias("from_id"), F.greatest("query_id", "id").alias("to_id"), "similarity")
    once = first_per(pairs, ["from_id", "to_id"], ["query_id", "rank"], 1, "__first")
    chosen = once.orderBy("query_id", "rank").limit(most)
    return chosen.select("from_id", "to_id", "similarity", reason(F.col("similarity")).alias("reason"))


def reason(similarity):
    return F.format_string("High semantic similarity (%.1f%%)", similarity * 100)


def as_proposals(found: DataFrame) -> DataFrame:
    return found.select(
        F.concat(F.lit("proposed_edge:"), F.sha2(F.concat_ws(":", F.lit("related_to"), "from_id", "to_id"), 256)).alias("id"),
        "from_id", "to_id", F.lit("related_to").alias("edge_type"), F.col("similarity").alias("confidence"), "reason", F.lit("gardener-similarity").alias("generator"),
    )


def near_duplicates(tokens: DataFrame, least: float = 0.85) -> DataFrame:
    """Pairs whose token multisets reach a Jaccard similarity, by prefix filtering.

    ``tokens``: group_id, id, token, n. Within a group, every token occurrence is an
    element; a pair that reaches the threshold shares one of each text's rarest elements,
    so only those are joined.
    """
    sizes = tokens.groupBy("group_id", "id").agg(F.sum("n").alias("size"))
    frequency = tokens.groupBy("group_id", "token").agg(F.count("*").alias("df"))
    running = Window.partitionBy("group_id", "id").orderBy("df", "token").rowsBetween(Window.unboundedPreceding, -1)
    ordered = tokens.join(frequency, ["group_id", "token"]).join(sizes, ["group_id", "id"]).withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0)))
    prefix = ordered.filter(F.col("before") <= F.col("size") - F.ceil(F.col("size") * least)).select("group_id", "id", "token", "size")
    left, right = prefix.alias("a"), prefix.alias("b")
    pairs = left.join(right, (F.col("a.group_id") == F.col("b.group_id")) & (F.col("a.token") == F.col("b.token")) & (F.col("a.id") < F.col("b.id")))
    pairs = pairs.filter(F.least("a.size", "b.size") >= F.greatest("a.size", "b.size") * least).select("a.group_id", F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), F.col("a.size").alias("left_size"), F.col("b.size").alias("right_size")).distinct()
    a, b = tokens.select("group_id", F.col("id").alias("left_id"), "token", F.col("n").alias("left_n")), tokens.select("group_id", F.col("id").alias("right_id"), "token", F.col("n").alias("right_n"))
    shared = pairs.join(a, ["group_id", "left_id"]).join(b, ["group_id", "right_id", "token"]).groupBy("group_id", "left_id", "right_id", "left_size", "right_size").agg(F.sum(F.least("left_n", "right_n")).alias("shared"))
    scored = shared.withColumn("similarity", F.col("shared") / (F.col("left_size") + F.col("right_size") - F.col("shared")))
    return scored.filter(F.col("similarity") >= least).select("group_id", "left_id", "right_id", "similarity")
