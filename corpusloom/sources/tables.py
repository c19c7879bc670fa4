"""The note, entity, edge and chat model over the supplied Parquet tables.

Everything is a lazy projection of a scan, so filters and column choices reach Parquet.
Documents are notes, embeddings their vectors, conversations chats, nations entities;
links between notes follow from the document numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE_TYPES = ("supports", "contradicts", "related_to", "derived_from")
EPOCH = "2024-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at_hour(hours: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + hours * 3600)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes without their vectors: most queries need none."""
    d = read(spark, sf_dir, "documents")
    key = F.col("doc_id")
    return d.select(
        F.concat(F.lit("note:"), key).alias("id"),
        F.concat_ws(" ", "lang", "source").alias("title"),
        F.col("text").alias("content"),
        F.array("lang").alias("tags"),
        F.concat(F.lit("source:"), "source").alias("source_id"),
        F.when(key % 7 == 0, 0).when(key % 7 != 1, 1).cast("long").alias("source_generation"),
        (key % 10).alias("chunk_ordinal"),
        at_hour(key).alias("created_at"),
        key.alias("doc_id"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.concat(F.lit("note:"), "vec_id").alias("id"), "embedding", "label")


def notes_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).join(vectors(spark, sf_dir).drop("label"), "id", "left")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("documents"))
    number = F.regexp_extract("source", "[0-9]+", 0).cast("long")
    return d.select(
        F.concat(F.lit("source:"), "source").alias("id"),
        F.concat(F.lit("fixture://"), "source").alias("uri"),
        F.lit(1).cast("long").alias("successful_generation"),
        F.when(number % 4 == 0, 2).otherwise(1).cast("long").alias("generation"),
        F.when(number % 4 == 0, "pending").otherwise("ready").alias("status"),
        at_hour(number).alias("created_at"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select(
        F.concat_ws(":", F.lit("message"), "conv_id", "turn").alias("id"),
        F.concat(F.lit("conversation:"), "conv_id").alias("conversation_id"),
        F.col("turn").alias("message_index"),
        F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("role"),
        F.col("text").alias("content"),
        at_hour(F.col("conv_id") * 24 + F.col("turn")).alias("created_at"),
        "conv_id",
    )


def _vectors_by(spark: SparkSession, sf_dir: str, rows: DataFrame, number: Column) -> DataFrame:
    """id and embedding of rows, the vector being that of the number modulo how many there are."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("__v"), "embedding")
    return rows.withColumn("__v", number % v.count()).join(v, "__v").select("id", "embedding")


def message_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors_by(spark, sf_dir, messages(spark, sf_dir), F.col("conv_id") * 31 + F.col("message_index"))


def chat_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chats(spark, sf_dir)
    return _vectors_by(spark, sf_dir, rows, F.split_part("id", F.lit(":"), F.lit(2)).cast("long") * 17 + 3)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch jobs with leases, one per supplier."""
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("job:"), k).alias("id"),
        F.element_at(F.array(*[F.lit(x) for x in ("pending", "running", "failed", "cancelled", "completed")]), (k % 5 + 1).cast("int")).alias("status"),
        F.when(k % 3 == 0, F.lit("worker-a")).when(k % 3 == 1, F.lit("worker-b")).alias("lease_owner"),
        F.when(k % 3 != 2, at_hour(k)).alias("lease_expires_at"),
    )


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation; its summary is the first thing that the assistant says."""
    said = F.when(F.col("role") == "assistant", F.struct("message_index", "content"))
    return messages(spark, sf_dir).groupBy("conversation_id", "conv_id").agg(
        F.min(said)["content"].alias("summary"), F.count("*").alias("messages"), F.max("created_at").alias("updated_at")
    ).select(F.col("conversation_id").alias("id"), F.concat(F.lit("chat-"), "conv_id").alias("uuid"), F.concat(F.lit("Chat "), "conv_id").alias("title"), "summary", "messages", "updated_at", F.concat(F.lit("fixture://chat/"), F.col("conv_id") % 5).alias("source_uri"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("entity:"), "n_nationkey").alias("id"),
        F.col("n_name").alias("name"),
        F.lower(F.trim("n_name")).alias("canonical_name"),
        F.array(F.concat_ws(" ", F.lower(F.trim("r_name")), F.lower(F.trim("n_name")))).alias("aliases"),
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id")
    first = d.filter("doc_id % 4 <> 3").select("doc_id", (F.col("doc_id") % 25).alias("nation"))
    second = d.filter("doc_id % 3 = 0").select("doc_id", (F.col("doc_id") * 7 % 25).alias("nation"))
    both = first.unionByName(second).distinct()
    return both.select(F.concat(F.lit("note:"), "doc_id").alias("note_id"), F.concat(F.lit("entity:"), "nation").alias("entity_id"))


#: What note a note links to by each type: every how many notes, and the other note's number from (its number, how many notes).
LINKS: dict[str, tuple[int, Callable]] = {
    "supports": (2, lambda k, n: (k * 7 + 3) % n),
    "contradicts": (3, lambda k, n: (k * 5 + 1) % n),
    "related_to": (4, lambda k, n: (k * 11 + 5) % n),
    "derived_from": (5, lambda k, n: F.floor(k / 2)),
}


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four note-to-note tables as one, with edge_type."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"))
    n = d.count()
    parts = []
    for kind, (every, other) in LINKS.items():
        to = other(F.col("k"), F.lit(n)).cast("long")
        pair = (F.least("k", to), F.greatest("k", to)) if kind == "related_to" else (F.col("k"), to)
        parts.append(
            d.filter((F.col("k") % every == 0) & (F.col("k") != to)).select(
                F.concat_ws(":", F.lit(kind), "k").alias("id"),
                F.lit(kind).alias("edge_type"),
                F.concat(F.lit("note:"), pair[0]).alias("from_id"),
                F.concat(F.lit("note:"), pair[1]).alias("to_id"),
                F.when(F.col("k") % 6 != 0, F.col("k") % 100 / 100.0).alias("confidence"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge proposals, one per supplier: pairs of notes by similarity, some reviewed."""
    s = read(spark, sf_dir, "supplier")
    n = read(spark, sf_dir, "documents").count()
    k = F.col("s_suppkey")
    a, b = k * 13 % n, (k * 29 + 7) % n
    return s.filter(a != b).select(
        F.format_string("proposed_edge:%06d", k).alias("id"),
        F.concat(F.lit("note:"), F.least(a, b)).alias("from_id"),
        F.concat(F.lit("note:"), F.greatest(a, b)).alias("to_id"),
        F.lit("related_to").alias("edge_type"),
        (k % 50 / 100.0 + 0.5).alias("confidence"),
        F.when(k % 5 == 0, "manual").otherwise("gardener-similarity").alias("generator"),
        F.element_at(F.array(*[F.lit(x) for x in ("pending", "pending", "accepted", "rejected", "superseded")]), (k % 5 + 1).cast("int")).alias("status"),
        F.when(k % 10 == 2, F.concat(F.lit("related_to:"), k)).alias("resulting_edge_id"),
    )
