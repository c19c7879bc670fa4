"""Counts over the model: the snapshot, integrity, and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table; hidden generations count, too."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count("*").alias(name))
        out = one if out is None else out.join(one)
    return out


def snapshot(notes: DataFrame, entities: DataFrame, sources: DataFrame, chats: DataFrame, messages: DataFrame, edges: DataFrame, mentions: DataFrame, proposals: DataFrame) -> DataFrame:
    """Sizes of all tables; derived_from doesn't count as an edge."""
    return counts({"note_count": notes, "entity_count": entities, "source_count": sources, "conversation_count": chats, "message_count": messages,
                   "edge_count": edges.filter("edge_type <> 'derived_from'"), "mention_count": mentions, "proposal_count": proposals})


def missing_vectors(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("embedding").isNull() | (F.size("embedding") == 0)).alias("missing"))


def edges_touching(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """How many edges touch the notes; one inside the set counts once."""
    ends = edges.select(F.col("id").alias("edge"), F.explode(F.array("from_id", "to_id")).alias("id"))
    return ends.join(notes.select("id"), "id", "left_semi").agg(F.count_distinct("edge").alias("edges"))


def anchor_counts(chunks: DataFrame) -> DataFrame:
    """How often each (source, headings, content) comes: anchors that come once align surely."""
    return chunks.groupBy("source_id", "anchor").agg(F.count("*").alias("times"))


def reindex_preview(notes: DataFrame) -> DataFrame:
    """Items, characters and a fingerprint per item, per source."""
    return notes.groupBy("source_id").agg(F.count("*").alias("items"), F.sum(F.char_length("content")).alias("characters"), F.count_distinct(F.sha2("content", 256)).alias("fingerprints"))


def doctor(notes: DataFrame, visible: DataFrame, edges: DataFrame, mentions: DataFrame, entities: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """check, problems: integrity of the tables, one row per check."""
    ids = notes.select("id")
    checks = {
        "repeated note ids": notes.groupBy("id").count().filter("count > 1"),
        "vectors of another size": vectors.filter(F.size("embedding") != dimension),
        "vectors without a note": vectors.join(ids, "id", "left_anti"),
        "edges from nowhere": edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_anti"),
        "edges to nowhere": edges.join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_anti"),
        "edges to themselves": edges.filter("from_id = to_id"),
        "mentions of unknown entities": mentions.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_anti"),
        "repeated entity names": entities.groupBy("canonical_name").count().filter("count > 1"),
        "hidden notes": notes.join(visible.select("id"), "id", "left_anti"),
    }
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.lit(name).alias("check"), F.count("*").alias("problems"))
        out = one if out is None else out.unionByName(one)
    return out
