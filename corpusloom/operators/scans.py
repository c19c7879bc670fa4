"""Scans, lookups, pages and row predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.vectors import missing


def visible_notes(notes: DataFrame, sources: DataFrame) -> DataFrame:
    """Notes of no source, of no generation, or of their source's promoted generation."""
    promoted = sources.select(F.col("id").alias("__source"), F.col("successful_generation").alias("__promoted"))
    joined = notes.join(sent_if_small(promoted), F.col("source_id") == F.col("__source"), "left")
    seen = F.col("source_id").isNull() | F.col("source_generation").isNull() | (F.col("source_generation") == F.col("__promoted"))
    return joined.filter(seen).select(*notes.columns)


def writable_notes(notes: DataFrame, sources: DataFrame) -> DataFrame:
    """Visible notes, and those of a generation that is being imported."""
    state = sources.select(F.col("id").alias("__source"), F.col("successful_generation").alias("__promoted"), F.col("generation").alias("__next"), F.col("status").alias("__status"))
    joined = notes.join(state, F.col("source_id") == F.col("__source"), "left")
    generation = F.col("source_generation")
    seen = F.col("source_id").isNull() | generation.isNull() | (generation == F.col("__promoted")) | ((generation == F.col("__next")) & (F.col("__status") == "pending"))
    return joined.filter(seen).select(*notes.columns)


def visible_edges(edges: DataFrame, visible: DataFrame) -> DataFrame:
    """Edges with both ends visible."""
    ends = visible.select("id")
    return edges.join(ends.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ends.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


def by_id(rows: DataFrame, record: str) -> DataFrame:
    return rows.filter(F.col("id") == record).limit(1)


def source_by_key(sources: DataFrame, key: str) -> DataFrame:
    return sources.filter((F.col("id") == key) | (F.col("uri") == key)).limit(1)


def page(rows: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page in a stable order; the id decides last."""
    return rows.orderBy(*order, "id").offset(offset).limit(limit)


def keyset_page(rows: DataFrame, after: str | None, limit: int) -> DataFrame:
    return (rows if after is None else rows.filter(F.col("id") > after)).orderBy("id").limit(limit)


def without_vectors(rows: DataFrame) -> DataFrame:
    return rows.filter(missing(F.col("embedding")))


def source_chunks(notes: DataFrame, sources: DataFrame, source_id: str) -> DataFrame:
    """The chunks of a source's promoted generation."""
    one = notes.filter(F.col("source_id") == source_id)
    promoted = sources.filter(F.col("id") == source_id).select(F.col("id").alias("source_id"), F.col("successful_generation").alias("source_generation"))
    return one.join(promoted, ["source_id", "source_generation"], "left_semi").orderBy("chunk_ordinal", "created_at", "id")


def optional(rows: DataFrame, *conditions: Column | None) -> DataFrame:
    """Filters whose parameter was given."""
    for c in conditions:
        rows = rows if c is None else rows.filter(c)
    return rows


def since(column: str, start: str | None) -> Column | None:
    return None if start is None else F.col(column) >= F.lit(start).cast("timestamp")


def has_all_tags(tags: list[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(t) for t in tags]), F.col("tags"))) == 0


def confident(least: float) -> Column:
    """An unknown confidence counts as certain."""
    return F.coalesce("confidence", F.lit(1.0)) >= least


def recent(notes: DataFrame, limit: int, tags: list[str] | None = None, source_id: str | None = None) -> DataFrame:
    chosen = optional(notes, has_all_tags(tags) if tags else None, F.col("source_id") == source_id if source_id else None)
    return chosen.orderBy(F.desc("created_at"), "id").limit(limit)


def bad_vectors(rows: DataFrame, dimension: int) -> DataFrame:
    return rows.filter(F.col("embedding").isNull() | (F.size("embedding") != dimension))


def first_per(rows: DataFrame, keys: list[str], order: list, most: int, rank: str = "rank") -> DataFrame:
    """The first ``most`` rows of each group; Spark limits groups before it shuffles."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= most)


#: Rows of narrow tables that are sent to all tasks at most.
SENT_ROWS = 100_000


def sent_if_small(rows: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """A side of a join that goes to all tasks while its counted rows stay under the bound."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
