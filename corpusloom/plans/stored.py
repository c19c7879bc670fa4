"""Registered queries of what is kept in folders: text and vector indexes, runs that make vectors anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import inference, text_index, vector_index
from corpusloom.operators.importing import Library
from corpusloom.operators.reembedding import Reembedding
from corpusloom.plans import queries as q
from corpusloom.plans.registry import query
from corpusloom.sources import archive
from corpusloom.sources import tables as t
from corpusloom.sources.storage import Versions, scratch

BEST = "SELECT query_id, id, round(score, 6) AS score FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 10"


@query(f"WITH {q.ASKED}, {q.bm25_sql('visible', q.FIELDS)} {BEST}", "visible")
def indexed_notes(spark, d):
    """The ten best notes for each benchmark text, from a stored index."""
    index = text_index.TextIndex.create(spark, scratch(spark, "text-index"), q.visible(spark, d), list(q.FIELDS))
    return index.search(q.text_queries(spark, d), q.FIELDS, 10).select("query_id", "id", F.round("score", 6).alias("score"))


@query(
    f"""WITH later AS (SELECT id, title, CASE WHEN doc_id % 9 = 0 THEN title || ' ' || left(content, 200) ELSE content END AS content FROM visible WHERE doc_id % 13 <> 0),
    {q.ASKED}, {q.bm25_sql('later', q.FIELDS)} {BEST}""",
    "visible",
)
def indexed_after_changes(spark, d):
    """The same after every ninth note was changed, and every thirteenth removed: the counts follow, and old entries are dead."""
    notes = q.visible(spark, d)
    index = text_index.TextIndex.create(spark, scratch(spark, "text-index"), notes, list(q.FIELDS))
    changed = notes.filter("doc_id % 9 = 0").withColumn("content", F.concat_ws(" ", "title", F.left("content", F.lit(200))))
    index = index.put(changed).remove(notes.filter("doc_id % 13 = 0").select("id"))
    return index.search(q.text_queries(spark, d), q.FIELDS, 10).select("query_id", "id", F.round("score", 6).alias("score"))


@query(
    "SELECT q.id AS query_id, v.id, round(list_cosine_similarity(q.embedding, v.embedding), 6) AS similarity FROM vec q, vec v WHERE v.id <> q.id AND list_cosine_similarity(q.embedding, v.embedding) > 0.3 QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round(1 - list_cosine_similarity(q.embedding, v.embedding), 9), v.id) <= 5",
    "vec",
)
def similar_by_blocks(spark, d):
    """The five most similar vectors above 0.3 of every vector, by blocks round pivots."""
    v = t.vectors(spark, d).select("id", "embedding")
    near = vector_index.VectorIndex.build(v).near(v.withColumnRenamed("id", "query_id"), 5, exclude_self=True, least=0.3)
    return near.select("query_id", "id", F.round(1 - F.col("distance"), 6).alias("similarity"))


IDENTITY = {"operation": "embed", "provider": "test", "model": "lengths", "version": "2"}


def lengths(texts: list[str]) -> list[list[float]]:
    """Stands in for a model."""
    return [[float(len(x)), 1.0] for x in texts]


@query("SELECT id, CAST(length(coalesce(content, '')) AS DOUBLE) AS first FROM note", "note")
def remade_vectors(spark, d):
    """All vectors after a run that was stopped after two parts, and went on when every seventh text had changed."""
    items = t.notes(spark, d).select("id", F.col("content").alias("text"), "doc_id")
    before = items.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.lit("as it was")).otherwise(F.col("text")))
    run = Reembedding(spark, scratch(spark, "vectors-run"), IDENTITY, parts=4)
    run.run(lambda: before, lengths, most_parts=2)
    run.run(lambda: items, lengths)
    return run.current().select("id", F.get("embedding", F.lit(0)).cast("double").alias("first"))


@query("SELECT count(*) FILTER (length(coalesce(content, '')) % 17 <> 0) AS completed, count(*) FILTER (length(coalesce(content, '')) % 17 = 0) AS failed FROM note", "note")
def fallback_outcome(spark, d):
    """Items that fail by themselves, in batches that fail with them."""

    def refusing(texts: list[str]) -> list[list[float]]:
        if any(len(x) % 17 == 0 for x in texts):
            raise inference.ModelError("the model refuses this text", 400)
        return lengths(texts)

    items = t.notes(spark, d).select("id", F.coalesce("content", F.lit("")).alias("text"))
    return inference.outcome(inference.inferred(items, None, refusing, **IDENTITY)[0])


@query(
    """SELECT id AS uri, CASE WHEN CAST(substr(source, 4) AS BIGINT) % 3 = 0 THEN 2 ELSE 1 END AS generation, CASE WHEN CAST(substr(source, 4) AS BIGINT) % 3 = 0 THEN 2 ELSE 1 END AS successful_generation, 'ready' AS status, CAST(1 AS BIGINT) AS notes,
    source AS heading, (CASE WHEN CAST(substr(source, 4) AS BIGINT) % 3 = 0 THEN n ELSE seventh END) || ' texts' AS content
    FROM (SELECT source, 'fixture://' || source AS id, count(*) AS n, count(*) FILTER (doc_id % 7 = 0) AS seventh FROM documents GROUP BY source)"""
)
def imported_sources(spark, d):
    """Sources and their notes after two imports of a file for each, the second with changes in every third; a batch that comes again changes nothing."""
    docs = t.read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id") % 7 == 0).alias("seventh"))
    uri = F.concat(F.lit("fixture://"), "source").alias("uri")
    text = lambda n: F.concat(F.lit("# "), "source", F.lit("\n\n"), n.cast("string"), F.lit(" texts")).alias("content")
    third = F.substring("source", 4, 9).cast("long") % 3 == 0
    library = Library.open(spark, scratch(spark, "library"))
    library = library.put(docs.select(uri, text(F.col("seventh"))), "files", 0)
    library = library.put(docs.select(uri, text(F.when(third, F.col("n")).otherwise(F.col("seventh")))), "files", 1)
    library = library.put(docs.select(uri, text(F.lit(0))), "files", 1)
    notes = library.rows("notes").groupBy("uri").agg(F.count("*").alias("notes"), F.min("content").alias("content"), F.min(F.array_join("heading_path", "/")).alias("heading"))
    return library.rows("sources").join(notes, "uri").select("uri", F.col("generation").cast("int").alias("generation"), F.col("successful_generation").cast("int").alias("successful_generation"), "status", "notes", "heading", "content")


@query("SELECT id, title, content, array_to_string(tags, ',') AS tags, created_at FROM note", "note")
def archived_notes(spark, d):
    """Notes that went through an archive with their sources: written, checked while it is read, and restored as one version."""
    kept = {"source": t.sources(spark, d).select("id", "status"), "note": t.notes(spark, d).select("id", "title", "content", "tags", "source_id", "created_at")}
    path, target = scratch(spark, "archive"), scratch(spark, "restored")
    archive.export(kept, path)
    schemas = {"source": "id string, status string", "note": "id string, title string, content string, tags array<string>, source_id string, created_at timestamp"}
    version = archive.restored(spark, path, target, schemas, {"note": {"source_id": "source"}})
    notes = Versions(spark, target).read("note", version)
    return notes.select("id", "title", "content", F.array_join("tags", ",").alias("tags"), "created_at")
