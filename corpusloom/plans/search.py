"""The calls a user makes: search, augment, import, upkeep, statistics, evaluation."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corpusloom.operators import evaluation, gardener, graph, lifecycle, packing, retrieval, scans


@dataclass(frozen=True)
class Model:
    """The tables of a corpus; vectors have id and embedding."""

    notes: DataFrame
    sources: DataFrame
    vectors: DataFrame
    messages: DataFrame | None = None
    chats: DataFrame | None = None
    entities: DataFrame | None = None
    mentions: DataFrame | None = None
    edges: DataFrame | None = None
    proposals: DataFrame | None = None


@dataclass(frozen=True)
class Search:
    """Options of a search. ``use_graph`` is off, auto (only from entities) or on (also from hits)."""

    scope: str = "notes"
    limit: int = 10
    use_graph: str = "auto"
    since_days: int | None = None
    source_uri: str | None = None
    entity: str | None = None
    fusion: retrieval.Fusion = field(default_factory=retrieval.Fusion)
    expansion: graph.Expansion = field(default_factory=graph.Expansion)
    weights: dict = field(default_factory=lambda: {"note": 1.0, "message": 1.0, "summary": 1.0})
    note_fields: dict = field(default_factory=lambda: {"content": 0.9, "title": 0.1})


def eligible_notes(model: Model, how: Search, now: datetime) -> DataFrame:
    """Visible notes within the search's filters; filters come before any top-k."""
    notes = scans.visible_notes(model.notes, model.sources)
    start = (now - timedelta(days=how.since_days)).strftime("%Y-%m-%d %H:%M:%S") if how.since_days is not None else None
    notes = scans.optional(notes, scans.since("created_at", start))
    if how.source_uri:
        wanted = model.sources.filter(F.col("uri") == how.source_uri).select(F.col("id").alias("source_id"))
        notes = notes.join(wanted, "source_id", "left_semi")
    return notes


def merged_pool(limit: int) -> int:
    """Hits that the filters after a merge choose from."""
    return retrieval.pool_size(limit)


@dataclass
class Watch:
    """What the stages of a search let through: rows of each, counted while the search runs, and the time until its result was there.

    Counts come with the result in the same pass (``DataFrame.observe``), so they are there
    after the first action on it.
    """

    stages: list[tuple[str, Observation]] = field(default_factory=list)
    began: float = field(default_factory=time.monotonic)

    def stage(self, name: str, rows: DataFrame) -> DataFrame:
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        self.stages.append((name, seen))
        return rows.observe(seen, F.count(F.lit(1)).alias("rows"))

    def report(self, how: Search) -> str:
        """The pipeline as JSON: options, and each stage with its rows."""
        stages = [{"stage": name, "rows": rows_seen(seen)} for name, seen in self.stages]
        options = {"scope": how.scope, "limit": how.limit, "use_graph": how.use_graph, "fusion": how.fusion.strategy, "pool": merged_pool(how.limit)}
        return json.dumps({"options": options, "stages": stages, "milliseconds": round(1000 * (time.monotonic() - self.began))})


def rows_seen(seen: Observation) -> int:
    """The rows that passed; a stage that Spark left out of the plan, as it can't have any, has no counts."""
    try:
        return seen.get["rows"]
    except Py4JJavaError as e:
        if "AssertionError" not in str(e):
            raise
        return 0


def search(model: Model, queries: DataFrame, how: Search = Search(), now: datetime | None = None, watch: Watch | None = None) -> DataFrame:
    """Ranked hits of each query (query_id, query, embedding): query_id, id, hit_type, title, source_uri, score, final_rank and evidence.

    ``since_days`` counts back from ``now``, by default the time of the call. The entity
    filter chooses from the merged pool, which is ranked again and cut after it.
    """
    seen = watch.stage if watch else lambda _, rows: rows
    notes = eligible_notes(model, how, now or datetime.now(UTC).replace(tzinfo=None))
    pool = merged_pool(how.limit)
    parts: dict[str, DataFrame] = {}
    if how.scope in ("notes", "all"):
        parts["note"] = seen("notes", retrieval.hybrid(queries, notes, model.vectors, how.note_fields, pool, how.fusion))
    for kind, rows, fields in (("message", model.messages, {"content": 1.0}), ("summary", model.chats, {"summary": 0.7, "title": 0.3})):
        if rows is not None and how.scope in ("all", "messages" if kind == "message" else "summaries"):
            parts[kind] = seen("messages" if kind == "message" else "summaries", retrieval.hybrid(queries, rows, model.vectors, fields, pool, how.fusion))
    hits = seen("scoped", retrieval.scoped(parts, how.weights, pool))
    if how.use_graph != "off" and model.entities is not None and "note" in parts:
        edges = scans.visible_edges(model.edges, notes)
        anchors = hits.filter("hit_type = 'note'").select("query_id", F.col("id").alias("note_id")) if how.use_graph == "on" else None
        found = graph.graph_search(queries, model.entities, model.mentions, notes, edges, how.expansion, anchors)
        hits = graph.merge_hits(hits, seen("graph", found), how.weights["note"]).withColumn("hit_type", F.coalesce("hit_type", F.lit("note")))
    if how.entity:
        named = model.entities.filter(F.contains("canonical_name", F.lower(F.trim(F.lit(how.entity))))).select(F.col("id").alias("entity_id"))
        mentioned = model.mentions.join(named, "entity_id", "left_semi").select(F.col("note_id").alias("id")).distinct()
        hits = hits.filter("hit_type <> 'note'").unionByName(hits.filter("hit_type = 'note'").join(mentioned, "id", "left_semi"), allowMissingColumns=True)
    hits = seen("merged", hits)
    kind = F.array_position(F.array(*[F.lit(x) for x in retrieval.HIT_TYPES]), F.col("hit_type"))
    hits = scans.first_per(hits.drop("final_rank"), ["query_id"], [F.desc(F.round("score", 9)), F.asc_nulls_last("best_rank"), kind, "id"], how.limit, "final_rank")
    return seen("hits", retrieval.evidence(hits).join(payload(model), "id", "left"))


def payload(model: Model) -> DataFrame:
    """id, title, content and source_uri of notes, messages and summaries, shaped as hits."""
    uris = model.sources.select(F.col("id").alias("source_id"), F.col("uri").alias("source_uri"))
    out = model.notes.join(uris, "source_id", "left").select("id", "title", "content", "source_uri")
    if model.messages is not None:
        chats = model.chats.select(F.col("id").alias("conversation_id"), "source_uri") if model.chats is not None and "source_uri" in model.chats.columns else None
        rows = model.messages.join(chats, "conversation_id", "left") if chats is not None else model.messages.withColumn("source_uri", F.lit(None).cast("string"))
        out = out.unionByName(rows.select("id", retrieval.message_title(F.col("role"), F.col("message_index")).alias("title"), "content", "source_uri"))
    if model.chats is not None:
        uri = F.col("source_uri") if "source_uri" in model.chats.columns else F.lit(None).cast("string")
        out = out.unionByName(model.chats.select("id", retrieval.summary_title(F.col("title"), F.col("uuid")).alias("title"), F.col("summary").alias("content"), uri.alias("source_uri")))
    return out


def related(model: Model, hits: DataFrame) -> DataFrame:
    """Hits with their neighbours in six buckets."""
    notes = scans.visible_notes(model.notes, model.sources)
    return hits.join(graph.related_notes(scans.visible_edges(model.edges, notes)).withColumnRenamed("note_id", "id"), "id", "left")


def fetch_size(chunks: int) -> int:
    """Hits that a context of so many chunks is packed from."""
    return min(max(chunks * 4, 4), 200)


def graph_summary(found: DataFrame, kept: DataFrame) -> DataFrame:
    """Per query how many graph candidates there were, and how many of them are among the final hits."""
    chosen = kept.select("query_id", "id", F.lit(1).alias("__kept"))
    return found.join(chosen, ["query_id", "id"], "left").groupBy("query_id").agg(
        F.count("*").alias("candidates"), F.count("__kept").alias("selected"), (F.count("*") - F.count("__kept")).alias("dropped"), F.max("hops").alias("hops"), F.count_distinct("seed_id").alias("seeds")
    )


def augment(model: Model, queries: DataFrame, how: Search = Search(), budget: packing.Packing = packing.Packing(), now: datetime | None = None) -> DataFrame:
    """Packed context of each query; a zero budget makes no search."""
    rows = search(model, queries if budget.total > 0 else queries.filter("false"), replace(how, limit=fetch_size(budget.chunks)), now)
    rows = rows.join(queries.select("query_id", "query"), "query_id")
    return packing.pack(rows.select("query_id", "query", F.col("final_rank").alias("rank"), "id", "hit_type", "title", F.coalesce("content", F.lit("")).alias("content"), "score"), budget)


def context_states(queries: DataFrame, packed: DataFrame, budget: packing.Packing) -> DataFrame:
    """query_id, chunks and state of every query: packed, or why its context is empty (no budget, no hits, nothing fits)."""
    own = packed.groupBy("query_id").agg(F.count("*").alias("__hits"), F.count_if(F.col("reason") == "selected").alias("chunks"))
    rows = queries.select("query_id").join(own, "query_id", "left")
    chunks = F.coalesce("chunks", F.lit(0).cast("long"))
    state = F.when(F.lit(budget.total <= 0), "no budget").when(F.col("__hits").isNull(), "no hits").when(chunks == 0, "nothing fits").otherwise("packed")
    return rows.select("query_id", chunks.alias("chunks"), state.alias("state"))


def lone_suggestions(model: Model, least: float, most: int) -> tuple[DataFrame, DataFrame]:
    """Notes without edges, and the links suggested for them."""
    notes = scans.visible_notes(model.notes, model.sources)
    lone = graph.orphans(notes, scans.visible_edges(model.edges, notes)).select("id")
    vectors = model.vectors.join(notes.select("id"), "id", "left_semi")
    return lone, gardener.suggestions(vectors.join(lone, "id", "left_semi"), vectors, least, most=most)


def garden(model: Model, least: float = 0.7, most: int = 50) -> DataFrame:
    """The proposals after a scan for lone notes with similar ones."""
    return lifecycle.upsert_proposals(model.proposals, gardener.as_proposals(lone_suggestions(model, least, most)[1]))


def maintenance(model: Model, least: float = 0.7, most: int = 50) -> DataFrame:
    """One row: lone notes, links suggested for them, those that are new as proposals, and pending proposals after the scan."""
    lone, found = lone_suggestions(model, least, most)
    after = lifecycle.upsert_proposals(model.proposals, gardener.as_proposals(found))
    new = after.join(model.proposals.select("id"), "id", "left_anti")
    return (
        lone.agg(F.count("*").alias("orphans"))
        .join(found.agg(F.count("*").alias("suggestions")))
        .join(new.agg(F.count("*").alias("new_proposals")))
        .join(after.agg(F.count_if(F.col("status") == "pending").alias("pending_proposals")))
    )


@dataclass(frozen=True)
class Timed:
    """One case: its hits in order, the milliseconds until they were there, and the stages' rows as JSON."""

    case_id: str
    ids: list[str]
    milliseconds: float
    pipeline: str


def timed_cases(model: Model, cases: DataFrame, how: Search = Search(), now: datetime | None = None) -> list[Timed]:
    """Each case (query_id, query, embedding) as a search of its own, one after the other: a stated set of cases, as a user would ask them."""
    out = []
    for case in cases.orderBy("query_id").collect():
        watch = Watch()
        one = cases.sparkSession.createDataFrame([case], cases.schema)
        hits = sorted((r["final_rank"], r["id"]) for r in search(model, one, how, now, watch).select("final_rank", "id").collect())
        spent = 1000 * (time.monotonic() - watch.began)
        out.append(Timed(case["query_id"], [i for _, i in hits], spent, watch.report(how)))
    return out


def latency(timed: list[Timed]) -> dict[str, float]:
    """Mean, median, 95th percentile and maximum of the cases' milliseconds."""
    spent = sorted(t.milliseconds for t in timed)
    if not spent:
        return {"cases": 0}
    at = lambda share: spent[min(len(spent) - 1, max(0, -(-int(share * 100) * len(spent) // 100) - 1))]  # noqa: E731  nearest rank
    return {"cases": len(spent), "mean": sum(spent) / len(spent), "p50": at(0.5), "p95": at(0.95), "max": spent[-1]}


def evaluate(model: Model, cases: DataFrame, relevance: DataFrame, how: Search = Search(), k: int = 10) -> DataFrame:
    """Metrics of each case: ``cases`` has query_id, query and embedding; ``relevance`` case_id, id and grade."""
    hits = search(model, cases, how).select(F.col("query_id").alias("case_id"), "id", F.col("final_rank").alias("rank"))
    return evaluation.case_metrics(hits, relevance, k)
