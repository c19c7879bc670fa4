"""Writes as new versions of tables: upserts, links, imports by generation, cascades, proposals.

A function takes the current tables and the change and returns the next version (or the
counts that a caller previews); nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import clamp01, content_hash, dedupe_key, edge_ends, heuristic_title

LINK_TYPES = ("supports", "contradicts", "related_to", "derived_from")
GENERATOR = "gardener-similarity"


def insert_notes(notes: DataFrame, new: DataFrame) -> DataFrame:
    """Append; search text defaults to content."""
    return notes.unionByName(new.withColumn("search_content", F.coalesce("search_content", "content")), allowMissingColumns=True)


def updated(rows: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """Set the given columns of rows by id; a null leaves the old value."""
    new = changes.select("id", *[F.col(c).alias(f"__{c}") for c in columns])
    joined = rows.join(new, "id", "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).select(*rows.columns)


def upsert(rows: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; ``order`` numbers arrivals and old rows come before new ones."""
    both = rows.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(key).orderBy(F.desc("__new"), F.desc(order))
    return both.withColumn("__at", F.row_number().over(last)).filter("__at = 1").drop("__at", "__new")


def merge_entities(arrivals: DataFrame) -> DataFrame:
    """Entities by canonical name: last name, first type, all aliases in order of arrival.

    ``arrivals``: canonical_name, name, entity_type, aliases, seq.
    """
    listed = F.transform(F.sort_array(F.collect_list(F.struct("seq", "aliases"))), lambda x: x["aliases"])
    return arrivals.groupBy("canonical_name").agg(
        F.max_by("name", "seq").alias("name"), F.min_by("entity_type", "seq").alias("entity_type"), F.array_distinct(F.flatten(F.array_compact(listed))).alias("aliases"), F.count("*").alias("arrivals")
    )


def insert_links(links: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` that aren't there yet, once each."""
    return new.dropDuplicates(keys).join(links.select(*keys), keys, "left_anti")


def replace_links(links: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All links of the keys in ``new`` give way to the new ones."""
    return links.join(new.select(key).distinct(), key, "left_anti").unionByName(new.dropDuplicates())


def audited_edges(edges: DataFrame, new: DataFrame, writable: DataFrame) -> DataFrame:
    """New edges as stored: ends in order, confidence within 0 and 1, no self-edges, no key twice, ends writable."""
    a, b = edge_ends(F.col("edge_type"), F.col("from_id"), F.col("to_id"))
    fresh = new.filter(F.col("from_id") != F.col("to_id")).withColumns({"__a": a, "__b": b, "confidence": clamp01(F.col("confidence"))})
    fresh = fresh.withColumns({"from_id": F.col("__a"), "to_id": F.col("__b")}).drop("__a", "__b")
    fresh = fresh.withColumn("dedupe_key", F.concat_ws(":", "edge_type", "from_id", "to_id"))
    ends = writable.select("id")
    for end in ("from_id", "to_id"):
        fresh = fresh.join(ends.withColumnRenamed("id", end), end, "left_semi")
    known = edges.select(dedupe_key(F.col("edge_type"), F.col("from_id"), F.col("to_id")).alias("dedupe_key"))
    return fresh.withColumn("__at", F.row_number().over(Window.partitionBy("dedupe_key").orderBy("id"))).filter("__at = 1").drop("__at").join(known, "dedupe_key", "left_anti")


def backfilled_keys(edges: DataFrame) -> DataFrame:
    """Old edges with their keys; of one key the lowest id stays."""
    a, b = edge_ends(F.col("edge_type"), F.col("from_id"), F.col("to_id"))
    keyed = edges.withColumns({"__a": a, "__b": b}).withColumns({"from_id": F.col("__a"), "to_id": F.col("__b")}).drop("__a", "__b")
    keyed = keyed.withColumn("dedupe_key", F.concat_ws(":", "edge_type", "from_id", "to_id"))
    return keyed.withColumn("__at", F.row_number().over(Window.partitionBy("dedupe_key").orderBy("id"))).filter("__at = 1").drop("__at")


def begin_imports(sources: DataFrame, incoming: DataFrame, force: bool = False) -> DataFrame:
    """What an import of each source does: created, unchanged or updated, and its generation.

    ``sources``: uri, content_hash, generation, status; ``incoming``: uri, content_hash.
    """
    new = incoming.select("uri", F.col("content_hash").alias("new_hash"))
    joined = new.join(sources.select("uri", "content_hash", "generation", "status"), "uri", "left")
    same = F.lit(not force) & (F.col("status") == "ready") & (F.col("content_hash") == F.col("new_hash"))
    action = F.when(F.col("generation").isNull(), "created").when(same, "unchanged").otherwise("updated")
    return joined.select(
        "uri", action.alias("action"), F.when(action == "unchanged", F.col("generation")).otherwise(F.coalesce("generation", F.lit(0)) + 1).cast("long").alias("generation"),
        F.when(action == "unchanged", F.col("status")).otherwise("pending").alias("status"),
    )


def import_outcome(actions: DataFrame, created: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """One row of sums over an import.

    ``actions`` as from ``begin_imports``; ``created`` has a row for each new record with
    its kind (note, message, conversation, entity) and whether it has a vector; ``links``
    a row for each new link with its kind.
    """
    of = lambda rows, column, names, end="": rows.agg(*[F.count_if(F.col(column) == n).alias(n + end) for n in names])
    out = of(actions, "action", ("created", "updated", "unchanged"), "_sources").join(of(created, "kind", ("note", "message", "conversation", "entity"), "_records"))
    out = out.join(created.agg(F.count("*").alias("records"), F.count_if(F.col("kind").isin("note", "message") & F.coalesce("embedded", F.lit(False))).alias("embedded"), F.count_if(F.col("kind").isin("note", "message") & ~F.coalesce("embedded", F.lit(False))).alias("not_embedded")))
    if links is not None:
        out = out.join(of(links, "kind", ("mention", "conversation", "message"), "_links"))
    return out


def linked_entities(entities: DataFrame, links: DataFrame, arrivals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities after a batch of arrivals (note_id and an entity's columns), and the links that are new.

    Entities are merged by canonical name; a note links to each of its entities once.
    """
    merged = merge_entities(entities.select("canonical_name", "name", "entity_type", "aliases", F.lit(-1).cast("long").alias("seq")).unionByName(arrivals.select("canonical_name", "name", "entity_type", "aliases", F.col("seq").cast("long").alias("seq"))))
    new = arrivals.select("note_id", F.concat(F.lit("entity:"), "canonical_name").alias("entity_id"))
    return merged, insert_links(links, new, ["note_id", "entity_id"])


def promoted(sources: DataFrame) -> DataFrame:
    """Pending generations become the successful ones."""
    pending = F.col("status") == "pending"
    return sources.withColumns({"successful_generation": F.when(pending, F.col("generation")).otherwise(F.col("successful_generation")), "status": F.when(pending, "ready").otherwise(F.col("status"))})


def failed(sources: DataFrame, notes: DataFrame, source_id: str) -> tuple[DataFrame, DataFrame]:
    """A failed import: the source is marked and its staged notes go."""
    mine = F.col("id") == source_id
    marked = sources.withColumn("status", F.when(mine, "failed").otherwise(F.col("status")))
    one = sources.filter(mine).select(F.col("id").alias("source_id"), F.col("generation").alias("source_generation"), "successful_generation").filter("source_generation <> successful_generation")
    return marked, notes.join(one.select("source_id", "source_generation"), ["source_id", "source_generation"], "left_anti")


def retired(notes: DataFrame, sources: DataFrame) -> DataFrame:
    """Notes of generations that aren't the promoted one: what a promotion removes."""
    now = sources.select(F.col("id").alias("source_id"), "successful_generation")
    return notes.join(now, "source_id").filter(F.col("source_generation").isNotNull() & (F.col("source_generation") != F.col("successful_generation"))).select(*notes.columns)


def remapped_edges(edges: DataFrame, successors: DataFrame) -> DataFrame:
    """Edges with ends moved to successor notes (old_id, new_id); those that would join a note to itself go."""
    a = successors.select(F.col("old_id").alias("from_id"), F.col("new_id").alias("__a"))
    b = successors.select(F.col("old_id").alias("to_id"), F.col("new_id").alias("__b"))
    moved = edges.join(a, "from_id", "left").join(b, "to_id", "left").filter("__a is not null or __b is not null")
    moved = moved.withColumns({"from_id": F.coalesce("__a", "from_id"), "to_id": F.coalesce("__b", "to_id")}).filter("from_id <> to_id")
    x, y = edge_ends(F.col("edge_type"), F.col("from_id"), F.col("to_id"))
    return moved.withColumns({"__x": x, "__y": y}).withColumns({"from_id": F.col("__x"), "to_id": F.col("__y")}).select(*edges.columns)


def copied_mentions(mentions: DataFrame, successors: DataFrame) -> DataFrame:
    """Mentions of exact successors."""
    exact = successors.filter("exact_content").select(F.col("old_id").alias("note_id"), "new_id")
    return mentions.join(exact, "note_id").select(F.col("new_id").alias("note_id"), "entity_id")


def cascade(doomed: DataFrame, edges: DataFrame, mentions: DataFrame, proposals: DataFrame) -> DataFrame:
    """One row of counts: what deleting the notes takes along; an edge inside the set counts once."""
    ids = doomed.select("id").distinct()

    def touching(rows: DataFrame) -> DataFrame:
        ends = rows.select(F.col("id").alias("row"), F.explode(F.array("from_id", "to_id")).alias("id"))
        return ends.join(ids, "id", "left_semi").select("row").distinct()

    parts = {
        "notes": ids,
        "edges": touching(edges),
        "mentions": mentions.join(ids.withColumnRenamed("id", "note_id"), "note_id", "left_semi"),
        "proposals": touching(proposals.filter(F.col("status").isin("pending", "accepting", "accepted"))),
    }
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count("*").alias(name))
        out = one if out is None else out.join(one)
    return out


def without_notes(doomed: DataFrame, notes: DataFrame, edges: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables after the cascade; entities stay."""
    ids = doomed.select("id").distinct()
    for end in ("from_id", "to_id"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_anti")
    return notes.join(ids, "id", "left_anti"), edges, mentions.join(ids.withColumnRenamed("id", "note_id"), "note_id", "left_anti")


def detached(note: DataFrame, content: str, title: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """A manual note from a source's note: the source stays its origin, its generation goes."""
    return note.withColumns({
        "id": F.concat("id", F.lit("-detached")),
        "source_generation": F.lit(None).cast("long"),
        "content": F.lit(content),
        "title": F.coalesce(F.lit(title), "title"),
        "tags": F.array(*[F.lit(t) for t in tags]) if tags is not None else F.col("tags"),
    })


def upsert_proposals(proposals: DataFrame, new: DataFrame) -> DataFrame:
    """Pending proposals take the new confidence and reason; reviewed ones stay; others are added."""
    keyed = new.withColumns({"dedupe_key": dedupe_key(F.col("edge_type"), F.col("from_id"), F.col("to_id")), "confidence": clamp01(F.col("confidence"))})
    keyed = keyed.withColumn("__at", F.row_number().over(Window.partitionBy("dedupe_key").orderBy(F.desc("confidence"), "id"))).filter("__at = 1")
    old = proposals.withColumn("dedupe_key", dedupe_key(F.col("edge_type"), F.col("from_id"), F.col("to_id")))
    fresh = keyed.select("dedupe_key", F.col("confidence").alias("__confidence"))
    pending = (F.col("status") == "pending") & F.col("__confidence").isNotNull()
    kept = old.join(fresh, "dedupe_key", "left").withColumn("confidence", F.when(pending, F.col("__confidence")).otherwise(F.col("confidence"))).drop("__confidence")
    added = keyed.join(old.select("dedupe_key"), "dedupe_key", "left_anti").withColumn("status", F.lit("pending")).drop("__at")
    return kept.unionByName(added, allowMissingColumns=True)


def acceptance(proposals: DataFrame, visible: DataFrame, edges: DataFrame, least: float = 0.0) -> DataFrame:
    """The state of each proposal after bulk acceptance.

    Eligible are similarity proposals for related_to that are pending, being accepted, or
    accepted without an edge, at the confidence or above. One whose note went, or whose
    edge is there by itself, is superseded.
    """
    eligible = (
        (F.col("edge_type") == "related_to")
        & (F.col("generator") == GENERATOR)
        & (F.col("confidence") >= least)
        & (F.col("status").isin("pending", "accepting") | ((F.col("status") == "accepted") & F.col("resulting_edge_id").isNull()))
    )
    key = dedupe_key(F.col("edge_type"), F.col("from_id"), F.col("to_id"))
    there = edges.select(key.alias("dedupe_key"), F.col("id").alias("edge_id")).groupBy("dedupe_key").agg(F.min("edge_id").alias("edge_id"))
    ends = visible.select("id")
    state = proposals.withColumn("dedupe_key", key).join(there, "dedupe_key", "left")
    for end in ("from_id", "to_id"):
        state = state.join(ends.select(F.col("id").alias(end), F.lit(True).alias(f"__{end}")), end, "left")
    stale = F.col("__from_id").isNull() | F.col("__to_id").isNull()
    next_status = F.when(~eligible, F.col("status")).when(stale | F.col("edge_id").isNotNull(), "superseded").otherwise("accepted")
    why = F.when(eligible & stale, "endpoint is gone").when(eligible & F.col("edge_id").isNotNull(), "edge is already there")
    return state.select("id", "dedupe_key", "from_id", "to_id", next_status.alias("status"), why.alias("supersession_reason"), F.when(eligible & (next_status == "accepted"), F.concat(F.lit("related_to:"), F.sha2("dedupe_key", 256))).otherwise(F.col("resulting_edge_id")).alias("resulting_edge_id"))


def reviewed(proposals: DataFrame, ids: list[str], status: str, reviewer: str, reason: str | None = None) -> DataFrame:
    """Compare-and-set of pending proposals (accepting or rejected); others stay, so it can be repeated."""
    hit = F.col("id").isin(ids) & (F.col("status") == "pending")
    old = lambda c: F.col(c) if c in proposals.columns else F.lit(None).cast("string")
    return proposals.withColumns({"reviewer": F.when(hit, reviewer).otherwise(old("reviewer")), "action_reason": F.when(hit, reason).otherwise(old("action_reason")), "status": F.when(hit, status).otherwise(F.col("status"))})


def undone(edges: DataFrame, proposals: DataFrame, edge_id: str) -> tuple[DataFrame, DataFrame]:
    """Remove an edge; the proposal that made it is superseded."""
    hit = F.col("resulting_edge_id") == edge_id
    return edges.filter(F.col("id") != edge_id), proposals.withColumn("status", F.when(hit, "superseded").otherwise(F.col("status")))


def superseded_by_removal(proposals: DataFrame, doomed: DataFrame, pending_only: bool = False) -> DataFrame:
    """Proposals that touch removed notes are superseded."""
    ids = doomed.select("id").distinct()
    touched = proposals.select("id", F.explode(F.array("from_id", "to_id")).alias("note")).join(ids.withColumnRenamed("id", "note"), "note", "left_semi").select("id").distinct()
    mutable = F.col("status").isin(["pending"] if pending_only else ["pending", "accepting", "accepted"])
    return proposals.join(touched.withColumn("__hit", F.lit(True)), "id", "left").withColumn("status", F.when(F.col("__hit") & mutable, "superseded").otherwise(F.col("status"))).drop("__hit")


def retargeted(proposals: DataFrame, moved: DataFrame) -> DataFrame:
    """Accepted proposals follow their edge: moved has proposal_id, from_id, to_id, edge_id."""
    new = moved.select(F.col("proposal_id").alias("id"), F.col("from_id").alias("__f"), F.col("to_id").alias("__t"), F.col("edge_id").alias("__e"))
    hit = (F.col("status") == "accepted") & F.col("__e").isNotNull()
    joined = proposals.join(new, "id", "left")
    return joined.withColumns({c: F.when(hit, F.col(n)).otherwise(F.col(c)) for c, n in (("from_id", "__f"), ("to_id", "__t"), ("resulting_edge_id", "__e"))}).select(*proposals.columns)


def edge_exists(edges: DataFrame, edge_id: str) -> DataFrame:
    return edges.filter((F.col("id") == edge_id) & F.col("edge_type").isin(*LINK_TYPES)).limit(1)


def merged_objects(a: Column, b: Column) -> Column:
    """Maps merged, the second one's values last."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(a), lambda e: ~F.map_contains_key(b, e["key"])), F.map_entries(b)))


def manual_notes(texts: DataFrame) -> DataFrame:
    """Notes from plain texts (id, content): title from the first line, no source generation."""
    return texts.select(
        F.concat(F.lit("note:"), "id").alias("id"), heuristic_title(F.col("content")).alias("title"), "content", F.col("content").alias("search_content"),
        F.concat(F.lit("source:"), "id").alias("source_id"), F.lit(None).cast("long").alias("source_generation"), content_hash(F.col("content")).alias("content_hash"),
    )
