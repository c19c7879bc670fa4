"""Registered queries over writes: edits, imports, proposals, jobs, archives."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import chat, evaluation, jobs, lifecycle, portable, scans
from corpusloom.plans.queries import visible
from corpusloom.plans.registry import query
from corpusloom.sources import tables as t

NOW = datetime(2024, 1, 2, 0, 0, 0)


def number(column: str):
    return F.regexp_extract(column, "[0-9]+", 0).cast("long")


# ---- notes


@query("""SELECT id, title, content AS search_content FROM note UNION ALL SELECT 'note:m' || conv_id || '-' || message_index, role, coalesce(CASE WHEN message_index % 2 = 0 THEN 'custom ' || message_index END, content) FROM msg""", "note", "msg")
def inserted_notes(spark, d):
    """Messages as new notes, half of them with search text of their own."""
    rows = t.notes(spark, d).withColumn("search_content", F.col("content"))
    new = t.messages(spark, d).select(
        F.concat(F.lit("note:m"), "conv_id", F.lit("-"), "message_index").alias("id"), F.col("role").alias("title"), "content",
        F.when(F.col("message_index") % 2 == 0, F.concat(F.lit("custom "), "message_index")).alias("search_content"),
    )
    return lifecycle.insert_notes(rows, new).select("id", "title", "search_content")


@query("SELECT id, CASE WHEN doc_id % 5 = 0 THEN 'new ' || doc_id ELSE title END AS title, CASE WHEN doc_id % 10 = 0 THEN reverse(content) ELSE content END AS content FROM note", "note")
def updated_notes(spark, d):
    rows = t.notes(spark, d)
    key = F.col("doc_id")
    changes = rows.filter(key % 5 == 0).select("id", F.concat(F.lit("new "), key).alias("title"), F.when(key % 10 == 0, F.reverse("content")).alias("content"))
    return lifecycle.updated(rows, changes, ["title", "content"]).select("id", "title", "content")


@query(r"""WITH r AS (SELECT id, doc_id, content, CASE doc_id % 3 WHEN 0 THEN title || chr(10) || chr(10) || content WHEN 1 THEN 'own words' END AS search, title FROM note),
    n AS (SELECT *, content || ' more' AS c2, CASE WHEN doc_id % 7 = 0 THEN 'asked' END AS s2 FROM r)
    SELECT id, CASE WHEN s2 IS NOT NULL AND s2 <> coalesce(search, title || chr(10) || chr(10) || content) THEN s2
        WHEN coalesce(search, title || chr(10) || chr(10) || content) = title || chr(10) || chr(10) || content THEN title || chr(10) || chr(10) || c2 ELSE search END AS search_content FROM n""", "note")
def edited_search_text(spark, d):
    """Search text after an edit: derived text follows, custom text stays, a given one wins."""
    rows = t.notes(spark, d)
    key, headings = F.col("doc_id"), F.array("title")
    old = {"content": F.col("content"), "headings": headings, "search": F.when(key % 3 == 0, tx.search_content(F.col("content"), headings)).when(key % 3 == 1, "own words")}
    new = {"content": F.concat("content", F.lit(" more")), "headings": headings, "search": F.when(key % 7 == 0, "asked")}
    return rows.select("id", tx.updated_search_content(old, new).alias("search_content"))


@query("SELECT id || '-detached' AS id, title, 'rewritten' AS content, 'a,b' AS tags, source_id, source_generation IS NULL AS free FROM (SELECT id, title, source_id, CAST(NULL AS BIGINT) AS source_generation FROM note WHERE doc_id % 25 = 3)", "note")
def detached_notes(spark, d):
    out = lifecycle.detached(t.notes(spark, d).filter("doc_id % 25 = 3"), "rewritten", tags=["a", "b"])
    return out.select("id", "title", "content", F.array_join("tags", ",").alias("tags"), "source_id", F.col("source_generation").isNull().alias("free"))


@query("SELECT id, len(embedding) AS size, round(embedding[1], 6) AS first FROM (SELECT n.id, CASE WHEN n.doc_id % 4 = 0 THEN [CAST(n.doc_id AS DOUBLE), 1.0] ELSE v.embedding END AS embedding FROM note n LEFT JOIN vec v ON v.id = n.id WHERE n.doc_id % 4 = 0 OR v.id IS NOT NULL UNION ALL SELECT id, embedding FROM vec WHERE id NOT IN (SELECT id FROM note))", "note", "vec")
def stored_vectors(spark, d):
    """Vectors after every fourth note got another one; those without a note stay as they are."""
    staged = t.notes(spark, d).filter("doc_id % 4 = 0").select("id", F.array(F.col("doc_id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    out = jobs.swapped(t.vectors(spark, d).select("id", "embedding"), staged)
    return out.select("id", F.size("embedding").cast("long").alias("size"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


ARRIVAL_SQL = """arrivals AS (SELECT 'note:' || (c_custkey % 50) AS note_id, lower('Name ' || (c_custkey % 40)) AS canonical_name, 'Name ' || (c_custkey % 40) AS name, 'concept' AS entity_type, 'alias' || (c_custkey % 7) AS alias, c_custkey AS seq FROM customer)"""


def arrivals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.concat(F.lit("Name "), k % 40)
    return t.read(spark, d, "customer").select(
        F.concat(F.lit("note:"), k % 50).alias("note_id"), F.lower(name).alias("canonical_name"), name.alias("name"), F.lit("concept").alias("entity_type"), F.array(F.concat(F.lit("alias"), k % 7)).alias("aliases"), k.alias("seq")
    )


def stored_entities(spark: SparkSession, d: str) -> DataFrame:
    return t.entities(spark, d).withColumn("entity_type", F.lit("location"))


@query(f"""WITH {ARRIVAL_SQL}, every AS (SELECT canonical_name, name, entity_type, -1 AS seq, unnest(aliases) AS alias FROM (SELECT *, 'location' AS entity_type FROM entity) UNION ALL SELECT canonical_name, name, entity_type, seq, alias FROM arrivals)
    SELECT canonical_name, arg_max(name, seq) AS name, arg_min(entity_type, seq) AS entity_type, array_to_string(list_sort(list(DISTINCT alias)), ',') AS aliases FROM every GROUP BY canonical_name""", "entity")
def batch_entities(spark, d):
    merged, _ = lifecycle.linked_entities(stored_entities(spark, d), t.mentions(spark, d), arrivals(spark, d))
    return merged.select("canonical_name", "name", "entity_type", F.array_join(F.array_sort("aliases"), ",").alias("aliases"))


@query(f"WITH {ARRIVAL_SQL} SELECT DISTINCT note_id, 'entity:' || canonical_name AS entity_id FROM arrivals")
def batch_links(spark, d):
    return lifecycle.linked_entities(stored_entities(spark, d), t.mentions(spark, d), arrivals(spark, d))[1]


@query("SELECT 'note:' || (CAST(substr(note_id, 6) AS BIGINT) + 1000000) AS note_id, entity_id FROM mention WHERE CAST(substr(note_id, 6) AS BIGINT) % 18 = 0", "mention")
def copied_mentions(spark, d):
    """Mentions of the exact ones among the successors."""
    successors = t.notes(spark, d).filter("doc_id % 9 = 0").select(F.col("id").alias("old_id"), F.concat(F.lit("note:"), F.col("doc_id") + 1000000).alias("new_id"), (F.col("doc_id") % 2 == 0).alias("exact_content"))
    return lifecycle.copied_mentions(t.mentions(spark, d), successors)


# ---- edges and proposals


@query("SELECT id, CASE WHEN status = 'accepted' AND resulting_edge_id IS NOT NULL THEN 'note:' || (CAST(substr(from_id, 6) AS BIGINT) + 7) ELSE from_id END AS from_id, CASE WHEN status = 'accepted' AND resulting_edge_id IS NOT NULL THEN 'related_to:new' ELSE resulting_edge_id END AS resulting_edge_id FROM proposal", "proposal")
def retargeted_proposals(spark, d):
    p = t.proposals(spark, d)
    moved = p.filter("resulting_edge_id is not null").select(F.col("id").alias("proposal_id"), F.concat(F.lit("note:"), number("from_id") + 7).alias("from_id"), "to_id", F.lit("related_to:new").alias("edge_id"))
    return lifecycle.retargeted(p, moved).select("id", "from_id", "resulting_edge_id")


@query("SELECT id, CASE WHEN status = 'pending' AND id IN ('proposed_edge:000000', 'proposed_edge:000001', 'proposed_edge:000002') THEN 'rejected' ELSE status END AS status, CASE WHEN status = 'pending' AND id IN ('proposed_edge:000000', 'proposed_edge:000001', 'proposed_edge:000002') THEN 'me' END AS reviewer FROM proposal", "proposal")
def rejected_proposals(spark, d):
    """Rejecting twice is rejecting once; reviewed ones stay."""
    ids = [f"proposed_edge:{i:06d}" for i in (0, 1, 2)]
    once = lifecycle.reviewed(t.proposals(spark, d), ids, "rejected", "me", "not alike")
    return lifecycle.reviewed(once, ids, "rejected", "you").select("id", "status", "reviewer")


@query("SELECT id, CASE WHEN status = 'pending' AND id IN ('proposed_edge:000005', 'proposed_edge:000006') THEN 'accepting' ELSE status END AS status FROM proposal", "proposal")
def claimed_proposals(spark, d):
    return lifecycle.reviewed(t.proposals(spark, d), ["proposed_edge:000005", "proposed_edge:000006"], "accepting", "worker").select("id", "status")


@query("SELECT id, CASE WHEN resulting_edge_id = 'related_to:12' THEN 'superseded' ELSE status END AS status FROM proposal", "proposal")
def proposals_after_undo(spark, d):
    return lifecycle.undone(t.edges(spark, d), t.proposals(spark, d), "related_to:12")[1].select("id", "status")


@query("SELECT id FROM edge WHERE id <> 'related_to:12'", "edge")
def edges_after_undo(spark, d):
    return lifecycle.undone(t.edges(spark, d), t.proposals(spark, d), "related_to:12")[0].select("id")


@query("SELECT id FROM edge WHERE id = 'related_to:8'", "edge")
def edge_to_undo(spark, d):
    return lifecycle.edge_exists(t.edges(spark, d), "related_to:8").select("id")


@query("SELECT from_id, to_id, 'related_to:' || sha256('related_to:' || least(from_id, to_id) || ':' || greatest(from_id, to_id)) AS resulting_edge_id FROM (SELECT *, from_id NOT IN (SELECT id FROM visible) OR to_id NOT IN (SELECT id FROM visible) AS stale FROM proposal) WHERE status = 'accepted' AND resulting_edge_id IS NULL AND generator = 'gardener-similarity' AND NOT stale AND NOT EXISTS (SELECT 1 FROM edge e WHERE e.edge_type = 'related_to' AND least(e.from_id, e.to_id) = least(proposal.from_id, proposal.to_id) AND greatest(e.from_id, e.to_id) = greatest(proposal.from_id, proposal.to_id))".replace("FROM proposal) WHERE", "FROM proposal) proposal WHERE"), "proposal", "visible", "edge")
def recovered_acceptances(spark, d):
    """Accepted proposals whose edge was never made get one."""
    p = t.proposals(spark, d).filter("status = 'accepted' and resulting_edge_id is null")
    return lifecycle.acceptance(p, visible(spark, d), t.edges(spark, d)).filter("status = 'accepted' and resulting_edge_id is not null").select("from_id", "to_id", "resulting_edge_id")


@query("""SELECT 'supports:m' || conv_id AS id, 'note:' || conv_id AS from_id, 'note:' || (conv_id + 1) AS to_id, least(greatest(CAST(conv_id AS DOUBLE) / 50.0, 0), 1) AS confidence FROM (SELECT DISTINCT conv_id FROM conversations)
    WHERE 'note:' || conv_id IN (SELECT id FROM visible) AND 'note:' || (conv_id + 1) IN (SELECT id FROM visible) AND NOT EXISTS (SELECT 1 FROM edge e WHERE e.edge_type = 'supports' AND e.from_id = 'note:' || conv_id AND e.to_id = 'note:' || (conv_id + 1))""", "visible", "edge")
def manual_edges(spark, d):
    k = F.col("conv_id")
    new = t.read(spark, d, "conversations").select("conv_id").distinct().select(F.concat(F.lit("supports:m"), k).alias("id"), F.lit("supports").alias("edge_type"), F.concat(F.lit("note:"), k).alias("from_id"), F.concat(F.lit("note:"), k + 1).alias("to_id"), (k / 50.0).alias("confidence"))
    return lifecycle.audited_edges(t.edges(spark, d), new, visible(spark, d)).select("id", "from_id", "to_id", "confidence")


# ---- imports


OUTCOME_SQL = """SELECT (SELECT count(*) FROM src WHERE NOT (status = 'ready' AND CAST(regexp_extract(uri, '[0-9]+$') AS BIGINT) % 3 = 0)) AS updated_sources, (SELECT count(*) FROM src WHERE status = 'ready' AND CAST(regexp_extract(uri, '[0-9]+$') AS BIGINT) % 3 = 0) AS unchanged_sources, CAST(1 AS BIGINT) AS created_sources,
    (SELECT count(*) FROM note) AS note_records, (SELECT count(*) FROM msg) AS message_records, (SELECT count(*) FROM note) + (SELECT count(*) FROM msg) AS records,
    (SELECT count(*) FROM note WHERE id IN (SELECT id FROM vec)) AS embedded, (SELECT count(*) FROM note WHERE id NOT IN (SELECT id FROM vec)) + (SELECT count(*) FROM msg) AS not_embedded, (SELECT count(*) FROM mention) AS mention_links"""


@query(OUTCOME_SQL, "src", "note", "msg", "vec", "mention")
def import_outcome(spark, d):
    now = t.sources(spark, d).withColumn("content_hash", F.lit("a"))
    third = F.regexp_extract("uri", "[0-9]+$", 0).cast("long") % 3 == 0
    incoming = now.select("uri", F.when(third, "a").otherwise("b").alias("content_hash")).unionByName(spark.createDataFrame([("fixture://new", "c")], "uri string, content_hash string"))
    held = t.vectors(spark, d).select("id", F.lit(True).alias("embedded"))
    created = t.notes(spark, d).select("id", F.lit("note").alias("kind")).join(held, "id", "left").unionByName(t.messages(spark, d).select("id", F.lit("message").alias("kind")), allowMissingColumns=True)
    links = t.mentions(spark, d).select(F.lit("mention").alias("kind"))
    out = lifecycle.import_outcome(lifecycle.begin_imports(now, incoming), created, links)
    return out.select("created_sources", "updated_sources", "unchanged_sources", "note_records", "message_records", "records", "embedded", "not_embedded", "mention_links")


@query("SELECT id FROM chat WHERE CAST(split_part(id, ':', 2) AS BIGINT) % 3 <> 0", "chat")
def chats_not_linked(spark, d):
    links = t.chats(spark, d).select(F.col("id").alias("conversation_id")).filter(number("conversation_id") % 3 == 0)
    return chat.not_linked(t.chats(spark, d), links).select("id")


@query("SELECT id AS conversation_id, 'Summary: ' || title AS title, '**Conversation:** ' || title || chr(10) || chr(10) || summary AS content, 'chat-export,summary' AS tags FROM chat WHERE summary IS NOT NULL AND summary <> ''", "chat")
def summary_notes(spark, d):
    return chat.summary_notes(t.chats(spark, d)).withColumn("tags", F.array_join("tags", ","))


BLOCKS = "array<struct<type:string,text:string,citations:array<string>>>"


def with_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Messages with structured blocks and files that follow from their numbers; every third has no text of its own."""
    m = t.messages(spark, d)
    i = F.col("message_index")
    kinds = F.array(*[F.lit(x) for x in ("text", "tool_use", "tool_result", "token_budget")])
    blocks = F.transform(F.sequence(F.lit(0), i % 4), lambda k: F.struct(F.element_at(kinds, (k + 1).cast("int")).alias("type"), F.when(k == 0, F.col("content")).alias("text"), F.array_repeat(F.lit("c"), k.cast("int")).alias("citations")))
    m = m.withColumns({"content_blocks": blocks.cast(BLOCKS), "files": F.array_repeat(F.lit("f"), (i % 2).cast("int"))})
    return m.withColumn("content", F.when(i % 3 == 0, F.lit(" ")).otherwise(F.col("content")))


@query("SELECT id, CAST(message_index % 4 + 1 AS INT) AS n_blocks, CAST(message_index % 4 AS INT) AS n_tools, CAST((message_index % 4) * (message_index % 4 + 1) / 2 AS INT) AS n_citations, CAST(message_index % 2 AS INT) AS n_files FROM msg", "msg")
def message_signals(spark, d):
    return chat.signals(with_blocks(spark, d)).select("id", "n_blocks", "n_tools", "n_citations", "n_files")


@query("SELECT id, CASE WHEN trim(content) = '' THEN '[empty message]' WHEN message_index % 3 = 0 THEN trim(content) ELSE content END AS text FROM msg", "msg")
def texts_to_embed(spark, d):
    """Messages without text are embedded by their blocks' text."""
    return with_blocks(spark, d).select("id", chat.text_to_embed(F.col("content"), F.col("content_blocks")).alias("text"))


@query("""WITH f AS (SELECT conversation_id, arg_min(content, message_index) FILTER (WHERE role = 'human') AS said FROM msg GROUP BY ALL)
    SELECT id, CASE WHEN c % 3 = 0 THEN title ELSE coalesce(nullif(substring(string_split(said, chr(10))[1], 1, 50), ''), 'Untitled Conversation') END AS title FROM (SELECT *, CAST(split_part(id, ':', 2) AS BIGINT) AS c FROM chat) JOIN f ON f.conversation_id = id""", "chat", "msg")
def display_titles(spark, d):
    first = t.messages(spark, d).groupBy("conversation_id").agg(F.min_by("content", F.when(F.col("role") == "human", F.col("message_index"))).alias("said"))
    rows = t.chats(spark, d).join(first.withColumnRenamed("conversation_id", "id"), "id")
    return rows.select("id", chat.display_title(F.when(number("id") % 3 == 0, F.col("title")), F.split_part(F.coalesce("said", F.lit("")), F.lit("\n"), F.lit(1))).alias("title"))


# ---- jobs


@query("SELECT id, CASE WHEN id = 'job:6' AND status IN ('pending', 'running') AND (lease_owner IS NULL OR lease_owner = 'worker-c' OR lease_expires_at <= TIMESTAMP '2024-01-02') THEN 'running' ELSE status END AS status, CASE WHEN id = 'job:6' AND status IN ('pending', 'running') AND (lease_owner IS NULL OR lease_owner = 'worker-c' OR lease_expires_at <= TIMESTAMP '2024-01-02') THEN 'worker-c' ELSE lease_owner END AS lease_owner FROM job", "job")
def claimed_job(spark, d):
    return jobs.claim(t.jobs(spark, d), "job:6", "worker-c", NOW).select("id", "status", "lease_owner")


@query("SELECT id FROM job WHERE lease_owner IS NULL OR lease_owner = 'worker-b' OR lease_expires_at <= TIMESTAMP '2024-01-02'", "job")
def claimable_jobs(spark, d):
    return t.jobs(spark, d).filter(jobs.claimable(NOW, "worker-b")).select("id")


@query("SELECT id, CASE WHEN id = 'job:0' AND status IN ('pending', 'running') THEN 'cancelled' WHEN id = 'job:2' AND status IN ('failed', 'cancelled') THEN 'pending' WHEN id = 'job:1' AND status = 'running' THEN 'completed' ELSE status END AS status FROM job", "job")
def job_transitions(spark, d):
    """A cancelled, a resumed and a finished job, and one that may not change."""
    out = t.jobs(spark, d)
    for job, action in (("job:0", "cancel"), ("job:2", "resume"), ("job:1", "finish"), ("job:4", "cancel")):
        out = jobs.transition(out, job, action)
    return out.select("id", "status")


def staged_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Vectors made for two of three notes, some for a text that has changed since; and the texts of now."""
    now = t.notes(spark, d).select("id", "doc_id", F.col("content").alias("text"))
    staged = now.filter("doc_id % 3 <> 0").select("id", F.when(F.col("doc_id") % 11 == 0, "old text").otherwise(F.col("text")).alias("text"))
    return staged, now.select("id", "text")


@query("SELECT id FROM note WHERE doc_id % 3 <> 0 AND (doc_id % 11 <> 0 OR content = 'old text')", "note")
def adoptable_vectors(spark, d):
    return jobs.adoptable(*staged_vectors(spark, d)).select("id")


@query("SELECT (SELECT count(*) FROM note) AS items, (SELECT count(*) FROM note WHERE doc_id % 3 <> 0 AND doc_id % 11 <> 0) AS fresh, (SELECT count(*) FROM note WHERE doc_id % 3 = 0) AS widened, false AS ready", "note")
def reindex_commit(spark, d):
    return jobs.commit_check(*staged_vectors(spark, d))


@query("SELECT id, CAST(CASE WHEN doc_id % 3 <> 0 AND doc_id % 11 <> 0 THEN -doc_id WHEN content IN (SELECT content FROM note WHERE doc_id % 2 = 0) THEN 1 ELSE 2 * length(content) END AS DOUBLE) AS first FROM note UNION ALL SELECT id, round(embedding[1], 6) FROM vec WHERE id NOT IN (SELECT id FROM note)", "note", "vec")
def reindexed_vectors(spark, d):
    """A run that adopts what was staged, finds texts of every second note in the cache and makes the rest."""
    notes = t.notes(spark, d)
    items = notes.select("id", F.col("content").alias("text"))
    staged, _ = staged_vectors(spark, d)
    staged = staged.withColumn("embedding", F.array((-number("id")).cast("float")))
    identity = {"operation": "embed", "provider": "test", "model": "fnv", "version": "1"}
    cache = notes.filter("doc_id % 2 = 0").select(jobs.cache_key(F.col("content"), **identity).alias("cache_key"), F.array(F.lit(1.0).cast("float")).alias("embedding")).dropDuplicates(["cache_key"])
    after, _, _, _ = jobs.reindexed(t.vectors(spark, d).select("id", "embedding"), items, staged, cache, lambda texts: [[2.0 * len(x)] for x in texts], **identity)
    return after.select("id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@query("SELECT (SELECT count(*) FROM note) AS items, (SELECT count(*) FROM note) AS fresh, CAST(0 AS BIGINT) AS widened, true AS ready", "note")
def reindex_report(spark, d):
    """The same run may be committed: all there, fresh, and nothing new since."""
    notes = t.notes(spark, d)
    staged = staged_vectors(spark, d)[0].withColumn("embedding", F.array(F.lit(0.0).cast("float")))
    cache = spark.createDataFrame([], "cache_key string, embedding array<float>")
    items = notes.select("id", F.col("content").alias("text"))
    return jobs.reindexed(t.vectors(spark, d).select("id", "embedding"), items, staged, cache, lambda texts: [[1.0] for _ in texts], operation="embed", provider="test", model="fnv", version="1")[3]


@query("SELECT id FROM note WHERE id NOT IN (SELECT note_id FROM mention) ORDER BY created_at, note.id LIMIT 30", "note", "mention")
def extraction_queue(spark, d):
    return jobs.to_extract(t.notes(spark, d), t.mentions(spark, d), limit=30).select("id")


@query("SELECT id FROM note WHERE id IN ('note:1', 'note:3', 'note:4')", "note")
def forced_extraction(spark, d):
    return jobs.to_extract(t.notes(spark, d), t.mentions(spark, d), ["note:1", "note:3", "note:4"], force=True).select("id")


# ---- archives and reports


@query("SELECT table_name, id FROM (SELECT 'note' AS table_name, id FROM note UNION ALL SELECT 'source', id FROM src) WHERE id > 'note:5' ORDER BY id LIMIT 100", "note", "src")
def archive_page(spark, d):
    lines = portable.archive_lines({"source": t.sources(spark, d), "note": t.notes(spark, d)})
    return scans.keyset_page(lines, "note:5", 100).select("table_name", "id")


@query("SELECT id, title, content, array_to_string(tags, ',') AS tags, created_at FROM note", "note")
def restored_notes(spark, d):
    """Notes through archive lines and back, with their types."""
    lines = portable.archive_lines({"source": t.sources(spark, d), "note": t.notes(spark, d).withColumn("api_key", F.lit("s"))})
    back = portable.restore(lines, "note", "id string, title string, content string, tags array<string>, created_at timestamp")
    return back.withColumn("tags", F.array_join("tags", ","))


@query("""WITH l AS (SELECT 'note' AS table_name, id FROM note UNION ALL SELECT 'note', id FROM note WHERE doc_id % 100 = 1 UNION ALL SELECT 'source', CASE WHEN id = 'source:src1' THEN 'wrong:src1' ELSE id END FROM src WHERE id <> 'source:src2' UNION ALL SELECT 'other', 'other:1')
    SELECT 'unknown table' AS problem, table_name, id FROM l WHERE table_name = 'other' UNION ALL SELECT 'wrong prefix', table_name, id FROM l WHERE NOT starts_with(id, table_name || ':') UNION ALL SELECT 'repeated id', table_name, id FROM l GROUP BY table_name, id HAVING count(*) > 1
    UNION ALL SELECT 'dangling reference', 'note', n.id FROM (SELECT id, source_id FROM note UNION ALL SELECT id, source_id FROM note WHERE doc_id % 100 = 1) n WHERE source_id NOT IN (SELECT id FROM l WHERE table_name = 'source')
    UNION ALL SELECT 'wrong count', table_name, NULL FROM l WHERE table_name <> 'source' GROUP BY table_name""", "note", "src")
def archive_problems(spark, d):
    """An archive with a repeated record, a wrong prefix, an unknown table and a source that is gone."""
    notes = t.notes(spark, d)
    sources = t.sources(spark, d).filter("id <> 'source:src2'").withColumn("id", F.when(F.col("id") == "source:src1", "wrong:src1").otherwise(F.col("id")))
    other = spark.createDataFrame([("other:1",)], "id string")
    lines = portable.archive_lines({"note": notes.unionByName(notes.filter("doc_id % 100 = 1")), "source": sources, "other": other})
    manifest = {"record_counts": {"note": 1, "source": sources.count()}}
    return portable.problems(lines, manifest, ["note", "source"], {"note": {"source_id": "source"}})


@query("""SELECT '{"schema_version":1,"command":"list","success":true,"data":{"id":"' || id || '","status":"' || status || '","generation":' || generation || '},"warnings":[],"errors":[]}' AS line FROM src""", "src")
def result_lines(spark, d):
    return portable.envelope(t.sources(spark, d).select("id", "status", "generation"), "list")


@query("SELECT id, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'https://x/' || doc_id END AS uri FROM note", "note")
def exported_addresses(spark, d):
    """Paths of this machine stay out of an archive."""
    k = F.col("doc_id")
    rows = t.notes(spark, d).select("id", F.when(k % 4 == 0, F.concat(F.lit("/home/"), k)).when(k % 4 == 2, F.concat(F.lit("file:///c/"), k)).otherwise(F.concat(F.lit("https://x/"), k)).alias("uri"), F.lit("hush").alias("password"))
    return portable.sanitized(rows)


# ---- evaluation


@query("SELECT 'case:' || (doc_id % 7) AS case_id, 'note:' || (doc_id % 50) AS id, max(doc_id % 4) AS grade FROM documents WHERE doc_id % 4 > 0 GROUP BY ALL")
def relevance_grades(spark, d):
    """The highest grade of what is given more than once, in any spelling; grade 0 is none."""
    k = F.col("doc_id")
    given = t.read(spark, d, "documents").select(F.concat(F.lit("case:"), k % 7).alias("case_id"), F.concat(F.when(k % 2 == 0, " NOTE:").otherwise("note:"), k % 50, F.lit(" ")).alias("id"), (k % 4).alias("grade"))
    return evaluation.relevance(given)


@query("""WITH r AS (SELECT 'case:' || (doc_id % 9) AS case_id, id, content AS text, 'fixture://' || (doc_id % 3) AS uri, doc_id FROM note), c AS (SELECT 'case:' || i AS case_id, i FROM (SELECT unnest(generate_series(0, 9)) AS i)),
    p AS (SELECT c.case_id, i, max(i % 3 = 0 AND (contains(lower(text), 'the') OR contains(lower(text), 'zzzz'))) AS expected, max((i % 4 = 1 AND r.id = 'note:' || i) OR (i % 2 = 1 AND contains(lower(text), 'idiot'))) AS forbidden,
        CASE WHEN count(r.id) > 0 THEN avg(CASE WHEN uri = 'fixture://1' THEN 1.0 ELSE 0.0 END) END AS provenance FROM c LEFT JOIN r ON r.case_id = c.case_id GROUP BY ALL)
    SELECT case_id, CASE WHEN i % 3 = 0 OR i % 4 = 1 OR i % 2 = 1 THEN (i % 3 <> 0 OR coalesce(expected, false)) AND (NOT (i % 4 = 1 OR i % 2 = 1) OR NOT coalesce(forbidden, false)) END AS passed, round(provenance, 6) AS provenance FROM p""", "note")
def case_checks(spark, d):
    """Cases with and without expectations; a case without results has no provenance."""
    k = F.col("doc_id")
    results = t.notes(spark, d).select(F.concat(F.lit("case:"), k % 9).alias("case_id"), "id", F.col("content").alias("text"), F.concat(F.lit("fixture://"), k % 3).alias("source_uri"))
    none = F.array().cast("array<string>")
    i = F.col("i")
    cases = spark.range(10).withColumnRenamed("id", "i").select(
        F.concat(F.lit("case:"), i).alias("case_id"), F.when(i % 3 == 0, F.array(F.lit("THE"), F.lit("zzzz"))).otherwise(none).alias("expected_contains"), F.when(i % 4 == 1, F.array(F.concat(F.lit("note:"), i))).otherwise(none).alias("forbidden_ids"),
        F.when(i % 2 == 1, F.array(F.lit("idiot"))).otherwise(none).alias("forbidden_contains"), F.array(F.lit("fixture://1")).alias("expected_source_uris"),
    )
    return evaluation.checks(results, cases).withColumn("provenance", F.round("provenance", 6))
