"""The registered queries over the supplied tables, and their SQL for another engine.

Each entry is a plan over whole tables. A limit stands only where a page, a top-k or a
pool is what the operator is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import chat, chunking, evaluation, gardener, graph, jobs, lifecycle, packing, portable, retrieval, scans, statistics
from corpusloom.plans.registry import query
from corpusloom.sources import tables as t

LETTERS = r"(\p{L}+|\p{N}+)"
FIELDS = {"content": 0.9, "title": 0.1}


def visible(spark: SparkSession, d: str) -> DataFrame:
    return scans.visible_notes(t.notes(spark, d), t.sources(spark, d))


# ---- scans, pages, predicates


@query("SELECT id, title, source_id FROM note WHERE id = 'note:5'", "note")
def point_lookup(spark, d):
    return scans.by_id(t.notes(spark, d), "note:5").select("id", "title", "source_id")


@query("SELECT id, title FROM visible WHERE id = 'note:8'", "visible")
def visible_point_lookup(spark, d):
    return scans.by_id(visible(spark, d), "note:8").select("id", "title")


@query("SELECT id, uri, status FROM src WHERE uri = 'fixture://src3' OR id = 'fixture://src3'", "src")
def source_lookup(spark, d):
    return scans.source_by_key(t.sources(spark, d), "fixture://src3").select("id", "uri", "status")


@query("SELECT id, uri, generation, successful_generation, status, created_at FROM src", "src")
def list_sources(spark, d):
    return t.sources(spark, d).orderBy("uri", "created_at", "id").select("id", "uri", "generation", "successful_generation", "status", "created_at")


@query("SELECT id, created_at FROM note ORDER BY created_at, note.id LIMIT 50 OFFSET 100", "note")
def notes_page(spark, d):
    return scans.page(t.notes(spark, d), ["created_at"], 50, 100).select("id", "created_at")


@query("SELECT n.id, n.created_at FROM note n LEFT JOIN vec v ON v.id = n.id WHERE v.embedding IS NULL OR len(v.embedding) = 0", "note", "vec")
def notes_missing_vectors(spark, d):
    return scans.without_vectors(t.notes_with_vectors(spark, d)).select("id", "created_at")


@query("SELECT n.id, n.chunk_ordinal FROM note n JOIN src s ON s.id = n.source_id AND s.successful_generation = n.source_generation WHERE n.source_id = 'source:src1'", "note", "src")
def source_chunks(spark, d):
    return scans.source_chunks(t.notes(spark, d), t.sources(spark, d), "source:src1").select("id", "chunk_ordinal")


@query("SELECT id, round(confidence, 6) AS confidence FROM proposal WHERE status = 'pending' AND generator = 'gardener-similarity' AND confidence >= 0.6 AND id > 'proposed_edge:000010' ORDER BY id LIMIT 20", "proposal")
def proposals_keyset_page(spark, d):
    eligible = t.proposals(spark, d).filter("status = 'pending' and generator = 'gardener-similarity' and confidence >= 0.6")
    return scans.keyset_page(eligible, "proposed_edge:000010", 20).select("id", F.round("confidence", 6).alias("confidence"))


@query("SELECT id FROM visible", "visible")
def visible_notes(spark, d):
    return visible(spark, d).select("id")


@query("SELECT id, edge_type FROM visible_edge", "visible_edge")
def visible_edges(spark, d):
    return scans.visible_edges(t.edges(spark, d), visible(spark, d)).select("id", "edge_type")


@query("""SELECT n.id FROM note n LEFT JOIN src s ON s.id = n.source_id WHERE n.source_id IS NULL OR n.source_generation IS NULL
    OR n.source_generation = s.successful_generation OR (n.source_generation = s.generation AND s.status = 'pending')""", "note", "src")
def writable_notes(spark, d):
    return scans.writable_notes(t.notes(spark, d), t.sources(spark, d)).select("id")


@query("SELECT id, source_id FROM visible WHERE created_at >= TIMESTAMP '2024-01-10' AND list_contains(tags, 'en') AND source_id IN (SELECT id FROM src WHERE uri = 'fixture://src2')", "visible", "src")
def filtered_notes(spark, d):
    wanted = t.sources(spark, d).filter("uri = 'fixture://src2'").select(F.col("id").alias("source_id"))
    chosen = scans.optional(visible(spark, d), scans.since("created_at", "2024-01-10"), scans.has_all_tags(["en"]), None)
    return chosen.join(wanted, "source_id", "left_semi").select("id", "source_id")


@query("SELECT id, created_at FROM note WHERE list_contains(tags, 'fr') ORDER BY created_at DESC, note.id LIMIT 25", "note")
def list_recent(spark, d):
    return scans.recent(t.notes(spark, d), 25, ["fr"]).select("id", "created_at")


@query("SELECT id, edge_type, confidence FROM edge WHERE coalesce(confidence, 1.0) >= 0.5", "edge")
def confident_edges(spark, d):
    return t.edges(spark, d).filter(scans.confident(0.5)).select("id", "edge_type", "confidence")


@query("SELECT id, edge_type FROM edge QUALIFY row_number() OVER (PARTITION BY edge_type ORDER BY id) <= 15", "edge")
def edges_per_type(spark, d):
    return graph.edges_per_type(t.edges(spark, d), 15).select("id", "edge_type")


@query("SELECT DISTINCT note_id AS id FROM mention WHERE entity_id IN (SELECT id FROM entity WHERE contains(canonical_name, 'nation_1')) AND note_id IN (SELECT id FROM visible)", "mention", "entity", "visible")
def notes_by_entity_name(spark, d):
    named = t.entities(spark, d).filter(F.contains("canonical_name", tx.canonicalize(F.lit("Nation_1 ")))).select(F.col("id").alias("entity_id"))
    hit = t.mentions(spark, d).join(named, "entity_id", "left_semi").select(F.col("note_id").alias("id"))
    return visible(spark, d).join(hit, "id", "left_semi").select("id")


@query("SELECT count(*) FILTER (WHERE v.embedding IS NULL) AS missing, count(*) FILTER (WHERE v.embedding IS NOT NULL AND len(v.embedding) <> 64) AS wrong_size FROM note n LEFT JOIN vec v ON v.id = n.id", "note", "vec")
def vector_integrity(spark, d):
    bad = scans.bad_vectors(t.notes_with_vectors(spark, d), 64)
    return bad.agg(F.count_if(F.col("embedding").isNull()).alias("missing"), F.count_if(F.col("embedding").isNotNull()).alias("wrong_size"))


# ---- joins and aggregates


@query("SELECT id FROM visible WHERE id NOT IN (SELECT from_id FROM visible_edge WHERE edge_type <> 'derived_from' UNION ALL SELECT to_id FROM visible_edge WHERE edge_type <> 'derived_from')", "visible", "visible_edge")
def orphan_notes(spark, d):
    v = visible(spark, d)
    return graph.orphans(v, scans.visible_edges(t.edges(spark, d), v)).select("id")


@query("SELECT id FROM note WHERE id NOT IN (SELECT note_id FROM mention)", "note", "mention")
def notes_without_entities(spark, d):
    return t.notes(spark, d).join(t.mentions(spark, d).select(F.col("note_id").alias("id")), "id", "left_anti").select("id")


@query("""WITH ends AS (SELECT from_id AS note_id, to_id AS other, edge_type || ':out' AS b FROM visible_edge UNION ALL SELECT to_id, from_id, edge_type || ':in' FROM visible_edge)
    SELECT note_id, count(DISTINCT other) FILTER (WHERE b = 'supports:out') AS supporting, count(DISTINCT other) FILTER (WHERE b = 'supports:in') AS supported_by,
    count(DISTINCT other) FILTER (WHERE b = 'contradicts:out') AS contradicting, count(DISTINCT other) FILTER (WHERE b = 'contradicts:in') AS contradicted_by,
    count(DISTINCT other) FILTER (WHERE b = 'related_to:out') AS related, count(DISTINCT other) FILTER (WHERE b = 'related_to:in') AS related_from
    FROM ends WHERE b NOT LIKE 'derived_from%' GROUP BY note_id""", "visible_edge")
def related_note_counts(spark, d):
    related = graph.related_notes(scans.visible_edges(t.edges(spark, d), visible(spark, d)))
    return related.select("note_id", *[F.size(c).cast("long").alias(c) for c in graph.BUCKETS.values()])


@query("SELECT m.note_id, count(*) AS entities, min(e.canonical_name) AS first_entity FROM mention m JOIN entity e ON e.id = m.entity_id GROUP BY m.note_id", "mention", "entity")
def entities_of_notes(spark, d):
    e = t.entities(spark, d).select(F.col("id").alias("entity_id"), "canonical_name")
    return t.mentions(spark, d).join(e, "entity_id").groupBy("note_id").agg(F.count("*").alias("entities"), F.min("canonical_name").alias("first_entity"))


@query("SELECT (SELECT count(*) FROM note) AS note_count, (SELECT count(*) FROM entity) AS entity_count, (SELECT count(*) FROM src) AS source_count, (SELECT count(*) FROM chat) AS conversation_count, (SELECT count(*) FROM msg) AS message_count, (SELECT count(*) FROM edge WHERE edge_type <> 'derived_from') AS edge_count, (SELECT count(*) FROM mention) AS mention_count, (SELECT count(*) FROM proposal) AS proposal_count", "note", "entity", "src", "chat", "edge", "mention", "proposal")
def stats_snapshot(spark, d):
    return statistics.snapshot(*(f(spark, d) for f in (t.notes, t.entities, t.sources, t.chats, t.messages, t.edges, t.mentions, t.proposals)))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE v.embedding IS NULL OR len(v.embedding) = 0) AS missing FROM note n LEFT JOIN vec v ON v.id = n.id", "note", "vec")
def missing_vector_count(spark, d):
    return statistics.missing_vectors(t.notes_with_vectors(spark, d))


@query("SELECT count(DISTINCT id) AS edges FROM edge WHERE from_id IN (SELECT id FROM note WHERE source_id = 'source:src0') OR to_id IN (SELECT id FROM note WHERE source_id = 'source:src0')", "edge", "note")
def edges_touching_source(spark, d):
    return statistics.edges_touching(t.edges(spark, d), t.notes(spark, d).filter("source_id = 'source:src0'"))


@query("""WITH gone AS (SELECT id FROM note WHERE source_id = 'source:src4') SELECT (SELECT count(*) FROM gone) AS notes,
    (SELECT count(*) FROM edge WHERE from_id IN (SELECT id FROM gone) OR to_id IN (SELECT id FROM gone)) AS edges,
    (SELECT count(*) FROM mention WHERE note_id IN (SELECT id FROM gone)) AS mentions,
    (SELECT count(*) FROM proposal WHERE status IN ('pending', 'accepting', 'accepted') AND (from_id IN (SELECT id FROM gone) OR to_id IN (SELECT id FROM gone))) AS proposals""", "note", "edge", "mention", "proposal")
def cascade_summary(spark, d):
    return lifecycle.cascade(t.notes(spark, d).filter("source_id = 'source:src4'"), t.edges(spark, d), t.mentions(spark, d), t.proposals(spark, d))


@query("SELECT note_id, array_to_string(list_sort(list(DISTINCT entity_id)), ',') AS origins FROM mention GROUP BY note_id", "mention")
def provenance_lists(spark, d):
    links = t.mentions(spark, d).withColumnRenamed("entity_id", "origin_id")
    return graph.provenance(links).select("note_id", F.array_join("origins", ",").alias("origins"))


@query("SELECT source_id, sha256(content) AS anchor, count(*) AS times FROM note GROUP BY ALL", "note")
def anchor_multiplicity(spark, d):
    return statistics.anchor_counts(t.notes(spark, d).select("source_id", F.sha2("content", 256).alias("anchor")))


@query("SELECT source_id, count(*) AS items, CAST(sum(length(content)) AS BIGINT) AS characters, count(DISTINCT sha256(content)) AS fingerprints FROM note GROUP BY source_id", "note")
def reindex_preview(spark, d):
    return statistics.reindex_preview(t.notes(spark, d))


# ---- scalars


@query(r"""SELECT id, 'sha256:' || sha256(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS content_hash,
    CASE WHEN length(content) > 200 THEN substring(content, 1, 200) || chr(10) || chr(10) || '[truncated]' ELSE content END AS extract,
    regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM note""", "note")
def text_scalars(spark, d):
    return t.notes(spark, d).select("id", tx.content_hash(F.col("content")).alias("content_hash"), tx.truncate_for_extraction(F.col("content"), 200).alias("extract"), tx.slugify(F.col("title")).alias("slug"))


@query(r"SELECT id, trim(regexp_replace(lower(name), '\s+', ' ', 'g')) AS canonical, trim(regexp_replace(trim(regexp_replace(lower(aliases[1]), '\s+', ' ', 'g')), '[^\p{L}\p{N}]+', ' ', 'g')) AS lexical FROM entity", "entity")
def canonical_entities(spark, d):
    return t.entities(spark, d).select("id", tx.canonicalize(F.col("name")).alias("canonical"), tx.lexical(F.element_at("aliases", 1)).alias("lexical"))


@query("SELECT id, edge_type || ':' || from_id || ':' || to_id AS dedupe_key, least(greatest(coalesce(confidence, 1.0) * 1.5, 0.0), 1.0) AS clamped FROM (SELECT id, edge_type, confidence, CASE WHEN edge_type = 'related_to' THEN least(from_id, to_id) ELSE from_id END AS from_id, CASE WHEN edge_type = 'related_to' THEN greatest(from_id, to_id) ELSE to_id END AS to_id FROM edge)", "edge")
def edge_keys(spark, d):
    return t.edges(spark, d).select("id", tx.dedupe_key(F.col("edge_type"), F.col("from_id"), F.col("to_id")).alias("dedupe_key"), tx.clamp01(F.coalesce("confidence", F.lit(1.0)) * 1.5).alias("clamped"))


# ---- retrieval


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth vector is a query."""
    return t.vectors(spark, d).filter(F.regexp_extract("id", "[0-9]+", 0).cast("long") % 20 == 0).select(F.col("id").alias("query_id"), "embedding")


def text_queries(spark: SparkSession, d: str) -> DataFrame:
    """The whole text of each benchmark item."""
    return t.read(spark, d, "benchmark").select(F.concat(F.lit("item:"), "item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))


def both_queries(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts with the vector of the same number, where there is one."""
    v = t.vectors(spark, d).select(F.concat(F.lit("item:"), F.regexp_extract("id", "[0-9]+", 0)).alias("query_id"), "embedding")
    return text_queries(spark, d).join(v, "query_id", "left")


VECTOR_QUERY = "vq AS (SELECT id AS query_id, embedding FROM vec WHERE CAST(substr(id, 6) AS BIGINT) % 20 = 0)"
TEXT_QUERY = "tq AS (SELECT 'item:' || item_id AS query_id, coalesce(text, '') AS query FROM benchmark)"
KNN_SQL = f"""{VECTOR_QUERY}, sims AS (SELECT query_id, v.id, list_cosine_similarity(q.embedding, v.embedding) AS s FROM vq q, vec v),
    knn AS (SELECT query_id, id, 1 - s AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(1 - s, 9), id) AS rank FROM sims)"""


@query(f"WITH {KNN_SQL} SELECT query_id, id, round(distance, 6) AS distance, rank FROM knn WHERE rank <= 10", "vec")
def knn_notes(spark, d):
    return retrieval.knn(vector_queries(spark, d), t.vectors(spark, d), 10).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@query(f"WITH {VECTOR_QUERY} SELECT query_id, v.id, round(list_cosine_similarity(q.embedding, v.embedding), 6) AS similarity FROM vq q, vec v WHERE v.id <> q.query_id AND list_cosine_similarity(q.embedding, v.embedding) > 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(1 - list_cosine_similarity(q.embedding, v.embedding), 9), v.id) <= 5", "vec")
def similar_notes(spark, d):
    of = vector_queries(spark, d).withColumnRenamed("query_id", "id")
    return gardener.similar_notes(of, t.vectors(spark, d), 0.3, 5).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


FOLD = f"translate(lower(%s), '{retrieval.MARKED}', '{retrieval.PLAIN}')"


def bm25_sql(docs: str, fields: dict[str, float], bm: str = "bm") -> str:
    """Common table expressions that end in bm(query_id, id, score)."""
    parts = []
    for f, w in fields.items():
        x = f"{f}_{bm}"
        parts.append(rf"""tok_{x} AS (SELECT id, regexp_extract_all({FOLD % f"coalesce({f}, '')"}, '{LETTERS}') AS ts FROM {docs}),
    st_{x} AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM tok_{x}),
    tf_{x} AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM tok_{x}) WHERE term IN (SELECT term FROM asked) GROUP BY id, dl, term),
    df_{x} AS (SELECT term, count(*) AS df FROM tf_{x} GROUP BY term),
    part_{x} AS (SELECT id, tf_{x}.term, {w} * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) AS part FROM tf_{x} JOIN df_{x} USING (term), st_{x})""")
    union = " UNION ALL ".join(f"SELECT * FROM part_{f}_{bm}" for f in fields)
    return f"{', '.join(parts)}, {bm} AS (SELECT query_id, id, sum(part) AS score FROM asked JOIN ({union}) USING (term) GROUP BY query_id, id)"


ASKED = rf"{TEXT_QUERY}, asked AS (SELECT DISTINCT query_id, unnest(regexp_extract_all({FOLD % 'query'}, '{LETTERS}')) AS term FROM tq)"


@query(f"WITH {ASKED}, {bm25_sql('visible', FIELDS)} SELECT query_id, id, round(score, 6) AS score FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 10", "visible")
def bm25_notes(spark, d):
    found = retrieval.bm25(text_queries(spark, d), visible(spark, d), FIELDS, k=10)
    return retrieval.best_text(found, 10).select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"WITH {ASKED}, {bm25_sql('msg', {'content': 1.0})} SELECT query_id, id, round(score, 6) AS score FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 10", "msg")
def bm25_messages(spark, d):
    found = retrieval.bm25(text_queries(spark, d), t.messages(spark, d), {"content": 1.0}, k=10)
    return retrieval.best_text(found, 10).select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"WITH {ASKED}, {bm25_sql('chat', {'summary': 0.7, 'title': 0.3})} SELECT query_id, id, round(score, 6) AS score FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 10", "chat")
def bm25_summaries(spark, d):
    found = retrieval.bm25(text_queries(spark, d), t.chats(spark, d), {"summary": 0.7, "title": 0.3}, k=10)
    return retrieval.best_text(found, 10).select("query_id", "id", F.round("score", 6).alias("score"))


def hybrid_sql(docs: str, vectors: str, fields: dict[str, float], limit: int, strategy: str = "rrf", x: str = "n") -> str:
    """Common table expressions that end in fused_x (query_id, id, vr, tr, distance, score, fused, best, final_rank)."""
    score = (
        "coalesce(0.7 / (60 + vr), 0) + coalesce(0.3 / (60 + tr), 0)"
        if strategy == "rrf"
        else "coalesce(0.7 / (1 + greatest(distance, 0)), 0) + coalesce(0.3 * least(greatest(score / 10, 0), 1), 0)"
    )
    pool = retrieval.pool_size(limit)
    return f"""{bm25_sql(docs, fields, f"bm_{x}")}, tr_{x} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS tr FROM bm_{x} QUALIFY tr <= {pool}),
    vs_{x} AS (SELECT query_id, v.id, 1 - list_cosine_similarity(q.embedding, v.embedding) AS distance FROM (SELECT 'item:' || substr(id, 6) AS query_id, embedding FROM vec WHERE 'item:' || substr(id, 6) IN (SELECT query_id FROM tq)) q, {vectors} v WHERE v.id IN (SELECT id FROM {docs})),
    vr_{x} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS vr FROM vs_{x} QUALIFY vr <= {pool}),
    fu_{x} AS (SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.id, t.id) AS id, vr, tr, distance, score, {score} AS fused FROM vr_{x} v FULL JOIN tr_{x} t ON v.query_id = t.query_id AND v.id = t.id),
    fused_{x} AS (SELECT *, least(vr, tr) AS best, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC, least(vr, tr), id) AS final_rank FROM fu_{x} QUALIFY final_rank <= {limit})"""


def fused_sql(strategy: str, limit: int) -> str:
    return f"""{ASKED}, {hybrid_sql("note", "vec", FIELDS, limit, strategy)}
    SELECT query_id, id, vr AS vector_rank, tr AS text_rank, round(fused, 6) AS fused_score, final_rank FROM fused_n"""


def fused(spark: SparkSession, d: str, strategy: str, limit: int) -> DataFrame:
    how = retrieval.Fusion(strategy)
    hits = retrieval.hybrid(both_queries(spark, d), t.notes(spark, d), t.vectors(spark, d), FIELDS, limit, how)
    return hits.select("query_id", "id", "vector_rank", "text_rank", F.round("fused_score", 6).alias("fused_score"), "final_rank")


@query("WITH " + fused_sql("rrf", 10), "note", "vec")
def rrf_fusion(spark, d):
    return fused(spark, d, "rrf", 10)


@query("WITH " + fused_sql("weighted", 10), "note", "vec")
def weighted_fusion(spark, d):
    return fused(spark, d, "weighted", 10)


SUMMARY_FIELDS = {"summary": 0.7, "title": 0.3}
SCOPED_SQL = f"""{ASKED}, {hybrid_sql("visible", "vec", FIELDS, 10, x="n")}, {hybrid_sql("msg", "mvec", {"content": 1.0}, 10, x="m")}, {hybrid_sql("chat", "cvec", SUMMARY_FIELDS, 10, x="s")},
    every AS (SELECT query_id, id, 'note' AS hit_type, 0 AS k, fused AS score, best FROM fused_n UNION ALL SELECT query_id, id, 'message', 1, fused * 0.9, best FROM fused_m UNION ALL SELECT query_id, id, 'summary', 2, fused * 0.8, best FROM fused_s),
    scope AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, best, k, id) AS final_rank FROM every QUALIFY final_rank <= 10)"""


@query(f"WITH {SCOPED_SQL} SELECT query_id, id, hit_type, round(score, 6) AS score, best AS best_rank, final_rank FROM scope", "visible", "msg", "chat", "mvec", "cvec", "vec")
def scoped_search(spark, d):
    """Notes, messages and summaries, each by both channels, in one ranking."""
    q = both_queries(spark, d)
    parts = {
        "note": retrieval.hybrid(q, visible(spark, d), t.vectors(spark, d), FIELDS, 10),
        "message": retrieval.hybrid(q, t.messages(spark, d), t.message_vectors(spark, d), {"content": 1.0}, 10),
        "summary": retrieval.hybrid(q, t.chats(spark, d), t.chat_vectors(spark, d), SUMMARY_FIELDS, 10),
    }
    hits = retrieval.scoped(parts, {"message": 0.9, "summary": 0.8}, 10)
    return hits.select("query_id", "id", "hit_type", F.round("score", 6).alias("score"), "best_rank", "final_rank")


# ---- graph


def entity_queries(spark: SparkSession, d: str) -> DataFrame:
    """A question about each nation, each alias, and a fragment of each name."""
    e = t.entities(spark, d)
    return (
        e.select(F.concat(F.lit("name-"), "id").alias("query_id"), F.col("name").alias("query"))
        .unionByName(e.select(F.concat(F.lit("ask-"), "id").alias("query_id"), F.concat(F.lit("What changed for "), "name", F.lit("?")).alias("query")))
        .unionByName(e.select(F.concat(F.lit("part-"), "id").alias("query_id"), F.concat(F.lit("about "), F.substring("canonical_name", 1, 5)).alias("query")))
    )


ENTITY_QUERY = """eq AS (SELECT 'name-' || id AS query_id, name AS query FROM entity UNION ALL SELECT 'ask-' || id, 'What changed for ' || name || '?' FROM entity
    UNION ALL SELECT 'part-' || id, 'about ' || substring(canonical_name, 1, 5) FROM entity)"""
STOPS = ", ".join(f"'{w}'" for w in tx.PREFIX_STOP_WORDS)
LEX = r"trim(regexp_replace(trim(regexp_replace(lower(%s), '\s+', ' ', 'g')), '[^\p{L}\p{N}]+', ' ', 'g'))"
MATCH_SQL = f"""{ENTITY_QUERY}, lq AS (SELECT query_id, {LEX % "query"} AS q FROM eq),
    ph AS (SELECT id, canonical_name, {LEX % "canonical_name"} AS p FROM entity UNION ALL SELECT id, canonical_name, {LEX % "unnest(aliases)"} FROM entity),
    hit AS (SELECT query_id, id, canonical_name, 1 AS tier, 0 AS spec FROM lq, ph WHERE p = q
        UNION ALL SELECT query_id, id, canonical_name, 2, -length(p) FROM lq, ph WHERE p <> q AND contains(' ' || q || ' ', ' ' || p || ' ')
        UNION ALL SELECT query_id, id, canonical_name, 3, length(w) FROM (SELECT query_id, unnest(string_split(q, ' ')) AS w FROM lq) s, (SELECT id, canonical_name, {LEX % "canonical_name"} AS p FROM entity) e WHERE length(w) >= 4 AND w NOT IN ({STOPS}) AND starts_with(p, w)),
    best AS (SELECT query_id, id, canonical_name, tier, min(spec) AS spec FROM hit GROUP BY ALL),
    firsts AS (SELECT query_id, min(tier) AS tier FROM best GROUP BY query_id),
    matched AS (SELECT b.query_id, b.id AS entity_id, b.tier, row_number() OVER (PARTITION BY b.query_id ORDER BY CASE WHEN b.tier > 1 THEN spec END NULLS FIRST, canonical_name, b.id) AS entity_rank FROM best b JOIN firsts f ON f.query_id = b.query_id AND f.tier = b.tier QUALIFY entity_rank <= 4)"""


@query(f"WITH {MATCH_SQL} SELECT * FROM matched", "entity")
def entity_match_tiers(spark, d):
    return graph.entity_matches(entity_queries(spark, d), t.entities(spark, d), 4)


PAGE_SQL = f"{MATCH_SQL}, pages AS (SELECT m.query_id, m.entity_id, m.entity_rank, n.note_id, row_number() OVER (PARTITION BY m.query_id, m.entity_id ORDER BY n.note_id) AS page_rank FROM matched m JOIN mention n ON n.entity_id = m.entity_id WHERE n.note_id IN (SELECT id FROM visible) QUALIFY page_rank <= 12)"


@query(f"WITH {PAGE_SQL} SELECT query_id, entity_id, note_id, page_rank FROM pages", "entity", "mention", "visible")
def graph_seed_pages(spark, d):
    matches = graph.entity_matches(entity_queries(spark, d), t.entities(spark, d), 4)
    return graph.seed_pages(matches, t.mentions(spark, d), visible(spark, d), 12).select("query_id", "entity_id", "note_id", "page_rank")


def note_seeds(spark: SparkSession, d: str, every: int) -> DataFrame:
    """One seed note a query, for every so-many-th visible note."""
    return visible(spark, d).filter(F.col("doc_id") % every == 0).select(F.col("id").alias("query_id"), F.col("id").alias("note_id"), F.lit(1).alias("entity_rank"))


ONE_HOP_SQL = """ends AS (SELECT from_id AS a, to_id AS b, 'out' AS direction, id AS edge_id, edge_type, confidence FROM visible_edge UNION ALL SELECT to_id, from_id, 'in', id, edge_type, confidence FROM visible_edge),
    seeds AS (SELECT id FROM visible WHERE doc_id % 20 = 0),
    moves AS (SELECT s.id AS query_id, e.b AS id, 0.03 * 0.8 * least(greatest(coalesce(e.confidence, 1.0), 0), 1) AS score, e.edge_id,
        row_number() OVER (PARTITION BY s.id, e.edge_type ORDER BY e.confidence DESC NULLS LAST, e.edge_id) AS per_table FROM seeds s JOIN ends e ON e.a = s.id WHERE e.b <> s.id),
    fan AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, edge_id, id) AS per_node FROM moves WHERE per_table <= 8),
    st AS (SELECT * FROM fan WHERE per_node <= 8 QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY round(score, 9) DESC, edge_id) = 1)
    SELECT query_id, id, round(score, 6) AS score, CAST(1 AS INT) AS hops FROM st UNION ALL SELECT id, id, 0.03, 0 FROM seeds"""


@query(f"WITH {ONE_HOP_SQL}", "visible_edge", "visible")
def graph_one_hop(spark, d):
    v = visible(spark, d)
    found = graph.expand(note_seeds(spark, d, 20), scans.visible_edges(t.edges(spark, d), v))
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "hops")


@query()
def graph_two_hop(spark, d):
    v = visible(spark, d)
    found = graph.graph_search(entity_queries(spark, d), t.entities(spark, d), t.mentions(spark, d), v, scans.visible_edges(t.edges(spark, d), v), graph.Expansion(hops=2))
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "hops", "seed_id", F.array_join(F.transform("path", lambda s: s["edge_id"]), ",").alias("path"))


# ---- chats


TALK_SQL = """talk AS (SELECT *, lag(role) OVER w AS before_role, lag(content) OVER w AS before_content, lead(role) OVER w AS next_role FROM msg WHERE role <> 'system' WINDOW w AS (PARTITION BY conversation_id ORDER BY message_index)),
    pair AS (SELECT *, strlen(before_content) > 10 AND strlen(content) > 20 AS long FROM talk WHERE role = 'assistant' AND before_role = 'human')"""


@query(f"WITH {TALK_SQL} SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY message_index) AS pair, message_index, before_content AS question, content AS answer FROM pair WHERE long", "msg")
def qa_pairs(spark, d):
    return chat.qa_pairs(t.messages(spark, d))


@query(f"""WITH {TALK_SQL} SELECT t.conversation_id, count(*) FILTER (WHERE p) AS pairs, count(*) FILTER (WHERE s) AS short_pairs, count(*) FILTER (WHERE o) AS open_questions, max(o AND next_role IS NULL) AS ends_open FROM
    (SELECT conversation_id, next_role, coalesce(role = 'assistant' AND before_role = 'human' AND strlen(before_content) > 10 AND strlen(content) > 20, false) AS p,
    coalesce(role = 'assistant' AND before_role = 'human' AND NOT (strlen(before_content) > 10 AND strlen(content) > 20), false) AS s,
    role = 'human' AND NOT coalesce(next_role = 'assistant', false) AS o FROM talk) t GROUP BY t.conversation_id""", "msg")
def qa_diagnostics(spark, d):
    return chat.qa_diagnostics(t.messages(spark, d))


def qa_title_sql(question: str, number: str) -> str:
    line = f"string_split({question}, chr(10))[1]"
    for opening in chat.OPENINGS:
        line = f"""regexp_replace({line}, '^(?:{opening.replace("'", "''")})+', '')"""
    cut = f"substring({line}, 1, 48)"
    head = rf"regexp_extract({cut}, '(?s)^(.*)\s\S*$', 1)"
    return f"CASE WHEN {line} = '' THEN 'Q&A #' || {number} WHEN length({line}) <= 48 THEN {line} ELSE (CASE WHEN {head} <> '' THEN {head} ELSE {cut} END) || '...' END"


@query(rf"""WITH {TALK_SQL}, p AS (SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY message_index) AS pair, before_content AS question, content AS answer FROM pair WHERE long)
    SELECT p.conversation_id, pair, {qa_title_sql('question', 'pair')} AS title, '**Question:** ' || question || chr(10) || chr(10) || '**Answer:** ' || answer AS content, 'chat-export,qa,conversation:' || replace(lower(c.title), ' ', '-') AS tags
    FROM p JOIN chat c ON c.id = p.conversation_id""", "msg", "chat")
def qa_notes(spark, d):
    return chat.qa_notes(t.messages(spark, d), t.chats(spark, d)).withColumn("tags", F.array_join("tags", ","))


@query("""SELECT m.id, m.conversation_id, upper(substr(role, 1, 1)) || substr(role, 2) || ' message #' || (message_index + 1) AS title,
    '**Conversation:** ' || c.title || chr(10) || '**Message #:** ' || (message_index + 1) || chr(10) || '**Role:** ' || upper(substr(role, 1, 1)) || substr(role, 2) || chr(10)
    || '**Created At:** ' || strftime(m.created_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' || chr(10) || '**Structured Blocks:** 0 (tools: 0, citations: 0)' || chr(10) || '**Files:** (none)' || chr(10) || chr(10)
    || CASE WHEN trim(content) = '' THEN '[No text body. See structured content metadata below.]' ELSE content END AS content,
    'chat-export,message,role:' || role || ',conversation:' || replace(lower(c.title), ' ', '-') AS tags FROM msg m JOIN chat c ON c.id = m.conversation_id""", "msg", "chat")
def message_notes(spark, d):
    return chat.message_notes(t.messages(spark, d), t.chats(spark, d)).withColumn("tags", F.array_join("tags", ","))


@query("""SELECT m.conversation_id, '# ' || any_value(c.title) || chr(10) || chr(10) || string_agg('## ' || upper(substr(role, 1, 1)) || substr(role, 2) || chr(10) || chr(10) || content, chr(10) || chr(10) ORDER BY message_index) AS markdown
    FROM msg m JOIN chat c ON c.id = m.conversation_id GROUP BY m.conversation_id""", "msg", "chat")
def conversation_markdown(spark, d):
    return chat.markdown(t.messages(spark, d), t.chats(spark, d))


@query("SELECT id, uuid, title, summary, messages, updated_at, source_uri FROM chat", "chat")
def chats(spark, d):
    return t.chats(spark, d)


@query(f"""WITH {TALK_SQL}, d AS (SELECT t.conversation_id, count(*) FILTER (WHERE p) AS pairs, count(*) FILTER (WHERE s) AS short_pairs, max(o AND next_role IS NULL) AS ends_open FROM
    (SELECT conversation_id, next_role, coalesce(role = 'assistant' AND before_role = 'human' AND strlen(before_content) > 10 AND strlen(content) > 20, false) AS p,
    coalesce(role = 'assistant' AND before_role = 'human' AND NOT (strlen(before_content) > 10 AND strlen(content) > 20), false) AS s,
    role = 'human' AND NOT coalesce(next_role = 'assistant', false) AS o FROM talk) t GROUP BY t.conversation_id)
    SELECT (SELECT count(*) FROM msg) AS messages, (SELECT count(DISTINCT conversation_id) FROM msg) AS conversations, (SELECT count(*) FROM msg WHERE strlen(content) > 20) AS long_messages,
    CAST(sum(pairs) AS BIGINT) AS pairs, CAST(sum(short_pairs) AS BIGINT) AS short_pairs, count(*) FILTER (WHERE pairs = 0) AS chats_without_pairs, count(*) FILTER (WHERE ends_open) AS chats_left_open FROM d""", "msg")
def chat_preview(spark, d):
    return chat.preview(t.messages(spark, d))


# ---- writes


@query("""WITH arrivals AS (SELECT lower(trim(n_name)) AS canonical_name, n_name || '-' || c_custkey AS name, CASE WHEN c_custkey % 2 = 0 THEN 'organization' ELSE 'person' END AS entity_type, 'alias' || (c_custkey % 7) AS alias, c_custkey AS seq FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT canonical_name, arg_max(name, seq) AS name, arg_min(entity_type, seq) AS entity_type, array_to_string(list_sort(list(DISTINCT alias)), ',') AS aliases, count(*) AS arrivals FROM arrivals GROUP BY canonical_name""")
def upsert_entities(spark, d):
    c, n = t.read(spark, d, "customer"), t.read(spark, d, "nation")
    arrivals = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.lower(F.trim("n_name")).alias("canonical_name"), F.concat_ws("-", "n_name", "c_custkey").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "organization").otherwise("person").alias("entity_type"),
        F.array(F.concat(F.lit("alias"), F.col("c_custkey") % 7)).alias("aliases"), F.col("c_custkey").alias("seq"),
    )
    return lifecycle.merge_entities(arrivals).withColumn("aliases", F.array_join(F.array_sort("aliases"), ","))


@query("""WITH old AS (SELECT user_id, event_id, event_type, value FROM events WHERE user_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1),
    new AS (SELECT user_id, event_id, event_type, value FROM events WHERE user_id % 2 = 0)
    SELECT user_id, event_id, event_type, value FROM (SELECT *, 0 AS fresh FROM old UNION ALL SELECT *, 1 FROM new) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY fresh DESC, event_id DESC) = 1""")
def upsert_last_writer(spark, d):
    """First events of two thirds of the users are there; all events of every second user arrive."""
    e = t.read(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    old = scans.first_per(e.filter("user_id % 3 <> 0"), ["user_id"], ["event_id"], 1).drop("rank")
    return lifecycle.upsert(old, e.filter("user_id % 2 = 0"), "user_id", "event_id")


@query("SELECT DISTINCT note_id, entity_id FROM (SELECT note_id, 'entity:' || (CAST(substr(entity_id, 8) AS BIGINT) + 1) % 25 AS entity_id FROM mention) WHERE (note_id, entity_id) NOT IN (SELECT (note_id, entity_id) FROM mention)", "mention")
def insert_links(spark, d):
    m = t.mentions(spark, d)
    new = m.withColumn("entity_id", F.concat(F.lit("entity:"), (F.regexp_extract("entity_id", "[0-9]+", 0).cast("long") + 1) % 25))
    return lifecycle.insert_links(m, new, ["note_id", "entity_id"])


@query("SELECT id, edge_type, from_id, to_id FROM (SELECT id, edge_type, CASE WHEN edge_type = 'related_to' THEN least(from_id, to_id) ELSE from_id END AS from_id, CASE WHEN edge_type = 'related_to' THEN greatest(from_id, to_id) ELSE to_id END AS to_id FROM edge) QUALIFY row_number() OVER (PARTITION BY edge_type, from_id, to_id ORDER BY id) = 1", "edge")
def backfill_dedupe_keys(spark, d):
    return lifecycle.backfilled_keys(t.edges(spark, d)).select("id", "edge_type", "from_id", "to_id")


@query("""SELECT uri, CASE WHEN status = 'ready' AND CAST(regexp_extract(uri, '[0-9]+$') AS BIGINT) % 3 = 0 THEN 'unchanged' ELSE 'updated' END AS action,
    CASE WHEN status = 'ready' AND CAST(regexp_extract(uri, '[0-9]+$') AS BIGINT) % 3 = 0 THEN generation ELSE generation + 1 END AS generation,
    CASE WHEN status = 'ready' AND CAST(regexp_extract(uri, '[0-9]+$') AS BIGINT) % 3 = 0 THEN status ELSE 'pending' END AS status FROM src
    UNION ALL SELECT 'fixture://new', 'created', CAST(1 AS BIGINT), 'pending'""", "src")
def begin_imports(spark, d):
    now = t.sources(spark, d).withColumn("content_hash", F.lit("a"))
    third = F.regexp_extract("uri", "[0-9]+$", 0).cast("long") % 3 == 0
    incoming = now.select("uri", F.when(third, "a").otherwise("b").alias("content_hash")).unionByName(spark.createDataFrame([("fixture://new", "c")], "uri string, content_hash string"))
    return lifecycle.begin_imports(now, incoming)


@query("SELECT n.id, n.source_generation FROM note n JOIN (SELECT id, CASE WHEN status = 'pending' THEN generation ELSE successful_generation END AS g FROM src) s ON s.id = n.source_id WHERE n.source_generation IS NOT NULL AND n.source_generation <> s.g", "note", "src")
def retired_after_promotion(spark, d):
    return lifecycle.retired(t.notes(spark, d), lifecycle.promoted(t.sources(spark, d))).select("id", "source_generation")


@query("""WITH suc AS (SELECT id AS old_id, 'note:' || (doc_id + 1000000) AS new_id FROM note WHERE doc_id % 9 = 0),
    mv AS (SELECT e.id, edge_type, coalesce(a.new_id, from_id) AS f, coalesce(b.new_id, to_id) AS t FROM edge e LEFT JOIN suc a ON a.old_id = from_id LEFT JOIN suc b ON b.old_id = to_id WHERE a.new_id IS NOT NULL OR b.new_id IS NOT NULL)
    SELECT id, edge_type, CASE WHEN edge_type = 'related_to' THEN least(f, t) ELSE f END AS from_id, CASE WHEN edge_type = 'related_to' THEN greatest(f, t) ELSE t END AS to_id FROM mv WHERE f <> t""", "note", "edge")
def remap_edges(spark, d):
    successors = t.notes(spark, d).filter("doc_id % 9 = 0").select(F.col("id").alias("old_id"), F.concat(F.lit("note:"), F.col("doc_id") + 1000000).alias("new_id"))
    return lifecycle.remapped_edges(t.edges(spark, d), successors).select("id", "edge_type", "from_id", "to_id")


@query("""WITH el AS (SELECT *, edge_type = 'related_to' AND generator = 'gardener-similarity' AND confidence >= 0.6 AND (status IN ('pending', 'accepting') OR (status = 'accepted' AND resulting_edge_id IS NULL)) AS ok,
    from_id NOT IN (SELECT id FROM visible) OR to_id NOT IN (SELECT id FROM visible) AS stale, EXISTS (SELECT 1 FROM edge e WHERE e.edge_type = 'related_to' AND least(e.from_id, e.to_id) = least(p.from_id, p.to_id) AND greatest(e.from_id, e.to_id) = greatest(p.from_id, p.to_id)) AS there FROM proposal p)
    SELECT id, CASE WHEN NOT ok THEN status WHEN stale OR there THEN 'superseded' ELSE 'accepted' END AS status, CASE WHEN ok AND stale THEN 'endpoint is gone' WHEN ok AND there THEN 'edge is already there' END AS supersession_reason FROM el""", "proposal", "visible", "edge")
def bulk_acceptance(spark, d):
    return lifecycle.acceptance(t.proposals(spark, d), visible(spark, d), t.edges(spark, d), 0.6).select("id", "status", "supersession_reason")


@query("""WITH new AS (SELECT CASE WHEN from_id <= to_id THEN from_id ELSE to_id END AS a, CASE WHEN from_id <= to_id THEN to_id ELSE from_id END AS b, max(least(confidence + 0.25, 1.0)) AS c FROM proposal WHERE CAST(substr(id, 15) AS BIGINT) % 2 = 0 GROUP BY ALL)
    SELECT id, status, round(CASE WHEN status = 'pending' AND c IS NOT NULL THEN c ELSE confidence END, 6) AS confidence FROM proposal LEFT JOIN new ON a = least(from_id, to_id) AND b = greatest(from_id, to_id)""", "proposal")
def upsert_proposals(spark, d):
    p = t.proposals(spark, d)
    new = p.filter(F.substring("id", 15, 6).cast("long") % 2 == 0).withColumn("confidence", F.col("confidence") + 0.25)
    return lifecycle.upsert_proposals(p, new).select("id", "status", F.round("confidence", 6).alias("confidence"))


# ---- upkeep, jobs, evaluation, archives


GARDEN_SQL = """vv AS (SELECT v.id, v.embedding FROM vec v JOIN visible n ON n.id = v.id),
    lone AS (SELECT id FROM visible WHERE id NOT IN (SELECT from_id FROM visible_edge WHERE edge_type <> 'derived_from' UNION ALL SELECT to_id FROM visible_edge WHERE edge_type <> 'derived_from')),
    near AS (SELECT a.id AS q, b.id, list_cosine_similarity(a.embedding, b.embedding) AS s, row_number() OVER (PARTITION BY a.id ORDER BY round(1 - list_cosine_similarity(a.embedding, b.embedding), 9), b.id) AS rank
        FROM vv a JOIN lone l ON l.id = a.id, vv b WHERE a.id <> b.id AND list_cosine_similarity(a.embedding, b.embedding) > 0.2 QUALIFY rank <= 5),
    pairs AS (SELECT least(q, id) AS from_id, greatest(q, id) AS to_id, s, q, rank FROM near QUALIFY row_number() OVER (PARTITION BY least(q, id), greatest(q, id) ORDER BY q, rank) = 1),
    suggested AS (SELECT from_id, to_id, s FROM pairs ORDER BY q, rank LIMIT 50)"""


@query(f"WITH {GARDEN_SQL} SELECT from_id, to_id, round(s, 6) AS similarity, format('High semantic similarity ({{:.1f}}%)', s * 100) AS reason FROM suggested", "vec", "visible", "visible_edge")
def gardener_suggestions(spark, d):
    v = visible(spark, d)
    lone = graph.orphans(v, scans.visible_edges(t.edges(spark, d), v)).select("id")
    vectors = t.vectors(spark, d).join(v.select("id"), "id", "left_semi")
    return gardener.suggestions(vectors.join(lone, "id", "left_semi"), vectors, 0.2).withColumn("similarity", F.round("similarity", 6))


TOKENS_SQL = r"tk AS (SELECT conv_id AS group_id, id, unnest(string_split(trim(regexp_replace(trim(regexp_replace(lower(content), '\s+', ' ', 'g')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')) AS token FROM (SELECT conv_id, id, content FROM msg UNION ALL SELECT conv_id, id || ':edit', regexp_replace(content, '\S+\s+\S+\s*$', '') FROM msg)), tc AS (SELECT group_id, id, token, count(*) AS n FROM tk WHERE token <> '' GROUP BY ALL), sz AS (SELECT group_id, id, sum(n) AS size FROM tc GROUP BY ALL)"


@query(f"""WITH {TOKENS_SQL}, sh AS (SELECT a.group_id, a.id AS left_id, b.id AS right_id, sum(least(a.n, b.n)) AS shared FROM tc a JOIN tc b ON a.group_id = b.group_id AND a.token = b.token AND a.id < b.id GROUP BY ALL)
    SELECT sh.group_id, left_id, right_id, round(shared / (x.size + y.size - shared), 6) AS similarity FROM sh JOIN sz x ON x.id = left_id JOIN sz y ON y.id = right_id WHERE shared / (x.size + y.size - shared) >= 0.85""", "msg")
def near_duplicate_messages(spark, d):
    """Messages of a conversation; every message comes again as an edit without its last words."""
    m = t.messages(spark, d)
    edited = m.withColumns({"id": F.concat("id", F.lit(":edit")), "content": F.regexp_replace("content", r"\S+\s+\S+\s*$", "")})
    m = m.unionByName(edited)
    tokens = m.select(F.col("conv_id").alias("group_id"), "id", F.explode(F.split(tx.lexical(F.col("content")), " ")).alias("token")).filter("token <> ''").groupBy("group_id", "id", "token").agg(F.count("*").alias("n"))
    return gardener.near_duplicates(tokens, 0.85).withColumn("similarity", F.round("similarity", 6))


@query("""WITH items AS (SELECT id, 'note' AS kind, content AS text FROM note UNION ALL SELECT id, 'message', CASE WHEN trim(content) = '' THEN '[empty message]' ELSE content END FROM msg UNION ALL SELECT id, 'summary', summary FROM chat WHERE summary IS NOT NULL AND trim(summary) <> '')
    SELECT id, kind, sha256(text) AS fingerprint FROM items WHERE id NOT IN (SELECT id FROM vec)""", "note", "msg", "chat", "vec")
def pending_embeddings(spark, d):
    items = jobs.reindexable(t.notes(spark, d), t.messages(spark, d), t.chats(spark, d))
    done = items.join(t.vectors(spark, d).select("id"), "id", "left_semi").withColumn("fingerprint", F.sha2("text", 256))
    return jobs.left_to_do(items, done).select("id", "kind", "fingerprint")


@query(r"""WITH k AS (SELECT id, content, sha256('embed' || chr(0) || 'test' || chr(0) || '' || chr(0) || 'fnv' || chr(0) || '' || chr(0) || '1' || chr(0) || 'sha256:' || sha256(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)))) AS cache_key FROM msg),
    held AS (SELECT DISTINCT cache_key FROM k JOIN msg USING (id) WHERE conv_id % 2 = 0)
    SELECT id, cache_key, CAST(CASE WHEN cache_key IN (SELECT cache_key FROM held) THEN 1 ELSE 2 * length(content) END AS DOUBLE) AS first FROM k""", "msg")
def cached_inference(spark, d):
    """Texts of every second conversation are in the cache; the others are inferred."""
    items = t.messages(spark, d).select("id", F.col("content").alias("text"), "conv_id")
    identity = {"operation": "embed", "provider": "test", "model": "fnv", "version": "1"}
    cache = items.filter("conv_id % 2 = 0").select(jobs.cache_key(F.col("text"), **identity).alias("cache_key"), F.array(F.lit(1.0).cast("float")).alias("embedding")).dropDuplicates(["cache_key"])
    found, _ = jobs.infer_cached(items.drop("conv_id"), cache, lambda texts: [[2.0 * len(x)] for x in texts], **identity)
    return found.select("id", "cache_key", F.col("embedding")[0].cast("double").alias("first"))


METRIC_SQL = f"""{KNN_SQL}, rel AS (SELECT q.query_id, v.id, 1 + CAST(substr(v.id, 6) AS BIGINT) % 2 AS grade FROM (SELECT query_id, label FROM vq JOIN vec ON vec.id = vq.query_id) q JOIN vec v ON v.label = q.label AND CAST(substr(v.id, 6) AS BIGINT) % 5 = 0),
    idl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS p FROM rel),
    tot AS (SELECT query_id, count(*) AS relevant, sum((2.0 ** grade - 1) / log2(p + 1)) FILTER (WHERE p <= 10) AS idcg FROM idl GROUP BY query_id),
    hit AS (SELECT k.query_id, count(*) AS found, min(rank) AS first, sum((2.0 ** grade - 1) / log2(rank + 1)) AS dcg FROM knn k JOIN rel r ON r.query_id = k.query_id AND r.id = k.id WHERE rank <= 10 GROUP BY k.query_id),
    met AS (SELECT t.query_id AS case_id, relevant, coalesce(found, 0) / relevant AS recall, coalesce(found, 0) / 10.0 AS precision, coalesce(1.0 / first, 0) AS reciprocal_rank, coalesce(dcg, 0) / idcg AS ndcg FROM tot t LEFT JOIN hit h ON h.query_id = t.query_id)"""


def metrics(spark: SparkSession, d: str) -> DataFrame:
    q = vector_queries(spark, d)
    v = t.vectors(spark, d)
    number = F.regexp_extract("id", "[0-9]+", 0).cast("long")
    sets = q.select("query_id").join(v.select(F.col("id").alias("query_id"), F.col("label").alias("set_id")), "query_id").withColumnRenamed("query_id", "case_id")
    given = v.filter(number % 5 == 0).select(F.col("label").alias("set_id"), "id", (1 + number % 2).alias("grade")).filter("set_id is not null")
    ranked = retrieval.knn(q, v, 10).select(F.col("query_id").alias("case_id"), "id", "rank")
    return evaluation.case_metrics(ranked, given, 10, sets)


@query(f"WITH {METRIC_SQL} SELECT case_id, relevant, round(recall, 6) AS recall, round(precision, 6) AS precision, round(reciprocal_rank, 6) AS reciprocal_rank, round(ndcg, 6) AS ndcg FROM met", "vec")
def ir_metrics(spark, d):
    return metrics(spark, d).select("case_id", "relevant", *[F.round(m, 6).alias(m) for m in evaluation.METRICS])


@query(f"""WITH {METRIC_SQL}, s AS (SELECT avg(recall) AS recall, avg(precision) AS precision, avg(reciprocal_rank) AS reciprocal_rank, avg(ndcg) AS ndcg FROM met),
    l AS (SELECT 'recall' AS metric, recall AS v FROM s UNION ALL SELECT 'precision', precision FROM s UNION ALL SELECT 'reciprocal_rank', reciprocal_rank FROM s UNION ALL SELECT 'ndcg', ndcg FROM s)
    SELECT metric, round(v, 6) AS now, round(v * 0.5 + 0.2, 6) AS baseline, round(v - (v * 0.5 + 0.2), 6) AS delta, v - (v * 0.5 + 0.2) < -0.05 AS regressed FROM l""", "vec")
def regression_gate(spark, d):
    now = evaluation.summary(metrics(spark, d))
    base = now.withColumns({m: F.col(m) * 0.5 + 0.2 for m in evaluation.METRICS})
    out = evaluation.regressions(now, base, dict.fromkeys(evaluation.METRICS, 0.05))
    return out.select("metric", *[F.round(c, 6).alias(c) for c in ("now", "baseline", "delta")], "regressed")


@query("SELECT 'entity' AS table_name, count(*) AS records FROM entity UNION ALL SELECT 'source', count(*) FROM src UNION ALL SELECT 'note', count(*) FROM note", "entity", "src", "note")
def archive_counts(spark, d):
    lines = portable.archive_lines({"entity": t.entities(spark, d), "source": t.sources(spark, d), "note": t.notes(spark, d)})
    return portable.table_counts(lines).select("table_name", "records")


@query("SELECT 'note' AS table_name, id, 'source_id' AS field, source_id AS target FROM note WHERE source_id NOT IN (SELECT id FROM src WHERE status = 'ready')", "note", "src")
def archive_dangling(spark, d):
    lines = portable.archive_lines({"source": t.sources(spark, d).filter("status = 'ready'"), "note": t.notes(spark, d)})
    return portable.dangling(lines, {"note": {"source_id": "source"}})


# ---- text shaping


@query("""WITH p AS (SELECT id, unnest(list_filter(list_transform(string_split(replace(content, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) >= 40)) AS p,
        generate_subscripts(list_filter(string_split(replace(content, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) >= 40), 1) AS pos FROM note),
    n AS (SELECT *, CAST(ceil(length(p) / 120.0) AS INT) AS whole FROM p),
    c AS (SELECT id, pos, i, p, whole, length(p) AS n, CASE WHEN whole > 1 AND length(p) - (whole - 1) * 120 < 40 AND i = whole - 1 THEN length(p) - 40 ELSE i * 120 END AS b,
        CASE WHEN i = whole - 1 THEN length(p) WHEN whole > 1 AND length(p) - (whole - 1) * 120 < 40 AND i + 1 = whole - 1 THEN length(p) - 40 ELSE (i + 1) * 120 END AS e FROM (SELECT *, unnest(generate_series(0, whole - 1)) AS i FROM n))
    SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY pos, i) - 1 AS INT) AS place, substring(p, CAST(b + 1 AS BIGINT), CAST(e - b AS BIGINT)) AS chunk FROM c""", "note")
def paragraph_chunks(spark, d):
    text = F.regexp_replace("content", "\n", "\n\n")
    return t.notes(spark, d).select("id", F.posexplode(chunking.paragraph_chunks(text, 40, 120)).alias("place", "chunk"))


@query()
def markdown_chunks(spark, d):
    made = chat.markdown(t.messages(spark, d), t.chats(spark, d)).select(F.col("conversation_id").alias("source_identity"), "markdown")
    return chunking.markdown_chunks(made).select("source_identity", "ordinal", "start_byte", "end_byte", "content_hash", F.array_join("heading_path", " > ").alias("heading_path"), "overlap_chars")


def two_generations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Notes as chunks of their sources, and a generation in which some changed and some are gone."""
    number = F.col("doc_id")
    old = t.notes(spark, d).select("source_id", number.cast("int").alias("ordinal"), F.array(F.concat(F.lit("part "), F.floor(number / 200))).alias("heading_path"), "content", "id")
    new = old.drop("id").withColumn("content", F.when(F.col("ordinal") % 13 == 0, F.concat("content", F.lit(" changed"))).otherwise(F.col("content")))
    return old, new.filter("ordinal % 29 <> 0")


ALIGN_SQL = """o AS (SELECT source_id, id, doc_id AS ordinal, doc_id // 200 AS h, content AS c, row_number() OVER (PARTITION BY source_id ORDER BY doc_id) AS p FROM note),
    w AS (SELECT source_id, doc_id AS ordinal, doc_id // 200 AS h, CASE WHEN doc_id % 13 = 0 THEN content || ' changed' ELSE content END AS c, row_number() OVER (PARTITION BY source_id ORDER BY doc_id) AS p FROM note WHERE doc_id % 29 <> 0),
    oc AS (SELECT source_id, h, c, count(*) AS n FROM o GROUP BY ALL), wc AS (SELECT source_id, h, c, count(*) AS n FROM w GROUP BY ALL), eq AS (SELECT * FROM oc JOIN wc USING (source_id, h, c, n)),
    ok AS (SELECT o.*, n, row_number() OVER (PARTITION BY source_id ORDER BY p) AS k FROM o JOIN eq USING (source_id, h, c)), wk AS (SELECT w.*, n, row_number() OVER (PARTITION BY source_id ORDER BY p) AS k FROM w JOIN eq USING (source_id, h, c)),
    line AS (SELECT a.source_id, a.p AS i, b.p AS j, a.h = b.h AND a.c = b.c AS same FROM ok a JOIN wk b USING (source_id, k)), flat AS (SELECT source_id, bool_and(same) AS ordered FROM line GROUP BY source_id),
    single AS (SELECT a.source_id, a.p AS i, b.p AS j FROM ok a JOIN wk b USING (source_id, h, c) JOIN flat f USING (source_id) WHERE a.n = 1 AND b.n = 1 AND NOT ordered),
    up AS (SELECT source_id, i, j FROM single QUALIFY j > coalesce(max(j) OVER (PARTITION BY source_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)),
    ex AS (SELECT source_id, i, j FROM line JOIN flat USING (source_id) WHERE ordered UNION ALL SELECT * FROM up),
    gap AS (SELECT x.source_id, x.i + 1 AS i, x.j + 1 AS j FROM ex x JOIN ex y ON y.source_id = x.source_id AND y.i = x.i + 2 AND y.j = x.j + 2 JOIN o a ON a.source_id = x.source_id AND a.p = x.i JOIN o b ON b.source_id = x.source_id AND b.p = x.i + 1
        JOIN o e ON e.source_id = x.source_id AND e.p = x.i + 2 JOIN w m ON m.source_id = x.source_id AND m.p = x.j + 1 WHERE a.h = b.h AND b.h = e.h AND e.h = m.h AND (x.source_id, x.i + 1) NOT IN (SELECT (source_id, i) FROM ex)),
    al AS (SELECT z.source_id, CAST(o.ordinal AS INT) AS old_ordinal, CAST(w.ordinal AS INT) AS new_ordinal, exact_content FROM (SELECT *, true AS exact_content FROM ex UNION ALL SELECT *, false FROM gap) z
        JOIN o ON o.source_id = z.source_id AND o.p = z.i JOIN w ON w.source_id = z.source_id AND w.p = z.j)"""


@query(f"WITH {ALIGN_SQL} SELECT * FROM al", "note")
def aligned_chunks(spark, d):
    old, new = two_generations(spark, d)
    return chunking.aligned_chunks(old, new)


@query()
def packed_context(spark, d):
    q = both_queries(spark, d)
    hits = retrieval.hybrid(q, visible(spark, d), t.vectors(spark, d), FIELDS, 32)
    rows = hits.join(visible(spark, d).select("id", "title", "content"), "id").join(q.select("query_id", "query"), "query_id")
    shaped = rows.select("query_id", "query", F.col("final_rank").alias("rank"), "id", F.lit("note").alias("hit_type"), "title", "content", F.col("fused_score").alias("score"))
    return packing.pack(shaped).select("query_id", "id", "citation", "reason", "tokens", F.round("relevance", 6).alias("relevance"), F.round("novelty", 6).alias("novelty"))


# ---- more of imports, writes and reports


@query(f"WITH {TALK_SQL} SELECT id, role FROM talk WHERE NOT coalesce((role = 'human' AND next_role = 'assistant') OR (role = 'assistant' AND before_role = 'human'), false)", "msg")
def unpaired_messages(spark, d):
    return chat.unpaired_messages(t.messages(spark, d)).select("id", "role")


@query(f"""WITH {TALK_SQL}, q AS (SELECT conversation_id, count(*) AS n FROM pair WHERE long GROUP BY ALL),
    u AS (SELECT count(*) AS n FROM talk WHERE NOT coalesce((role = 'human' AND next_role = 'assistant') OR (role = 'assistant' AND before_role = 'human'), false))
    SELECT 'qa' AS mode, 'qa' AS kind, CAST(sum(n) AS BIGINT) AS notes FROM q UNION ALL SELECT 'qa', 'markdown', (SELECT count(*) FROM chat WHERE id NOT IN (SELECT conversation_id FROM q))
    UNION ALL SELECT 'message', 'message', (SELECT count(*) FROM msg) UNION ALL SELECT 'hybrid', 'qa', CAST(sum(n) AS BIGINT) FROM q UNION ALL SELECT 'hybrid', 'message', (SELECT n FROM u)""", "msg", "chat")
def chat_import_modes(spark, d):
    out = None
    for mode in ("qa", "message", "hybrid"):
        one = chat.imported_notes(t.messages(spark, d), t.chats(spark, d), mode).groupBy("kind").agg(F.count("*").alias("notes")).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out.select("mode", "kind", "notes")


@query("SELECT m.note_id, m.entity_id FROM mention m WHERE m.note_id NOT IN (SELECT 'note:' || doc_id FROM documents WHERE doc_id % 10 = 0) UNION ALL SELECT 'note:' || doc_id, 'entity:1' FROM documents WHERE doc_id % 10 = 0", "mention")
def replace_mentions(spark, d):
    new = t.read(spark, d, "documents").filter("doc_id % 10 = 0").select(F.concat(F.lit("note:"), "doc_id").alias("note_id"), F.lit("entity:1").alias("entity_id"))
    return lifecycle.replace_links(t.mentions(spark, d), new, "note_id")


@query("SELECT id, CASE WHEN status = 'pending' THEN generation ELSE successful_generation END AS successful_generation, CASE WHEN status = 'pending' THEN 'ready' ELSE status END AS status FROM src", "src")
def promote_sources(spark, d):
    return lifecycle.promoted(t.sources(spark, d)).select("id", "successful_generation", "status")


@query("SELECT id FROM note WHERE NOT (source_id = 'source:src4' AND source_generation IS NOT DISTINCT FROM (SELECT generation FROM src WHERE id = 'source:src4' AND generation <> successful_generation)) OR source_generation IS NULL", "note", "src")
def failed_import(spark, d):
    return lifecycle.failed(t.sources(spark, d), t.notes(spark, d), "source:src4")[1].select("id")


@query("SELECT id, CASE WHEN status IN ('pending', 'accepting', 'accepted') AND (from_id IN (SELECT id FROM note WHERE source_id = 'source:src2') OR to_id IN (SELECT id FROM note WHERE source_id = 'source:src2')) THEN 'superseded' ELSE status END AS status FROM proposal", "proposal", "note")
def supersede_by_removal(spark, d):
    return lifecycle.superseded_by_removal(t.proposals(spark, d), t.notes(spark, d).filter("source_id = 'source:src2'")).select("id", "status")


@query("SELECT id, edge_type FROM edge WHERE from_id NOT IN (SELECT id FROM note WHERE source_id = 'source:src3') AND to_id NOT IN (SELECT id FROM note WHERE source_id = 'source:src3')", "edge", "note")
def edges_after_delete(spark, d):
    doomed = t.notes(spark, d).filter("source_id = 'source:src3'")
    return lifecycle.without_notes(doomed, t.notes(spark, d), t.edges(spark, d), t.mentions(spark, d))[1].select("id", "edge_type")


@query("""WITH new AS (SELECT 'supports:x' || doc_id AS id, 'related_to' AS edge_type, 'note:' || least(doc_id, doc_id // 3) AS a, 'note:' || greatest(doc_id, doc_id // 3) AS b FROM documents WHERE doc_id % 3 = 1 AND doc_id <> doc_id // 3)
    SELECT id, least(a, b) AS from_id, greatest(a, b) AS to_id FROM new WHERE a IN (SELECT id FROM visible) AND b IN (SELECT id FROM visible)
    AND NOT EXISTS (SELECT 1 FROM edge e WHERE e.edge_type = 'related_to' AND least(e.from_id, e.to_id) = least(a, b) AND greatest(e.from_id, e.to_id) = greatest(a, b))
    QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY id) = 1""", "visible", "edge")
def audited_edges(spark, d):
    other = F.floor(F.col("doc_id") / 3)
    new = t.read(spark, d, "documents").filter("doc_id % 3 = 1").select(
        F.concat(F.lit("supports:x"), "doc_id").alias("id"), F.lit("related_to").alias("edge_type"), F.concat(F.lit("note:"), "doc_id").alias("from_id"), F.concat(F.lit("note:"), other).alias("to_id"), F.lit(2.0).alias("confidence")
    )
    return lifecycle.audited_edges(t.edges(spark, d), new, visible(spark, d)).select("id", "from_id", "to_id")


@query("""WITH bad_note AS (SELECT id FROM note UNION ALL SELECT id FROM note WHERE doc_id % 50 = 0), bad_entity AS (SELECT canonical_name FROM entity UNION ALL SELECT canonical_name FROM entity WHERE CAST(substr(id, 8) AS BIGINT) % 5 = 0)
    SELECT 'repeated note ids' AS "check", count(*) AS problems FROM (SELECT id FROM bad_note GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'vectors of another size', count(*) FROM vec WHERE len(embedding) <> 64 OR CAST(substr(id, 6) AS BIGINT) % 40 = 0
    UNION ALL SELECT 'vectors without a note', count(*) FROM vec WHERE id NOT IN (SELECT id FROM note) UNION ALL SELECT 'edges from nowhere', count(*) FROM edge WHERE from_id NOT IN (SELECT id FROM note)
    UNION ALL SELECT 'edges to nowhere', count(*) FROM edge WHERE to_id NOT IN (SELECT id FROM note) UNION ALL SELECT 'edges to themselves', count(*) FROM edge WHERE from_id = to_id
    UNION ALL SELECT 'mentions of unknown entities', count(*) FROM mention WHERE entity_id NOT IN (SELECT id FROM entity) UNION ALL SELECT 'repeated entity names', count(*) FROM (SELECT canonical_name FROM bad_entity GROUP BY canonical_name HAVING count(*) > 1)
    UNION ALL SELECT 'hidden notes', count(*) FROM bad_note WHERE id NOT IN (SELECT id FROM visible)""", "note", "vec", "edge", "mention", "entity", "visible")
def doctor_report(spark, d):
    """Over tables with planted faults: repeated notes and entity names, and vectors that were cut."""
    notes, entities, vectors = t.notes(spark, d), t.entities(spark, d), t.vectors(spark, d)
    notes = notes.unionByName(notes.filter("doc_id % 50 = 0"))
    number = lambda c: F.regexp_extract(c, "[0-9]+", 0).cast("long")
    entities = entities.unionByName(entities.filter(number("id") % 5 == 0))
    vectors = vectors.withColumn("embedding", F.when(number("id") % 40 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")))
    return statistics.doctor(notes, visible(spark, d), t.edges(spark, d), t.mentions(spark, d), entities, vectors, 64)


@query("SELECT id, CAST(NULL AS VARCHAR) AS lease FROM note WHERE id NOT IN (SELECT id FROM vec) AND id IN (SELECT id FROM visible)", "note", "vec", "visible")
def widened_items(spark, d):
    return jobs.widened(visible(spark, d).select("id"), t.vectors(spark, d)).select("id", F.lit(None).cast("string").alias("lease"))


@query(r"""SELECT 'note:' || id AS id, substring(array_to_string(list_slice(string_split(trim(regexp_replace(list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '')[1], '\s+', ' ', 'g')), ' '), 1, 5), ' '), 1, 48) AS title,
    'sha256:' || sha256(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS content_hash FROM msg""", "msg")
def manual_notes(spark, d):
    return lifecycle.manual_notes(t.messages(spark, d).select("id", "content")).select("id", "title", "content_hash")


@query(f"WITH {ASKED}, {bm25_sql('msg', {'content': 1.0})}, firsts AS (SELECT query_id, id, score FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 5) SELECT query_id, f.id, m.role || ' message #' || (m.message_index + 1) AS title, c.source_uri FROM firsts f JOIN msg m ON m.id = f.id JOIN chat c ON c.id = m.conversation_id", "msg", "chat")
def message_hits(spark, d):
    found = retrieval.best_text(retrieval.bm25(text_queries(spark, d), t.messages(spark, d), {"content": 1.0}), 5)
    shaped = found.join(t.messages(spark, d), "id").join(t.chats(spark, d).select(F.col("id").alias("conversation_id"), "source_uri"), "conversation_id")
    return shaped.select("query_id", "id", retrieval.message_title(F.col("role"), F.col("message_index")).alias("title"), "source_uri")


@query(r"""WITH n AS (SELECT id, list_slice(regexp_extract_all(content, '\b[A-Z][a-z]+\b'), 1, 3) AS names FROM msg) SELECT DISTINCT id, unnest(names) AS name, 'organization' AS entity_type FROM n""", "msg")
def extracted_entities(spark, d):
    """A stand-in for a model: it names the first capitalised words, in fenced JSON."""

    def answer(text: str) -> str:
        import json
        import re

        names = re.findall(r"\b[A-Z][a-z]+\b", text, re.ASCII)[:3]
        return "Sure:\n```json\n" + json.dumps({"entities": [{"name": n, "type": "ORG"} for n in names]}) + "\n```"

    items = t.messages(spark, d).select("id", F.col("content").alias("text"))
    return jobs.extract_entities(items, answer, 0)


@query(f"WITH {ALIGN_SQL} SELECT w.source_id, count(*) AS chunks, count(v.embedding) AS reused FROM w LEFT JOIN al ON al.source_id = w.source_id AND al.new_ordinal = w.ordinal AND exact_content LEFT JOIN vec v ON v.id = 'note:' || al.old_ordinal GROUP BY w.source_id", "note", "vec")
def reused_vectors(spark, d):
    old, new = two_generations(spark, d)
    held = old.join(t.vectors(spark, d).select("id", "embedding"), "id").select("source_id", "ordinal", "embedding")
    found = chunking.reused_vectors(chunking.aligned_chunks(old.drop("id"), new), held, new)
    return found.groupBy("source_id").agg(F.count("*").alias("chunks"), F.count("embedding").alias("reused"))


@query()
def packing_report(spark, d):
    q = both_queries(spark, d)
    hits = retrieval.hybrid(q, t.notes(spark, d), t.vectors(spark, d), FIELDS, 20)
    rows = hits.join(t.notes(spark, d).select("id", "title", "content"), "id").join(q.select("query_id", "query"), "query_id")
    shaped = rows.select("query_id", "query", F.col("final_rank").alias("rank"), "id", F.lit("note").alias("hit_type"), "title", "content", F.col("fused_score").alias("score"))
    packed = packing.pack(shaped, packing.Packing(chunks=4, total=600))
    return packing.diagnostics(packed).join(packing.prompts(packed, shaped), "query_id").withColumn("prompt", F.octet_length("prompt"))
