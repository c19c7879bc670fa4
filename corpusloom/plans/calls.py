"""Registered queries over the calls of plans.search, and what they are made of."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import evaluation, graph, lifecycle, retrieval, scans
from corpusloom.operators.packing import Packing
from corpusloom.plans import queries as q
from corpusloom.plans import search as s
from corpusloom.plans.oracle import with_model
from corpusloom.plans.registry import SQL, query
from corpusloom.sources import storage
from corpusloom.sources import tables as t

NOW = datetime(2024, 1, 20)


def model(spark: SparkSession, d: str) -> s.Model:
    every = t.vectors(spark, d).select("id", "embedding").unionByName(t.message_vectors(spark, d)).unionByName(t.chat_vectors(spark, d))
    return s.Model(t.notes(spark, d), t.sources(spark, d), every, t.messages(spark, d), t.chats(spark, d), t.entities(spark, d), t.mentions(spark, d), t.edges(spark, d), t.proposals(spark, d))


def shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "id", "hit_type", F.round("score", 6).alias("score"), "title", "source_uri", "final_rank")


SHAPED = """shaped AS (SELECT n.id, n.title, s.uri AS source_uri FROM note n LEFT JOIN src s ON s.id = n.source_id UNION ALL SELECT m.id, m.role || ' message #' || (m.message_index + 1), c.source_uri FROM msg m JOIN chat c ON c.id = m.conversation_id
    UNION ALL SELECT id, coalesce(nullif(trim(title), ''), 'Conversation ' || uuid), source_uri FROM chat)"""


def ranked_sql(union: str, keep: str = "true") -> str:
    return f"""{SHAPED}, merged AS ({union}), pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, best, k, id) AS r FROM merged QUALIFY r <= 50),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, best, k, id) AS final_rank FROM pool WHERE {keep} QUALIFY final_rank <= 10)
    SELECT r.query_id, r.id, hit_type, round(score, 6) AS score, title, source_uri, final_rank FROM ranked r JOIN shaped USING (id)"""


NOTE_PART = "SELECT query_id, id, 'note' AS hit_type, 0 AS k, fused AS score, best FROM fused_n"
MESSAGE_PART = "SELECT query_id, id, 'message' AS hit_type, 1 AS k, fused AS score, best FROM fused_m"
SUMMARY_PART = "SELECT query_id, id, 'summary' AS hit_type, 2 AS k, fused AS score, best FROM fused_s"
MESSAGES = q.hybrid_sql("msg", "mvec", {"content": 1.0}, 50, x="m")
SUMMARIES = q.hybrid_sql("chat", "cvec", q.SUMMARY_FIELDS, 50, x="s")
NAMED = "(id IN (SELECT note_id FROM mention WHERE entity_id IN (SELECT id FROM entity WHERE contains(canonical_name, 'nation_1'))))"


@query(f"""WITH {q.ASKED}, elig AS (SELECT * FROM visible WHERE created_at >= TIMESTAMP '2024-01-05' AND source_id IN (SELECT id FROM src WHERE uri = 'fixture://src2')), ev AS (SELECT * FROM vec WHERE id IN (SELECT id FROM elig)),
    {q.hybrid_sql('elig', 'ev', q.FIELDS, 50)}, {ranked_sql(NOTE_PART, NAMED)}""", "visible", "vec", "src", "msg", "chat", "mention", "entity")
def filtered_search(spark, d):
    """Notes of a source, of the last fifteen days, that mention an entity: ranked again after the filter."""
    how = s.Search(scope="notes", use_graph="off", since_days=15, source_uri="fixture://src2", entity=" Nation_1")
    return shown(s.search(model(spark, d), q.both_queries(spark, d), how, NOW))


@query(f"WITH {q.ASKED}, {MESSAGES}, {ranked_sql(MESSAGE_PART)}", "msg", "mvec", "vec", "note", "src", "chat")
def message_search(spark, d):
    return shown(s.search(model(spark, d), q.both_queries(spark, d), s.Search(scope="messages", use_graph="off"), NOW))


@query(f"WITH {q.ASKED}, {q.hybrid_sql('visible', 'vv', q.FIELDS, 50)}, {MESSAGES}, {SUMMARIES}, {ranked_sql(f'{NOTE_PART} UNION ALL {MESSAGE_PART} UNION ALL {SUMMARY_PART}')}".replace("WITH ", "WITH vv AS (SELECT * FROM vec WHERE id IN (SELECT id FROM visible)), ", 1), "visible", "vec", "msg", "mvec", "chat", "cvec", "src")
def search_everything(spark, d):
    return shown(s.search(model(spark, d), q.both_queries(spark, d), s.Search(scope="all", use_graph="off"), NOW))


@query()
def search_with_graph(spark, d):
    """Entity seeds and hits start walks over the links; graph hits come beside the others."""
    asked = q.entity_queries(spark, d).withColumn("embedding", F.lit(None).cast("array<float>"))
    return shown(s.search(model(spark, d), asked, s.Search(scope="all", use_graph="on"), NOW))


@query()
def augmented_context(spark, d):
    """Packed contexts over everything, from search to snippets."""
    out = s.augment(model(spark, d), q.both_queries(spark, d), s.Search(scope="all", use_graph="off"), now=NOW)
    return out.select("query_id", "id", "citation", "reason", "tokens")


@query(f"WITH {q.TEXT_QUERY} SELECT query_id, CAST(0 AS BIGINT) AS chunks, 'no budget' AS state FROM tq")
def context_of_no_budget(spark, d):
    """Why the context of each benchmark text is empty."""
    queries, budget = q.both_queries(spark, d), Packing(total=0)
    return s.context_states(queries, s.augment(model(spark, d), queries, s.Search(use_graph="off"), budget, NOW), budget)


def knn_sql(vectors: str) -> str:
    return f"WITH {q.VECTOR_QUERY}, k AS (SELECT query_id, v.id, 1 - list_cosine_similarity(q.embedding, v.embedding) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(1 - list_cosine_similarity(q.embedding, v.embedding), 9), v.id) AS rank FROM vq q, {vectors} v QUALIFY rank <= 10) SELECT query_id, id, round(distance, 6) AS distance, rank FROM k"


@query(knn_sql("mvec"), "vec", "mvec")
def knn_messages(spark, d):
    return retrieval.knn(q.vector_queries(spark, d), t.message_vectors(spark, d), 10).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@query(knn_sql("cvec"), "vec", "cvec")
def knn_summaries(spark, d):
    return retrieval.knn(q.vector_queries(spark, d), t.chat_vectors(spark, d), 10).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


FUSED = f"{q.ASKED}, {q.hybrid_sql('note', 'vec', q.FIELDS, 10)}"


def fused_notes(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hybrid(q.both_queries(spark, d), t.notes(spark, d), t.vectors(spark, d), q.FIELDS, 10)


@query(f"WITH {FUSED} SELECT query_id, f.id, final_rank, n.title, n.content, array_to_string(n.tags, ',') AS tags, round(coalesce(score, 0), 6) AS text_score FROM fused_n f JOIN note n ON n.id = f.id", "note", "vec")
def fused_payload(spark, d):
    """Hits with what they show, whichever channel found them."""
    found = retrieval.with_payload(fused_notes(spark, d), t.notes(spark, d), ["title", "content", "tags"])
    return found.select("query_id", "id", "final_rank", "title", "content", F.array_join("tags", ",").alias("tags"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("text_score"))


@query(f"""WITH {FUSED} SELECT query_id, id, format('#{{}} {{}} {{:.4f}}: ', final_rank, id, fused + 1e-9) || concat_ws(', ', CASE WHEN vr IS NOT NULL THEN format('vector #{{}} ({{:.4f}})', vr, greatest(distance, 0)) END, CASE WHEN tr IS NOT NULL THEN format('text #{{}} ({{:.4f}})', tr, score) END) AS explanation FROM fused_n""", "note", "vec")
def explained_hits(spark, d):
    """Why each hit is there: its channels, ranks and scores."""
    hits = fused_notes(spark, d).withColumn("text_score", F.col("score")).withColumn("score", F.col("fused_score"))
    return retrieval.explained(hits).select("query_id", "id", "explanation")


@query(f"""WITH {FUSED}, ends AS (SELECT from_id AS note_id, to_id AS other, edge_type || ':out' AS b FROM visible_edge UNION ALL SELECT to_id, from_id, edge_type || ':in' FROM visible_edge)
    SELECT query_id, f.id, coalesce(array_to_string(list_sort(list(DISTINCT other) FILTER (WHERE b = 'supports:out')), ','), '') AS supporting, coalesce(array_to_string(list_sort(list(DISTINCT other) FILTER (WHERE b = 'related_to:in')), ','), '') AS related_from
    FROM fused_n f LEFT JOIN ends e ON e.note_id = f.id GROUP BY query_id, f.id""", "note", "vec", "visible_edge")
def hits_with_related(spark, d):
    hits = s.related(model(spark, d), fused_notes(spark, d))
    return hits.select("query_id", "id", *[F.coalesce(F.array_join(c, ","), F.lit("")).alias(c) for c in ("supporting", "related_from")])


@query("SELECT id, edge_type, from_id, to_id FROM visible_edge WHERE from_id = 'note:12' OR to_id = 'note:12'", "visible_edge")
def edges_of_a_note(spark, d):
    ends = graph.both_directions(scans.visible_edges(t.edges(spark, d), q.visible(spark, d))).filter("note_id = 'note:12'")
    out = F.col("direction") == "out"
    return ends.select("id", "edge_type", F.when(out, F.col("note_id")).otherwise(F.col("other_id")).alias("from_id"), F.when(out, F.col("other_id")).otherwise(F.col("note_id")).alias("to_id"))


def one_way_sql(direction: str) -> str:
    keep = "SELECT from_id AS a, to_id AS b, id AS edge_id, edge_type, confidence FROM visible_edge" if direction == "out" else "SELECT to_id AS a, from_id AS b, id AS edge_id, edge_type, confidence FROM visible_edge"
    return f"""WITH ends AS (SELECT * FROM ({keep}) WHERE coalesce(confidence, 1.0) >= 0.3 AND edge_type IN ('supports', 'related_to')), seeds AS (SELECT id FROM visible WHERE doc_id % 20 = 0),
    moves AS (SELECT s.id AS query_id, e.b AS id, 0.03 * 0.8 * least(greatest(coalesce(e.confidence, 1.0), 0), 1) AS score, e.edge_id, row_number() OVER (PARTITION BY s.id, e.edge_type ORDER BY e.confidence DESC NULLS LAST, e.edge_id) AS per_table FROM seeds s JOIN ends e ON e.a = s.id WHERE e.b <> s.id),
    fan AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, edge_id, id) AS per_node FROM moves WHERE per_table <= 8), st AS (SELECT * FROM fan WHERE per_node <= 8 QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY round(score, 9) DESC, edge_id) = 1)"""


def one_way(spark: SparkSession, d: str, outbound: bool) -> DataFrame:
    v = q.visible(spark, d)
    how = graph.Expansion(outbound=outbound, inbound=not outbound, least_confidence=0.3, edge_types=("supports", "related_to"))
    return graph.expand(q.note_seeds(spark, d, 20), scans.visible_edges(t.edges(spark, d), v), how)


@query(one_way_sql("out") + " SELECT query_id, id, round(score, 6) AS score, edge_id AS path FROM st UNION ALL SELECT id, id, 0.03, '' FROM seeds", "visible_edge", "visible")
def outbound_links(spark, d):
    found = one_way(spark, d, True)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.array_join(F.transform("path", lambda x: x["edge_id"]), ",").alias("path"))


@query(one_way_sql("in") + " SELECT query_id, id, round(score, 6) AS score, edge_id AS path FROM st UNION ALL SELECT id, id, 0.03, '' FROM seeds", "visible_edge", "visible")
def inbound_links(spark, d):
    found = one_way(spark, d, False)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.array_join(F.transform("path", lambda x: x["edge_id"]), ",").alias("path"))


@query(one_way_sql("out") + """, hit AS (SELECT id AS query_id, 'note:' || (doc_id + 3) AS id, 0.5 AS score FROM visible WHERE doc_id % 20 = 0 UNION ALL SELECT id, id, 0.4 FROM visible WHERE doc_id % 20 = 0),
    found AS (SELECT query_id, id, score, 1 AS hops FROM st UNION ALL SELECT id, id, 0.03, 0 FROM seeds)
    SELECT coalesce(h.query_id, f.query_id) AS query_id, coalesce(h.id, f.id) AS id, round(coalesce(h.score, f.score * 0.9), 6) AS score, round(f.score, 6) AS graph_score, CAST(hops AS INT) AS hops FROM hit h FULL JOIN found f ON h.query_id = f.query_id AND h.id = f.id""", "visible_edge", "visible")
def graph_merged_hits(spark, d):
    """Hits keep their score and gain the graph's; what only the graph has is added with a weight."""
    seeds = q.visible(spark, d).filter("doc_id % 20 = 0")
    hits = seeds.select(F.col("id").alias("query_id"), F.concat(F.lit("note:"), F.col("doc_id") + 3).alias("id"), F.lit(0.5).alias("score")).unionByName(seeds.select(F.col("id").alias("query_id"), "id", F.lit(0.4).alias("score")))
    both = graph.merge_hits(hits, one_way(spark, d, True), 0.9)
    return both.select("query_id", "id", F.round("score", 6).alias("score"), F.round("graph_score", 6).alias("graph_score"), "hops")


@query(one_way_sql("out") + """, found AS (SELECT query_id, id, 1 AS hops FROM st UNION ALL SELECT id, id, 0 FROM seeds)
    SELECT query_id, count(*) AS candidates, count(*) FILTER (WHERE CAST(substr(id, 6) AS BIGINT) % 2 = 0) AS selected, count(*) FILTER (WHERE CAST(substr(id, 6) AS BIGINT) % 2 = 1) AS dropped, CAST(max(hops) AS INT) AS hops, CAST(1 AS BIGINT) AS seeds FROM found GROUP BY query_id""", "visible_edge", "visible")
def graph_summaries(spark, d):
    found = one_way(spark, d, True)
    return s.graph_summary(found, found.filter(F.regexp_extract("id", "[0-9]+", 0).cast("long") % 2 == 0))


def hop_sql(n: int, fanout: int = 3, candidates: int = 6) -> str:
    """From front_(n-1) and kept_(n-1) to front_n and kept_n: bounded moves, best states, best candidates."""
    m = n - 1
    return f"""move_{n} AS (SELECT f.query_id, f.id AS here, e.b AS id, f.score * 0.8 * least(greatest(coalesce(e.confidence, 1.0), 0), 1) AS score, e.edge_id, f.seed_id, list_append(f.path, e.edge_id) AS path, list_append(f.visited, e.b) AS visited,
        row_number() OVER (PARTITION BY f.query_id, f.id, e.edge_type ORDER BY e.confidence DESC NULLS LAST, e.edge_id) AS per_table FROM front_{m} f JOIN ends e ON e.a = f.id WHERE NOT list_contains(f.visited, e.b)),
    fan_{n} AS (SELECT * FROM move_{n} WHERE per_table <= {fanout} QUALIFY row_number() OVER (PARTITION BY query_id, here ORDER BY round(score, 9) DESC, edge_id, id) <= {fanout}),
    state_{n} AS (SELECT query_id, id, score, seed_id, path, visited, {n} AS hops FROM fan_{n} QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY round(score, 9) DESC, edge_id) = 1),
    best_{n} AS (SELECT * FROM (SELECT * FROM kept_{m} UNION ALL SELECT * FROM state_{n}) QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY round(score, 9) DESC, path, seed_id) = 1),
    kept_{n} AS (SELECT * FROM best_{n} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path, seed_id, id) <= {candidates}),
    front_{n} AS (SELECT * FROM state_{n} WHERE (query_id, id) IN (SELECT (query_id, id) FROM kept_{n}))"""


@query(f"""WITH ends AS (SELECT from_id AS a, to_id AS b, id AS edge_id, edge_type, confidence FROM visible_edge UNION ALL SELECT to_id, from_id, id, edge_type, confidence FROM visible_edge),
    front_0 AS (SELECT id AS query_id, id, 0.03 AS score, id AS seed_id, CAST([] AS VARCHAR[]) AS path, [id] AS visited, 0 AS hops FROM visible WHERE doc_id % 10 = 0), kept_0 AS (SELECT * FROM front_0), {hop_sql(1)}, {hop_sql(2)}
    SELECT query_id, id, round(score, 6) AS score, CAST(hops AS INT) AS hops, array_to_string(path, ',') AS path FROM kept_2""", "visible_edge", "visible")
def two_hops_from_notes(spark, d):
    """Two hops with little fanout and few candidates, so that every bound cuts."""
    v = q.visible(spark, d)
    found = graph.expand(q.note_seeds(spark, d, 10), scans.visible_edges(t.edges(spark, d), v), graph.Expansion(hops=2, fanout=3, candidates=6))
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "hops", F.array_join(F.transform("path", lambda x: x["edge_id"]), ",").alias("path"))


@query("""WITH ends AS (SELECT from_id AS a, to_id AS b, id AS edge_id, edge_type, confidence FROM visible_edge UNION ALL SELECT to_id, from_id, id, edge_type, confidence FROM visible_edge),
    few AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY a, edge_type, b ORDER BY confidence DESC NULLS LAST, edge_id) <= 2)
    SELECT a AS note_id, edge_type, count(*) AS n, string_agg(edge_id, ',' ORDER BY confidence DESC NULLS LAST, edge_id) AS edges FROM (SELECT * FROM few QUALIFY row_number() OVER (PARTITION BY a, edge_type ORDER BY confidence DESC NULLS LAST, edge_id) <= 6) GROUP BY ALL""", "visible_edge", "visible")
def bounded_adjacency(spark, d):
    """Per note and type the edges that steps with a fanout of 2 can take, in their order."""
    found = graph.adjacency(scans.visible_edges(t.edges(spark, d), q.visible(spark, d)), graph.Expansion(fanout=2))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("confidence").isNull().alias("a"), (-F.coalesce("confidence", F.lit(0.0))).alias("b"), F.col("edge_id").alias("c"))))
    return found.groupBy(F.col("__from").alias("note_id"), "edge_type").agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda x: x["c"]), ",").alias("edges"))


@query(f"""WITH ends AS (SELECT from_id AS a, to_id AS b, id AS edge_id, edge_type, confidence FROM visible_edge UNION ALL SELECT to_id, from_id, id, edge_type, confidence FROM visible_edge),
    front_0 AS (SELECT id AS query_id, id, 0.03 AS score, id AS seed_id, CAST([] AS VARCHAR[]) AS path, [id] AS visited, 0 AS hops FROM visible WHERE doc_id % 10 = 0), kept_0 AS (SELECT * FROM front_0), {hop_sql(1)}, {hop_sql(2)}
    SELECT query_id, id, round(score, 6) AS score, CAST(hops AS INT) AS hops, array_to_string(path, ',') AS path FROM kept_2""", "visible_edge", "visible")
def two_hops_by_adjacency(spark, d):
    """The two hops again, over the bounded adjacency of all notes."""
    v = q.visible(spark, d)
    how = graph.Expansion(hops=2, fanout=3, candidates=6)
    edges = scans.visible_edges(t.edges(spark, d), v)
    found = graph.expand(q.note_seeds(spark, d, 10), edges, how, adjacent=storage.written(graph.adjacency(edges, how), "graph-adjacency"))
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "hops", F.array_join(F.transform("path", lambda x: x["edge_id"]), ",").alias("path"))


def seeds_sql(most: int) -> str:
    """The seed notes of each query, coverage first: chosen (query_id, note_id)."""
    return f"""{q.PAGE_SQL}, c1 AS (SELECT query_id, note_id FROM pages WHERE entity_rank = 1 AND page_rank = 1),
    c2 AS (SELECT query_id, note_id FROM pages WHERE entity_rank = 2 AND (query_id, note_id) NOT IN (SELECT (query_id, note_id) FROM c1) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY page_rank) = 1),
    d2 AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2), c3 AS (SELECT query_id, note_id FROM pages WHERE entity_rank = 3 AND (query_id, note_id) NOT IN (SELECT (query_id, note_id) FROM d2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY page_rank) = 1),
    d3 AS (SELECT * FROM d2 UNION ALL SELECT * FROM c3), c4 AS (SELECT query_id, note_id FROM pages WHERE entity_rank = 4 AND (query_id, note_id) NOT IN (SELECT (query_id, note_id) FROM d3) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY page_rank) = 1),
    d4 AS (SELECT * FROM d3 UNION ALL SELECT * FROM c4), rest AS (SELECT query_id, note_id, min(entity_rank * 1000 + page_rank) AS o FROM pages WHERE (query_id, note_id) NOT IN (SELECT (query_id, note_id) FROM d4) GROUP BY ALL),
    chosen AS (SELECT query_id, note_id FROM (SELECT query_id, note_id, 0 AS o FROM d4 UNION ALL SELECT * FROM rest) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY o) <= {most})"""


@query(f"WITH {seeds_sql(6)} SELECT query_id, note_id, CAST(min(entity_rank) AS INT) AS entity_rank FROM pages WHERE (query_id, note_id) IN (SELECT (query_id, note_id) FROM chosen) GROUP BY ALL", "entity", "mention", "visible")
def coverage_seeds(spark, d):
    """A new note for each entity first, then the others in order."""
    matches = graph.entity_matches(q.entity_queries(spark, d), t.entities(spark, d), 4)
    return graph.pick_seeds(graph.seed_pages(matches, t.mentions(spark, d), q.visible(spark, d), 12), 6)


SQL["graph_two_hop"] = with_model(
    f"""WITH {seeds_sql(12)}, ends AS (SELECT from_id AS a, to_id AS b, id AS edge_id, edge_type, confidence FROM visible_edge UNION ALL SELECT to_id, from_id, id, edge_type, confidence FROM visible_edge),
    front_0 AS (SELECT query_id, note_id AS id, 0.03 AS score, note_id AS seed_id, CAST([] AS VARCHAR[]) AS path, [note_id] AS visited, 0 AS hops FROM chosen), kept_0 AS (SELECT * FROM front_0), {hop_sql(1, 8, 32)}, {hop_sql(2, 8, 32)}
    SELECT query_id, id, round(score, 6) AS score, CAST(hops AS INT) AS hops, seed_id, array_to_string(path, ',') AS path FROM kept_2""",
    "entity", "mention", "visible", "visible_edge",
)


NEW_SQL = f"{q.GARDEN_SQL}, keyed AS (SELECT least(from_id, to_id) AS a, greatest(from_id, to_id) AS b, s FROM suggested)"


@query(f"""WITH {NEW_SQL} SELECT from_id, to_id, status, round(CASE WHEN status = 'pending' AND s IS NOT NULL THEN s ELSE confidence END, 6) AS confidence FROM proposal p LEFT JOIN keyed k ON k.a = least(p.from_id, p.to_id) AND k.b = greatest(p.from_id, p.to_id)
    UNION ALL SELECT a, b, 'pending', round(least(s, 1), 6) FROM keyed WHERE (a, b) NOT IN (SELECT (least(from_id, to_id), greatest(from_id, to_id)) FROM proposal)""", "vec", "visible", "visible_edge", "proposal")
def gardened_proposals(spark, d):
    return s.garden(model(spark, d), 0.2).select("from_id", "to_id", "status", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {NEW_SQL}, fresh AS (SELECT * FROM keyed WHERE (a, b) NOT IN (SELECT (least(from_id, to_id), greatest(from_id, to_id)) FROM proposal))
    SELECT (SELECT count(*) FROM lone) AS orphans, (SELECT count(*) FROM suggested) AS suggestions, (SELECT count(*) FROM fresh) AS new_proposals, (SELECT count(*) FROM proposal WHERE status = 'pending') + (SELECT count(*) FROM fresh) AS pending_proposals""", "vec", "visible", "visible_edge", "proposal")
def maintenance_report(spark, d):
    return s.maintenance(model(spark, d), 0.2)


@query("SELECT id, CASE WHEN id = 'proposed_edge:000001' THEN 'accepted' ELSE status END AS status FROM proposal WHERE id <> 'proposed_edge:000001' OR (from_id IN (SELECT id FROM visible) AND to_id IN (SELECT id FROM visible))", "proposal", "visible")
def applied_connection(spark, d):
    """One proposal accepted by itself, the others as they were."""
    p = t.proposals(spark, d)
    one = lifecycle.acceptance(p.filter("id = 'proposed_edge:000001'"), q.visible(spark, d), t.edges(spark, d)).filter("status = 'accepted'")
    return p.filter("id <> 'proposed_edge:000001'").select("id", "status").unionByName(one.select("id", "status"))


@query(f"""WITH {q.ASKED}, vv AS (SELECT * FROM vec WHERE id IN (SELECT id FROM visible)), {q.hybrid_sql('visible', 'vv', q.FIELDS, 50)}, top AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC, best, id) AS rank FROM fused_n QUALIFY rank <= 10),
    rel AS (SELECT 'item:' || (doc_id % 40) AS query_id, id, 1 + doc_id % 2 AS grade FROM note), idl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS p FROM rel),
    tot AS (SELECT query_id, count(*) AS relevant, sum((2.0 ** grade - 1) / log2(p + 1)) FILTER (WHERE p <= 10) AS idcg FROM idl GROUP BY query_id),
    hit AS (SELECT k.query_id, count(*) AS found, min(rank) AS first, sum((2.0 ** grade - 1) / log2(rank + 1)) AS dcg FROM top k JOIN rel r ON r.query_id = k.query_id AND r.id = k.id GROUP BY k.query_id)
    SELECT t.query_id AS case_id, round(coalesce(found, 0) / relevant, 6) AS recall, round(coalesce(1.0 / first, 0), 6) AS reciprocal_rank, round(coalesce(dcg, 0) / idcg, 6) AS ndcg FROM tot t LEFT JOIN hit h ON h.query_id = t.query_id""", "visible", "vec", "note")
def evaluated_search(spark, d):
    """Metrics of a whole search run over cases."""
    k = F.col("doc_id")
    given = t.notes(spark, d).select(F.concat(F.lit("item:"), k % 40).alias("case_id"), "id", (1 + k % 2).alias("grade"))
    out = s.evaluate(model(spark, d), q.both_queries(spark, d), given, s.Search(scope="notes", use_graph="off"))
    return out.select("case_id", *[F.round(m, 6).alias(m) for m in evaluation.METRICS if m != "precision"])
