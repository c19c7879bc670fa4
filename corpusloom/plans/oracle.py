"""The model of sources.tables as SQL, for checking queries against another engine."""

from __future__ import annotations

CTES = {
    "note": """SELECT 'note:' || doc_id AS id, concat_ws(' ', lang, source) AS title, text AS content, [lang] AS tags,
        'source:' || source AS source_id,
        CAST(CASE WHEN doc_id % 7 = 0 THEN 0 WHEN doc_id % 7 <> 1 THEN 1 END AS BIGINT) AS source_generation,
        doc_id % 10 AS chunk_ordinal, TIMESTAMP '2024-01-01' + to_hours(doc_id) AS created_at, doc_id FROM documents""",
    "vec": "SELECT 'note:' || vec_id AS id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings",
    "src": """SELECT 'source:' || source AS id, 'fixture://' || source AS uri, CAST(1 AS BIGINT) AS successful_generation,
        CAST(CASE WHEN CAST(substr(source, 4) AS BIGINT) % 4 = 0 THEN 2 ELSE 1 END AS BIGINT) AS generation,
        CASE WHEN CAST(substr(source, 4) AS BIGINT) % 4 = 0 THEN 'pending' ELSE 'ready' END AS status,
        TIMESTAMP '2024-01-01' + to_hours(CAST(substr(source, 4) AS BIGINT)) AS created_at
        FROM documents GROUP BY source""",
    "visible": "SELECT n.* FROM note n LEFT JOIN src s ON s.id = n.source_id WHERE n.source_id IS NULL OR n.source_generation IS NULL OR n.source_generation = s.successful_generation",
    "msg": """SELECT 'message:' || conv_id || ':' || turn AS id, 'conversation:' || conv_id AS conversation_id, turn AS message_index,
        CASE WHEN role = 'user' THEN 'human' ELSE role END AS role, text AS content,
        TIMESTAMP '2024-01-01' + to_hours(conv_id * 24 + turn) AS created_at, conv_id FROM conversations""",
    "chat": """SELECT conversation_id AS id, 'chat-' || conv_id AS uuid, 'Chat ' || conv_id AS title,
        arg_min(content, message_index) FILTER (WHERE role = 'assistant') AS summary, count(*) AS messages,
        max(created_at) AS updated_at, 'fixture://chat/' || (conv_id % 5) AS source_uri FROM msg GROUP BY conversation_id, conv_id""",
    "mvec": "SELECT m.id, v.embedding FROM msg m JOIN vec v ON v.id = 'note:' || ((conv_id * 31 + message_index) % (SELECT count(*) FROM vec))",
    "cvec": "SELECT c.id, v.embedding FROM chat c JOIN vec v ON v.id = 'note:' || ((CAST(split_part(c.id, ':', 2) AS BIGINT) * 17 + 3) % (SELECT count(*) FROM vec))",
    "job": """SELECT 'job:' || s_suppkey AS id, ['pending', 'running', 'failed', 'cancelled', 'completed'][s_suppkey % 5 + 1] AS status,
        CASE s_suppkey % 3 WHEN 0 THEN 'worker-a' WHEN 1 THEN 'worker-b' END AS lease_owner,
        CASE WHEN s_suppkey % 3 <> 2 THEN TIMESTAMP '2024-01-01' + to_hours(s_suppkey) END AS lease_expires_at FROM supplier""",
    "entity": """SELECT 'entity:' || n_nationkey AS id, n_name AS name, lower(trim(n_name)) AS canonical_name,
        [lower(trim(r_name)) || ' ' || lower(trim(n_name))] AS aliases FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "mention": """SELECT DISTINCT 'note:' || doc_id AS note_id, 'entity:' || nation AS entity_id FROM (
        SELECT doc_id, doc_id % 25 AS nation FROM documents WHERE doc_id % 4 <> 3
        UNION ALL SELECT doc_id, doc_id * 7 % 25 FROM documents WHERE doc_id % 3 = 0)""",
    "raw_edge": """SELECT doc_id AS k, 'supports' AS edge_type, doc_id AS f, (doc_id * 7 + 3) % n AS t FROM documents, (SELECT count(*) AS n FROM documents) WHERE doc_id % 2 = 0
        UNION ALL SELECT doc_id, 'contradicts', doc_id, (doc_id * 5 + 1) % n FROM documents, (SELECT count(*) AS n FROM documents) WHERE doc_id % 3 = 0
        UNION ALL SELECT doc_id, 'related_to', least(doc_id, (doc_id * 11 + 5) % n), greatest(doc_id, (doc_id * 11 + 5) % n) FROM documents, (SELECT count(*) AS n FROM documents) WHERE doc_id % 4 = 0
        UNION ALL SELECT doc_id, 'derived_from', doc_id, doc_id // 2 FROM documents WHERE doc_id % 5 = 0""",
    "edge": """SELECT edge_type || ':' || k AS id, edge_type, 'note:' || f AS from_id, 'note:' || t AS to_id,
        CASE WHEN k % 6 <> 0 THEN CAST(k % 100 AS DOUBLE) / 100.0 END AS confidence FROM raw_edge WHERE f <> t""",
    "visible_edge": "SELECT * FROM edge WHERE from_id IN (SELECT id FROM visible) AND to_id IN (SELECT id FROM visible)",
    "proposal": """SELECT format('proposed_edge:{:06d}', s_suppkey) AS id, 'note:' || least(a, b) AS from_id, 'note:' || greatest(a, b) AS to_id,
        'related_to' AS edge_type, CAST(s_suppkey % 50 AS DOUBLE) / 100.0 + 0.5 AS confidence,
        CASE WHEN s_suppkey % 5 = 0 THEN 'manual' ELSE 'gardener-similarity' END AS generator,
        ['pending', 'pending', 'accepted', 'rejected', 'superseded'][s_suppkey % 5 + 1] AS status,
        CASE WHEN s_suppkey % 10 = 2 THEN 'related_to:' || s_suppkey END AS resulting_edge_id
        FROM (SELECT s_suppkey, s_suppkey * 13 % n AS a, (s_suppkey * 29 + 7) % n AS b FROM supplier, (SELECT count(*) AS n FROM documents)) WHERE a <> b""",
}
NEEDS = {
    "visible": ("note", "src"),
    "chat": ("msg",),
    "mvec": ("msg", "vec"),
    "cvec": ("chat", "vec"),
    "edge": ("raw_edge",),
    "visible_edge": ("edge", "visible"),
}


def with_model(sql: str, *names: str) -> str:
    """``sql`` after the common table expressions that it names, and what those need."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in NEEDS.get(name, ()):
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    if not order:
        return sql
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in order)
    joiner = ", " if sql.lstrip().startswith("WITH ") else " "
    return f"WITH {head}{joiner}{sql.lstrip()[5:] if joiner == ', ' else sql}"
