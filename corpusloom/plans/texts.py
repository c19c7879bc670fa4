"""Registered queries over scalar rules: addresses, keys, titles, tokens, retries, and what models answer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from corpusloom.functions import extraction, lexical, uris
from corpusloom.functions import text as tx
from corpusloom.operators import jobs
from corpusloom.plans.registry import query
from corpusloom.sources import tables as t


def as_column(function, kind: str = "string"):
    """A plain function of one text as a vectorised column function."""

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(function)

    return run


@query("SELECT id, CASE doc_id % 4 WHEN 0 THEN 'file:///a%20b/' || doc_id || '.md' WHEN 1 THEN 'file:///C:/x/' || doc_id WHEN 2 THEN 'file://host/s/' || doc_id ELSE 'https://h/' || doc_id END AS uri, CASE doc_id % 4 WHEN 0 THEN '/a b/' || doc_id || '.md' END AS path FROM note", "note")
def file_addresses(spark, d):
    """Paths, Windows paths, network shares and web addresses in one form, and a path from its address."""
    k = F.col("doc_id")
    raw = F.when(k % 4 == 0, F.concat(F.lit("/docs/../a b/./"), k, F.lit(".md"))).when(k % 4 == 1, F.concat(F.lit("c:\\x\\"), k)).when(k % 4 == 2, F.concat(F.lit("\\\\Host\\s\\"), k)).otherwise(F.concat(F.lit("https://h/"), k))
    rows = t.notes(spark, d).select("id", "doc_id", as_column(uris.file_uri)(raw).alias("uri"))
    return rows.select("id", "uri", F.when(k % 4 == 0, tx.file_uri_path(F.col("uri"))).alias("path"))


@query("SELECT id, split_part(id, ':', 1) AS table_name, substr(id, strpos(id, ':') + 1) AS key FROM edge", "edge")
def record_parts(spark, d):
    return t.edges(spark, d).select("id", tx.record_table(F.col("id")).alias("table_name"), tx.record_key(F.col("id")).alias("key"))


@query(r"""SELECT id, CASE WHEN length(content) <= 60 THEN content ELSE (CASE WHEN regexp_extract(substring(content, 1, 60), '(?s)^(.*)\s\S*$', 1) <> '' THEN regexp_extract(substring(content, 1, 60), '(?s)^(.*)\s\S*$', 1) ELSE substring(content, 1, 60) END) || '...' END AS short,
    title || ' > part' || chr(10) || chr(10) || content AS search FROM note""", "note")
def shortened_texts(spark, d):
    """Cut at a word, and the search text of a chunk under two headings."""
    return t.notes(spark, d).select("id", tx.truncate_at_word(F.col("content"), 60).alias("short"), tx.search_content(F.col("content"), F.array("title", F.lit(""), F.lit("part"))).alias("search"))


LABELS = ("PER", "Organization", "gpe", "TIME", "thing", "loc")


@query("SELECT id, ['person', 'organization', 'location', 'date', 'concept', 'location', 'concept'][doc_id % 7 + 1] AS entity_type FROM note", "note")
def entity_types(spark, d):
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS], F.lit(None).cast("string")), (F.col("doc_id") % 7 + 1).cast("int"))
    return t.notes(spark, d).select("id", tx.entity_type(label).alias("entity_type"))


@query("SELECT id, ['https', 'http', 'grpc+tls'][doc_id % 3 + 1] || '://h' || doc_id || '.net:80' AS endpoint FROM note", "note")
def redacted_endpoints(spark, d):
    k = F.col("doc_id")
    scheme = F.element_at(F.array(*[F.lit(x) for x in ("https", "http", "grpc+tls")]), (k % 3 + 1).cast("int"))
    url = F.concat(scheme, F.lit("://"), F.when(k % 2 == 0, F.lit("user:pass@")).otherwise(""), F.lit("h"), k, F.lit(".net:80"), F.when(k % 5 == 0, "/v1?key=s").otherwise(""))
    return t.notes(spark, d).select("id", tx.redacted_endpoint(url).alias("endpoint"))


@query("SELECT id, CASE WHEN doc_id % 2 = 0 THEN 'a=1,b=' || doc_id ELSE 'a=1,b=0,c=' || doc_id END AS merged FROM note", "note")
def merged_metadata(spark, d):
    """Two objects as one; the second one's values count."""
    from corpusloom.operators import lifecycle

    k = F.col("doc_id").cast("string")
    new = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("b"), k)).otherwise(F.create_map(F.lit("c"), k))
    merged = lifecycle.merged_objects(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("0")), new)
    return t.notes(spark, d).select("id", F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("merged"))


@query("SELECT id, CASE WHEN message_index % 3 = 0 THEN 'uuid-' || message_index ELSE conversation_id || ':' || message_index END AS message_key FROM msg", "msg")
def message_keys(spark, d):
    i = F.col("message_index")
    uuid = F.when(i % 3 == 0, F.concat(F.lit("uuid-"), i)).when(i % 3 == 1, F.lit(""))
    return t.messages(spark, d).select("id", tx.message_key(uuid, F.col("conversation_id"), i).alias("message_key"))


@query(r"""WITH w AS (SELECT id, 'word:' || unnest(regexp_extract_all(replace(lower(content), 'ß', 'ss'), '[\p{L}\p{N}]+')) AS token FROM msg UNION ALL SELECT id, 'symbol:' || unnest(regexp_extract_all(content, '[^\p{L}\p{N}\s]')) FROM msg)
    SELECT id, token, count(*) AS n FROM w GROUP BY id, token""", "msg")
def token_multisets(spark, d):
    """What near copies are told by: case-folded words and symbols with their counts."""

    def run(batches):
        for pdf in batches:
            rows = [(i, token, n) for i, text in zip(pdf["id"], pdf["content"], strict=True) for token, n in lexical.token_counts(text or "").items()]
            yield pd.DataFrame(rows, columns=["id", "token", "n"])

    return t.messages(spark, d).select("id", "content").mapInPandas(run, "id string, token string, n long")


@query(r"""WITH w AS (SELECT DISTINCT id, unnest(regexp_extract_all(replace(lower(content), 'ß', 'ss'), '[\p{L}\p{N}]+')) AS token FROM msg), q AS (SELECT DISTINCT 'item:' || item_id AS query_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+')) AS token FROM benchmark WHERE item_id % 20 = 0)
    SELECT query_id, id, count(*) AS shared FROM q JOIN w USING (token) GROUP BY ALL HAVING count(*) >= 5""", "msg")
def shared_terms(spark, d):
    """Terms that a message shares with a query: what a snippet's sentence is chosen by."""

    def words(rows, key):
        def run(batches):
            for pdf in batches:
                found = [(k, token) for k, text in zip(pdf["k"], pdf["text"], strict=True) for token in lexical.token_set(text or "") if any(map(str.isalnum, token))]
                yield pd.DataFrame(found, columns=[key, "token"])

        return rows.mapInPandas(run, f"{key} string, token string")

    asked = words(t.read(spark, d, "benchmark").filter("item_id % 20 = 0").select(F.concat(F.lit("item:"), "item_id").alias("k"), "text"), "query_id")
    held = words(t.messages(spark, d).select(F.col("id").alias("k"), F.col("content").alias("text")), "id")
    return asked.join(held, "token").groupBy("query_id", "id").agg(F.count("*").alias("shared")).filter("shared >= 5")


@query("""WITH k AS (SELECT s_suppkey AS i, 'job' || s_suppkey AS key FROM supplier), a AS (SELECT unnest(generate_series(0, 5)) AS attempt),
    j AS (SELECT key, attempt, least(greatest(0.8 + 0.4 * ((list_sum(list_transform(string_split(key, ''), lambda c: ascii(c))) + 31 * attempt) % 101) / 100, 0.8), 1.2) AS jitter FROM k, a)
    SELECT key, CAST(attempt AS INT) AS attempt, round(least(0.25 * 2 ** attempt, 5.0) * jitter, 6) AS seconds FROM j""")
def retry_delays(spark, d):
    """Seconds before each attempt of each job."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(k, a, round(jobs.retry_delay(a, k), 6)) for k in pdf["key"] for a in range(6)], columns=["key", "attempt", "seconds"])

    return t.read(spark, d, "supplier").select(F.concat(F.lit("job"), "s_suppkey").alias("key")).mapInPandas(run, "key string, attempt int, seconds double")


@query("SELECT s_suppkey AS status, s_suppkey IN (408, 425, 429) OR s_suppkey >= 500 AS again FROM (SELECT CAST(350 + s_suppkey * 3 AS INT) AS s_suppkey FROM supplier)")
def retried_statuses(spark, d):
    status = t.read(spark, d, "supplier").select((350 + F.col("s_suppkey") * 3).cast("int").alias("status"))
    return status.select("status", as_column(jobs.retryable, "boolean")("status").alias("again"))


@query("""SELECT id, unnest(CASE message_index % 5 WHEN 0 THEN ['A' || conv_id, 'B'] WHEN 1 THEN ['C' || conv_id, 'D'] WHEN 2 THEN ['E' || conv_id] WHEN 3 THEN ['F' || conv_id, 'G'] ELSE [] END) AS name,
    unnest(CASE message_index % 5 WHEN 0 THEN ['person', 'concept'] WHEN 1 THEN ['concept', 'concept'] WHEN 2 THEN ['organization'] WHEN 3 THEN ['location', 'date'] ELSE [] END) AS entity_type FROM msg""", "msg")
def parsed_answers(spark, d):
    """Answers in fences, as plain lists, broken off, as objects by name, and without any JSON."""
    c, i = F.col("conv_id").cast("string"), F.col("message_index") % 5
    whole = F.concat(F.lit('Here:\n```json\n{"entities": [{"name": "A'), c, F.lit('", "type": "PER"}, {"entity": " B "}]}\n```\nDone.'))
    broken = F.concat(F.lit('{"entities": [{"name": "E'), c, F.lit('", "category": "org"}, {"name": "cut o'))
    named = F.concat(F.lit('Sure {"entities": {"F'), c, F.lit('": "LOC", "G": "date"}} and so on'))
    answer = F.when(i == 0, whole).when(i == 1, F.concat(F.lit('["C'), c, F.lit('", "D", "d"]'))).when(i == 2, broken).when(i == 3, named).otherwise(F.lit("none found"))

    def run(batches):
        for pdf in batches:
            rows = [(k, name, kind) for k, text in zip(pdf["id"], pdf["answer"], strict=True) for name, kind in extraction.parse(text)[0]]
            yield pd.DataFrame(rows, columns=["id", "name", "label"])

    found = t.messages(spark, d).select("id", answer.alias("answer")).mapInPandas(run, "id string, name string, label string")
    return found.select("id", "name", tx.entity_type(F.col("label")).alias("entity_type"))
