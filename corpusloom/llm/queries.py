"""The registered queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, divergence, exact_dedup, filter_audit, hard_negatives, html_text, mixing, near_join, pieces, quality, token_files, toxicity, warc
from corpusloom.llm.shared import table


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokens_through_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_classes(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_html_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, decode and hold the decoded text against the original."""
    return pieces.digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.classify(docs, docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op10_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.through_archives(table(spark, sf_dir, "pages"))
    field = F.col("metadata.fields")
    return captures.select(
        field["page-id"].cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        field["refers-to-page-id"].cast("long").alias("refers_to"),
        F.col("response.target_uri").alias("target_uri"),
    )


def op11_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth row is an anchor; every seventh gets the next label first."""
    key, label = F.col("vec_id"), F.col("label").cast("long")
    relabelled = F.when(key % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = hard_negatives.quantised(table(spark, sf_dir, "embeddings"), 256, key, relabelled, F.col("embedding"))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_files, op2_source_mixing, op3_distribution_divergence, op4_exact_dedup, op5_ngram_jaccard_join, op6_quality_classifier, op7_html_rendering, op8_sentencepiece, op9_toxicity, op10_warc_transactions, op11_winnowing_decontamination, op12_filter_audit, op13_hard_negatives)}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH b AS (
            SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               sha256(norm) AS text_sha256,
               n_chars
        FROM b
        WINDOW w AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id)""",
    "op11_winnowing_decontamination": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        i AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
        iw AS (
            SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS v
            FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p
                  FROM (SELECT *, least(10, len(w)) AS n FROM i WHERE len(w) > 0))),
        dw AS (
            SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS v
            FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p
                  FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
        hit AS (SELECT dw.r, dw.n, dw.p, iw.item_id FROM dw JOIN iw USING (n, v)),
        words AS (
            SELECT r, count(DISTINCT q) AS n_hit
            FROM (SELECT r, unnest(generate_series(p, p + n - 1)) AS q FROM hit) GROUP BY r),
        items AS (
            SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
            FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op12_filter_audit": r"""
        WITH t AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        f AS (
            SELECT part, doc_id,
                   [len(w) < 100,
                    100 * len(list_distinct(w)) < 80 * len(w),
                    100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text),
                    regexp_matches(text, '[#$%&*|]'),
                    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails
            FROM t),
        l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        g AS (
            SELECT f.part, f.fails, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
            FROM f LEFT JOIN l USING (doc_id)),
        one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS i),
        o AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS places
            FROM one a, one b, one c, one d, one e
            WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        s AS (SELECT filter_order, CAST(unnest([1, 2, 3, 4, 5]) AS INT) AS step, places FROM o),
        e AS (
            SELECT part, filter_order, step, places[step] AS place, good, toxic,
                   fails[places[step]] AS here,
                   len(list_filter(places[1:step - 1], lambda k: fails[k])) > 0 AS earlier,
                   len(list_filter(fails, lambda k: k)) AS failures
            FROM g, s),
        c AS (
            SELECT part, filter_order, step, place,
                   count(*) FILTER (NOT here AND NOT earlier) AS kept,
                   count(*) FILTER (here AND NOT earlier) AS removed,
                   count(*) FILTER (here AND earlier) AS redundant,
                   count(*) FILTER (here AND failures = 1) AS unique_fails,
                   count(*) FILTER (here AND NOT earlier AND good) AS good_lost,
                   count(*) FILTER (here AND NOT earlier AND toxic) AS toxic_lost
            FROM e GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, place) AS BIGINT) AS shapley
        FROM c""",
    "op13_hard_negatives": r"""
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (
            SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT anchor_id, positive_id,
               CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank,
               id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY rank <= 10""",
}
