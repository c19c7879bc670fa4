"""Vector and full-text retrieval, rank fusion and scoped ranking, for one query or many.

Vectors are compared exactly: blocks of queries meet the corpus in matrix products, which
return their best rows per query only. Full text reads the texts twice, all fields at a
time: for document frequencies and lengths, and for the postings of the terms that some
query has.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.blocks import NEAR_SCHEMA, SLICE, Best, Nearest, unit_column
from corpusloom.operators.scans import SENT_ROWS, first_per
from corpusloom.operators.vector_index import VectorIndex
from corpusloom.sources.storage import written

#: Queries of a block, and blocks that are sent to all tasks at most; numbers that a task keeps for its queries at most.
QUERY_BLOCK, SENT_BLOCKS, SENT_NUMBERS = 512, 128, 8_000_000


def folds() -> dict[str, str]:
    """Small Latin letters with marks, and the ASCII letter that decomposition leaves of each."""
    small = [chr(c) for c in (*range(0xDF, 0x250), *range(0x1E00, 0x1F00)) if chr(c).islower()]
    parts = {c: unicodedata.normalize("NFD", c) for c in small}
    return {c: d[0] for c, d in parts.items() if len(d) > 1 and d[0].isascii() and all(map(unicodedata.combining, d[1:]))}


MARKED, PLAIN = "".join(folds()), "".join(folds().values())
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Fusion:
    strategy: str = "rrf"
    k: int = 60
    vector_weight: float = 0.7
    text_weight: float = 0.3


def pool_size(limit: int) -> int:
    """How many candidates each channel gives."""
    return min(max(limit * 4, 50), 200)


def knn(queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool = False, least: float | None = None) -> DataFrame:
    """query_id, id, distance (1 - cosine), rank of the k nearest rows of each query.

    ``queries`` (query_id, embedding) whose vectors and k rows are SENT_NUMBERS numbers at
    most are sent to all tasks in blocks, and meet ``corpus`` (id, embedding) in one scan.
    For more, the corpus is put in blocks round pivots, and only pairs of blocks that may
    hold a near row meet. Either way a task leaves its k best rows per query only.
    """
    asked = queries.filter(F.size("embedding") > 0)
    size = asked.agg(F.count("*").alias("rows"), F.max(F.size("embedding")).alias("dimension")).first()
    if size["rows"] > SENT_BLOCKS * QUERY_BLOCK or size["rows"] * ((size["dimension"] or 0) + 3 * k) > SENT_NUMBERS:
        return VectorIndex.build(corpus).near(asked, k, exclude_self, least)
    rows = corpus.filter(F.size("embedding") > 0).select(F.col("id").cast("string").alias("id"), "embedding")
    return first_per(_scan(rows, asked, k, exclude_self, least), ["query_id"], [F.round("distance", 9), "id"], k)


def _scan(rows: DataFrame, asked: DataFrame, k: int, exclude_self: bool, least: float | None) -> DataFrame:
    """Queries of SENT_NUMBERS numbers at most, sent to all tasks."""
    table = asked.select(F.col("query_id").cast("string"), "embedding").toArrow().combine_chunks()
    blocks = [b for b in table.to_batches(QUERY_BLOCK) if b.num_rows]
    sent = rows.sparkSession.sparkContext.broadcast([(b.column(0).to_numpy(zero_copy_only=False), unit_column(b.column(1))) for b in blocks])

    def run(batches):
        best = [Nearest(names, matrix, k, exclude_self, least) for names, matrix in sent.value]
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                part = whole.slice(at, SLICE)
                ids, vectors = part.column(0).to_numpy(zero_copy_only=False), unit_column(part.column(1))
                for b in best:
                    b.meet(ids, vectors)
        for b in best:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(b.columns(), (pa.string(), pa.string(), pa.float64()), strict=True)], names=["query_id", "id", "distance"])

    return rows.mapInArrow(run, NEAR_SCHEMA)


def terms(text: Column) -> Column:
    """Runs of letters and runs of digits, in lower case without marks."""
    low = F.lower(text)
    plain = F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.translate(low, MARKED, PLAIN))  # ASCII has no marks
    return F.regexp_extract_all(plain, F.lit(r"(\p{L}+|\p{N}+)"), F.lit(1))


#: Cells of the table of asked terms by queries up to which it is sent to all tasks, texts of a product, and bytes of a batch of texts.
SENT_CELLS, TEXTS, BATCH_BYTES = 8_000_000, 256, 8 << 20


@contextmanager
def few_texts(spark: SparkSession) -> Iterator[None]:
    """Actions inside send TEXTS rows, or BATCH_BYTES of them, to Python at a time, where Spark would fill batches of 10,000 as tables grow."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": TEXTS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, str(value))
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def bm25(queries: DataFrame, docs: DataFrame, fields: dict[str, float], every_term: bool = False, k: int | None = None) -> DataFrame:
    """query_id, id, score: weighted sum over fields of Okapi BM25, rows that match somewhere.

    ``queries`` (query_id, query) is a stated set. While its terms by its queries make a
    small table, texts are read once: a narrow table keeps how often each has the asked
    terms, gives the frequencies, and is multiplied by the table of terms and queries
    inside tasks. Beyond that postings are joined. With ``k``, a task leaves a query's k
    best rows only.
    """
    asked = written(queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term")), "asked-terms")
    size = asked.agg(F.count_distinct("term").alias("terms"), F.count_distinct("query_id").alias("queries")).first()
    if size["terms"] * size["queries"] > SENT_CELLS:
        return _joined(asked, docs, fields, every_term)
    rows = asked.collect()  # SENT_CELLS cells at most
    names, words = sorted({r["query_id"] for r in rows}), sorted({r["term"] for r in rows})
    if not rows:
        return docs.sparkSession.createDataFrame([], SCORES)
    place, column = {w: i for i, w in enumerate(words)}, {n: i for i, n in enumerate(names)}
    table = np.zeros((len(words), len(names)), np.float32)
    for r in rows:
        table[place[r["term"]], column[r["query_id"]]] = 1
    with few_texts(docs.sparkSession):
        counted = written(_counted(docs, list(fields), words), "asked-counts")
    n, width = len(fields), len(words)
    sums = counted.agg(F.count("*").alias("rows"), *[F.sum(F.get("lengths", F.lit(f))).alias(f"t{f}") for f in range(n)]).first()
    df = np.zeros(n * width)
    for r in counted.select(F.explode("places").alias("place")).groupBy("place").agg(F.count("*").alias("df")).collect():  # a row for each asked term and field
        df[r["place"]] = r["df"]
    idf = np.log(1 + (sums["rows"] - df + 0.5) / (df + 0.5)) * np.repeat(list(fields.values()), width)
    means = np.array([(sums[f"t{f}"] or 0) / max(sums["rows"], 1) or 1.0 for f in range(n)])
    scores = _multiplied(counted, np.array(names, dtype=object), table, idf, means, every_term, k)
    if k is None:
        return scores
    with few_texts(docs.sparkSession):
        return written(scores, "asked-scores")


def _counted(docs: DataFrame, fields: list[str], words: list[str]) -> DataFrame:
    """id, lengths (of each field), places (field times terms, and term) and tfs of the asked terms that a row has."""
    sent = docs.sparkSession.sparkContext.broadcast(words)
    n = len(fields)

    def run(batches):
        known, width = pa.array(sent.value, pa.string()), len(sent.value)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):  # a batch may have thousands of long texts
                batch = whole.slice(at, TEXTS)
                keys, lengths = [], []
                for f in range(n):
                    column = batch.column(1 + f)
                    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
                    found = pc.index_in(column.flatten(), value_set=known).to_numpy(zero_copy_only=False)
                    row = np.repeat(np.arange(len(sizes)), sizes)
                    real = ~np.isnan(found) if found.dtype.kind == "f" else slice(None)
                    keys.append(row[real].astype(np.int64) * (n * width) + f * width + found[real].astype(np.int64))
                    lengths.append(sizes.astype(np.int32))
                key, tf = np.unique(np.concatenate(keys), return_counts=True)
                cuts = np.searchsorted(key, np.arange(batch.num_rows + 1) * (n * width))
                offsets = pa.array(cuts.astype(np.int32))
                places = pa.ListArray.from_arrays(offsets, pa.array((key % (n * width)).astype(np.int32)))
                tfs = pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))
                sizes = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n), pa.array(np.stack(lengths, axis=1).reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), sizes, places, tfs], names=["id", "lengths", "places", "tfs"])

    tokens = docs.select(F.col("id").cast("string").alias("id"), *[terms(F.coalesce(F.col(f), F.lit(""))).alias(f"f{i}") for i, f in enumerate(fields)])
    return tokens.mapInArrow(run, "id string, lengths array<int>, places array<int>, tfs array<int>")


SCORES = "query_id string, id string, score double"


def _multiplied(counted: DataFrame, names: np.ndarray, table: np.ndarray, idf: np.ndarray, means: np.ndarray, every_term: bool, k: int | None) -> DataFrame:
    """Scores as products of texts' gains by the table of terms and queries."""
    sent = counted.sparkSession.sparkContext.broadcast((names, table, idf, means))

    def run(batches):
        names, table, idf, means = sent.value
        width = len(table)
        whole, weights = table.sum(axis=0), table.astype(float)
        best = Best(len(names), k) if k is not None else None
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                sizes = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), sizes)
                place = part.column(2).flatten().to_numpy(zero_copy_only=False)
                tf = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(float)
                lengths = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, len(means))
                field = place // width
                gains = np.zeros((part.num_rows, width))
                np.add.at(gains, (row, place % width), idf[place] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[row, field] / means[field])))
                scores = gains @ weights
                matched = (gains > 0).astype(np.float32) @ table
                ids = part.column(0).to_numpy(zero_copy_only=False)
                real = matched >= whole if every_term else matched > 0
                if best is None:
                    text, query = np.nonzero(real)
                    yield _scored(names[query], ids[text], scores[text, query])
                else:
                    far = -np.round(scores, 9)
                    text, query = np.nonzero(real & (far <= best.last))
                    best.add(query, far[text, query], scores[text, query], ids[text])
        if best is not None:
            query, ids, scores = best.rows()
            yield _scored(names[query], ids, scores)

    return counted.mapInArrow(run, SCORES)


def _scored(queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(queries, pa.string()), pa.array(ids, pa.string()), pa.array(scores)], names=["query_id", "id", "score"])


def _joined(asked: DataFrame, docs: DataFrame, fields: dict[str, float], every_term: bool) -> DataFrame:
    """Scores by joins of postings, for more queries than a table of them can be sent.

    The terms, and the table of each term's weight in each field, are sent to all tasks
    while they are counted to be few, so that no task gets all postings of a frequent
    term; beyond that the joins shuffle, and adaptive execution splits what is skewed.
    """
    small = asked.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    send = F.broadcast if small else (lambda rows: rows)
    tokens = docs.select("id", *[terms(F.coalesce(F.col(f), F.lit(""))).alias(f"f{i}") for i, f in enumerate(fields)])
    none = docs.sparkSession.createDataFrame([("",)], "term string")  # a field's own row

    def kinds(i: int) -> Column:
        own = F.array(F.struct(F.lit(i).alias("field"), F.lit("").alias("term"), F.size(f"f{i}").alias("length")))
        return F.concat(own, F.transform(F.array_distinct(f"f{i}"), lambda x: F.struct(F.lit(i).alias("field"), x.alias("term"), F.lit(0).alias("length"))))

    each = tokens.select(F.explode(F.concat(*[kinds(i) for i in range(len(fields))])).alias("x")).select("x.*")
    counts = each.join(send(asked.select("term").distinct().unionByName(none)), "term").groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("length").alias("length"))
    of_field = Window.partitionBy("field")  # at most the asked terms are in one
    counts = counts.withColumns({"rows": F.max(F.when(F.col("term") == "", F.col("df"))).over(of_field), "total": F.max(F.when(F.col("term") == "", F.col("length"))).over(of_field)})
    share = F.element_at(F.array(*[F.lit(float(w)) for w in fields.values()]), F.col("field") + 1)
    weights = counts.filter("term <> ''").select(
        "field", "term", (F.col("total") / F.col("rows")).alias("mean"), (share * F.log(1 + (F.col("rows") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf")
    )

    def postings(i: int) -> Column:
        return F.transform(f"f{i}", lambda x: F.struct(F.lit(i).alias("field"), x.alias("term"), F.size(f"f{i}").alias("length")))

    found = tokens.select("id", F.explode(F.concat(*[postings(i) for i in range(len(fields))])).alias("x")).select("id", "x.*")
    found = found.join(send(weights), ["field", "term"]).groupBy("id", "field", "term", "length", "mean", "idf").agg(F.count("*").alias("tf"))
    saturated = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    matched = found.select("id", "term", (F.col("idf") * saturated).alias("part")).join(send(asked), "term").groupBy("query_id", "id")
    if not every_term:
        return matched.agg(F.sum("part").alias("score"))
    whole = asked.groupBy("query_id").agg(F.count("*").alias("asked"))
    return matched.agg(F.sum("part").alias("score"), F.count_distinct("term").alias("matched")).join(whole, "query_id").filter("matched = asked").select("query_id", "id", "score")


def best_text(scores: DataFrame, k: int) -> DataFrame:
    return first_per(scores, ["query_id"], [F.desc(F.round("score", 9)), "id"], k)


def fuse(vector: DataFrame, text: DataFrame, how: Fusion = Fusion()) -> DataFrame:
    """Full outer merge of two ranked lists: query_id, id, ranks, distance, score, fused_score, final_rank.

    Component ranks are taken anew, so the order in which rows arrive doesn't matter.
    """
    by_vector = Window.partitionBy("query_id").orderBy(F.desc(F.round(1 / (1 + F.greatest("distance", F.lit(0.0))), 9)), "id")
    by_text = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    v = vector.select("query_id", "id", "distance", F.row_number().over(by_vector).alias("vector_rank"))
    t = text.select("query_id", "id", "score", F.row_number().over(by_text).alias("text_rank"))
    both = v.join(t, ["query_id", "id"], "full_outer")
    if how.strategy == "rrf":
        parts = [F.coalesce(F.lit(w) / (how.k + F.col(r)), F.lit(0.0)) for w, r in ((how.vector_weight, "vector_rank"), (how.text_weight, "text_rank"))]
    else:
        near = F.coalesce(1 / (1 + F.greatest("distance", F.lit(0.0))), F.lit(0.0))
        said = F.coalesce(F.least(F.greatest(F.col("score") / 10, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
        parts = [near * how.vector_weight, said * how.text_weight]
    both = both.withColumns({"fused_score": parts[0] + parts[1], "best_rank": F.least("vector_rank", "text_rank")})
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("fused_score", 9)), "best_rank", "id")
    return both.withColumn("final_rank", F.row_number().over(order))


def hybrid(queries: DataFrame, docs: DataFrame, vectors: DataFrame, fields: dict[str, float], limit: int, how: Fusion = Fusion()) -> DataFrame:
    """Both channels' pools, fused and cut. ``queries`` has query_id, query and embedding.

    A vector without its row is no hit, and takes no place in a pool.
    """
    pool = pool_size(limit)
    own = vectors.join(docs.select("id"), "id", "left_semi")
    fused = fuse(knn(queries, own, pool), best_text(bm25(queries, docs, fields, k=pool), pool), how)
    return fused.filter(F.col("final_rank") <= limit)


def with_payload(hits: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Fused hits with columns of the rows that they name, whichever channel found them; a missing score is 0 in the text channel only."""
    return hits.join(rows.select("id", *columns), "id", "left")


HIT_TYPES = ("note", "message", "summary")
#: Added before a score is shown, so that halves go up whatever the last bit of a sum is.
HALF_UP = 1e-9


def scoped(parts: dict[str, DataFrame], weights: dict[str, float], limit: int) -> DataFrame:
    """Fused hits of several tables in one list: weighted score, best component rank, type, id.

    The channels' scores and ranks stay with each hit, for its evidence.
    """
    union = None
    own = ["fused_score", "vector_rank", "distance", "text_rank", F.col("score").alias("text_score")]
    for i, kind in enumerate(HIT_TYPES):
        if kind in parts:
            one = parts[kind].select("query_id", "id", F.lit(kind).alias("hit_type"), F.lit(i).alias("__type"), *own, (F.col("fused_score") * weights.get(kind, 1.0)).alias("score"), "best_rank")
            union = one if union is None else union.unionByName(one)
    return first_per(union, ["query_id"], [F.desc(F.round("score", 9)), "best_rank", "__type", "id"], limit, "final_rank").drop("__type")


def message_title(role: Column, index: Column) -> Column:
    return F.concat(role, F.lit(" message #"), (index + 1).cast("string"))


def summary_title(title: Column, uuid: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), F.concat(F.lit("Conversation "), uuid))


def evidence(hit: DataFrame) -> DataFrame:
    """A hit's scores, ranks and place in the graph as one struct; what a hit doesn't have is null."""
    wanted = {"score": "double", "fused_score": "double", "vector_rank": "int", "distance": "double", "text_rank": "int", "text_score": "double", "graph_score": "double", "hops": "int", "seed_id": "string", "final_rank": "int"}
    have = set(hit.columns)
    return hit.withColumn("evidence", F.struct(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()]))


def explained(hit: DataFrame) -> DataFrame:
    """Adds a line of text for each hit: which channels found it, with which rank and score."""
    e = evidence(hit)

    def part(name: str, rank: str, score: str) -> Column:
        return F.when(F.col(f"evidence.{rank}").isNotNull(), F.format_string(f"{name} #%d (%.4f)", f"evidence.{rank}", f"evidence.{score}"))

    graph = F.when(F.col("evidence.graph_score").isNotNull(), F.format_string("graph %d hops from %s (%.4f)", "evidence.hops", "evidence.seed_id", "evidence.graph_score"))
    why = F.concat_ws(", ", part("vector", "vector_rank", "distance"), part("text", "text_rank", "text_score"), graph)
    return e.withColumn("explanation", F.concat(F.format_string("#%d %s %.4f: ", "evidence.final_rank", "id", F.col("evidence.score") + HALF_UP), why))
