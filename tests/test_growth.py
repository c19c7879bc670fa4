"""Work that grows with the rows, not with their square, and keeps its results."""

from __future__ import annotations

import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.operators import blocks, evaluation, inference, retrieval, text_index
from corpusloom.operators.blocks import Nearest, unit
from corpusloom.operators.vector_index import VectorIndex, packed
from corpusloom.plans import queries as q
from corpusloom.sources.storage import written


def test_metrics_never_repeat_a_set_for_its_cases(spark, tmp_path, monkeypatch):
    rows = spark.range(1000).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).cast("array<float>").alias("embedding"), F.lit(1).alias("label"))
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    given, real = [], evaluation.relevance
    monkeypatch.setattr(evaluation, "relevance", lambda rows, *of: (given.append(rows.count()), real(rows, *of))[1])
    found = q.metrics(spark, str(tmp_path)).collect()
    assert len(found) == 50
    assert all(r["relevant"] == 200 for r in found)
    assert given == [200]  # once for all 50 cases


def test_metrics_of_shared_sets_equal_those_of_repeated_ones(spark):
    ranked = spark.createDataFrame([(f"c{c}", f"n{(c * 7 + r * r) % 40}", r) for c in range(9) for r in range(1, 15)], "case_id string, id string, rank int")
    sets = spark.createDataFrame([(f"c{c}", c % 3) for c in range(9)] + [("unranked", 2), ("of no set", None)], "case_id string, set_id int")
    given = spark.createDataFrame([(i % 3, f" N{i} ", i % 4) for i in range(40)], "set_id int, id string, grade int")
    repeated = evaluation.case_metrics(ranked, sets.join(given, "set_id").drop("set_id"), 10)
    shared = evaluation.case_metrics(ranked, given, 10, sets)
    plain = lambda rows: sorted((r["case_id"], *(round(r[m], 9) for m in ("relevant", *evaluation.METRICS))) for r in rows.collect())
    assert plain(shared) == plain(repeated)
    assert len(plain(shared)) == 10


def exchanges(rows) -> int:
    return rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_terms_are_counted_without_a_shuffle_and_postings_with_one(spark):
    docs = spark.createDataFrame([(f"n{i}", " ".join(f"w{(i * j) % 7}" for j in range(i)), None if i % 3 else "Été w1 w1") for i in range(30)], "id string, content string, title string")
    documents = text_index.document_terms(docs, ["content", "title"])
    assert exchanges(documents) == 0
    found = {(r["id"], r["field"]): (r["length"], {t["term"]: t["tf"] for t in r["terms"]}) for r in documents.collect()}
    for r in docs.collect():
        for field, text in enumerate((r["content"], r["title"])):
            words = re.findall("[a-z]+|[0-9]+", (text or "").lower().replace("é", "e"))
            assert found[r["id"], field] == (len(words), dict(Counter(words)))
    stored = written(documents, "terms")
    postings = text_index.postings_of(stored, 3, 8)
    assert exchanges(postings.sortWithinPartitions("bucket", "term")) == 1
    entries = {(r["term"], r["field"], x["id"]): (x["tf"], x["length"]) for r in postings.collect() for x in r["entries"]}
    assert entries == {(term, field, i): (tf, length) for (i, field), (length, own) in found.items() for term, tf in own.items()}


def test_visible_notes_are_not_shuffled_for_their_few_sources(spark, sf):
    assert exchanges(q.visible(spark, sf).select("id", "content")) <= 1  # that of the sources' own count


def test_a_task_leaves_its_best_rows_once_for_each_query(spark):
    """Whatever the number of blocks: copies, nulls in place of numbers and ties by id among them."""
    rng = np.random.default_rng(4)
    vectors = np.concatenate([rng.normal(size=(700, 8)), np.repeat(rng.normal(size=(2, 8)), 150, axis=0)])
    vectors[17] = np.nan
    ids, k = np.array([f"n{i}" for i in range(1000)], dtype=object), 5
    matrix = unit(vectors)
    for exclude_self, least in ((False, None), (True, 0.3)):
        best = Nearest(ids[::9], matrix[::9], k, exclude_self, least)
        for at in range(0, 1000, 130):
            best.meet(ids[at : at + 130], matrix[at : at + 130])
        found = best.rows()
        similar = matrix[::9] @ matrix.T
        want = []
        for q, row in enumerate(similar):
            own = [(round(1 - s, 9), i) for i, s in zip(ids, row, strict=True) if np.isfinite(s) and not (exclude_self and i == ids[::9][q]) and (least is None or s > least)]
            want += [(ids[::9][q], i) for _, i in sorted(own)[:k]]
        assert sorted(zip(found["query_id"], found["id"], strict=True)) == sorted(want)
    rows = spark.createDataFrame([(f"n{i}", [float(x) for x in rng.normal(size=4)]) for i in range(600)], "id string, embedding array<double>")
    index = VectorIndex.build(rows, rows=20)
    asked = [b for wave in index.waves(written(packed(rows, index.pivots, 100), "asked")) for _, b in wave]
    met = index.meet(asked, list(range(len(index.pivots))), 3, False, None)
    assert met.count() <= 3 * 600 * met.rdd.getNumPartitions() < 3 * 600 * index.blocks().count()


def test_a_task_sorts_as_its_rows_double(monkeypatch):
    """And not for each slice of rows that holds a near one; many equal rows wait some pairs at a time."""
    rng = np.random.default_rng(5)
    vectors = np.concatenate([rng.normal(size=(6000, 8)), np.repeat(rng.normal(size=(1, 8)), 400, axis=0)])[rng.permutation(6400)]
    ids, matrix, k = np.array([f"n{i}" for i in range(6400)], dtype=object), unit(vectors), 5
    monkeypatch.setattr(blocks, "SLICE", 64)
    monkeypatch.setattr(blocks, "PAIRS", 500)
    calls, real = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: (calls.append(len(keys)), real(keys))[1])
    best = Nearest(ids[::40], matrix[::40], k, False, None)
    best.meet(ids, matrix)
    found = best.rows()
    assert calls.count(2) + calls.count(3) <= 40 < 6400 // 64
    far = np.round(1 - matrix[::40] @ matrix.T, 9)
    want = [(ids[::40][q], i) for q, row in enumerate(far) for _, i in sorted(zip(row, ids, strict=True))[:k]]
    assert sorted(zip(found["query_id"], found["id"], strict=True)) == sorted(want)


def test_pairs_of_wide_vectors_are_compared_some_at_a_time():
    """Their copies for 200 hits of 200 queries, as a search asks for, don't grow with the dimension."""
    rng = np.random.default_rng(7)
    ids, k = np.array([f"n{i}" for i in range(1024)], dtype=object), 200
    matrix = unit(rng.normal(size=(1024, 768)))
    best = Nearest(ids[:200], matrix[:200], k, False, None)
    tracemalloc.start()
    try:
        best.meet(ids, matrix)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 60e6  # 40,000 pairs of whole vectors are 490 MB
    found = best.rows()
    far = np.round(1 - matrix[:200] @ matrix.T, 9)
    want = [(ids[q], i) for q, row in enumerate(far) for _, i in sorted(zip(row, ids, strict=True))[:k]]
    assert sorted(zip(found["query_id"], found["id"], strict=True)) == sorted(want)


def test_queries_of_many_blocks_meet_the_corpus_in_one_scan(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(6)
    table = spark.createDataFrame([(f"n{i}", [float(x) for x in rng.normal(size=4)]) for i in range(150)], "id string, embedding array<double>")
    asked = table.withColumnRenamed("id", "query_id")
    by_blocks = VectorIndex.build(table, rows=20).near(asked, 3)
    monkeypatch.setattr(VectorIndex, "build", None)
    plain = lambda rows: sorted((r["query_id"], r["id"], r["rank"], round(r["distance"], 9)) for r in rows.collect())
    assert plain(retrieval.knn(asked, table, 3)) == plain(by_blocks)


def test_terms_of_many_texts_are_counted_some_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(f"n{i}", f"w x{i % 3} w " + "y " * (i % 5), None) for i in range(50)], "id string, content string, title string").coalesce(1)
    counts = lambda: sorted((r["id"], tuple(r["lengths"]), tuple(r["places"]), tuple(r["tfs"])) for r in retrieval._counted(docs, ["content", "title"], ["w", "y", "0"]).collect())
    whole = counts()
    monkeypatch.setattr(retrieval, "TEXTS", 7)
    assert counts() == whole
    assert len(whole) == 50


def test_python_gets_few_texts_at_a_time_and_a_task_leaves_its_best(spark, monkeypatch):
    """Whatever the number of rows; settings are put back."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    monkeypatch.setattr(retrieval, "TEXTS", 7)
    docs = spark.createDataFrame([(f"n{i}", "w " * (1 + i % 9) + f"x{i % 3} " + "y " * (i % 5)) for i in range(400)], "id string, content string").coalesce(1)
    asked = spark.createDataFrame([("a", "w y"), ("b", "x1"), ("c", "w x2"), ("none", "z")], "query_id string, query string")
    before, batches, real = [spark.conf.get(k, None) for k in keys], [], written

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows]})

    monkeypatch.setattr(retrieval, "written", lambda rows, label: (label == "asked-terms" or batches.append(max(r["rows"] for r in docs.mapInArrow(sizes, "rows long").collect())), real(rows, label))[1])
    found = retrieval.bm25(asked, docs, {"content": 1.0}, k=3)
    assert batches == [7, 7]  # while texts are counted, and while they are scored
    assert [spark.conf.get(k, None) for k in keys] == before
    assert found.count() <= 3 * 3 * 4  # a query's best of a task, not of each 7 texts
    plain = lambda rows: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in rows.collect())
    assert plain(retrieval.best_text(found, 3)) == plain(retrieval.best_text(retrieval.bm25(asked, docs, {"content": 1.0}), 3))


def test_documents_are_turned_round_and_scored_where_they_are(spark, tmp_path, monkeypatch):
    """Neither a shuffle of postings nor the scores of pairs repeat a document's terms."""
    docs = spark.createDataFrame([(f"n{i}", " ".join(f"w{(i * j) % 11}" for j in range(i % 9)), f"w{i % 5}") for i in range(90)], "id string, content string, title string")
    stored = written(text_index.document_terms(docs, ["content", "title"]), "terms")
    entries = lambda rows: sorted((r["term"], r["field"], x["id"], x["tf"], x["length"]) for r in rows.collect() for x in r["entries"])
    postings = text_index.postings_of(stored, 3, 8)
    assert "Generate" not in postings._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(text_index, "BLOCK", 4)  # a block of many more documents is dealt to several tasks
    assert entries(text_index.postings_of(stored, 1, 8)) == entries(postings)
    weight = {"content": 0.9, "title": 0.1}
    index = text_index.TextIndex.create(spark, f"{tmp_path}/index", docs, list(weight))
    index = index.put(docs.filter("id like 'n1%'").withColumn("content", F.lit("w1 w3 w3 new"))).remove(docs.filter("id like '%7'").select("id"))
    asked = spark.createDataFrame([(f"q{i}", str((i * j) % 12)) for i in range(12) for j in range(1, 6)], "query_id string, term string").distinct()
    known = written(index.weights(asked, weight), "weights")
    plan = written(text_index.query_plan(asked, known, 3), "plan")
    pairs = plan.select("query_id").distinct().crossJoin(docs.filter("id <> 'n5'").select("id"))
    scores = index.complete(pairs, plan, known)
    assert "Generate" not in scores._jdf.queryExecution().executedPlan().toString()
    plain = lambda rows: {(r["query_id"], r["id"]): round(r["score"], 9) for r in rows.collect()}
    assert plain(scores) == plain(index._complete_joined(pairs, plan, known))
    assert len(plain(scores)) > 100


def test_a_task_takes_some_texts_of_a_batch_at_a_time():
    seen = []
    batch = pa.RecordBatch.from_pydict({"cache_key": [f"k{i}" for i in range(1300)], "text": [None if i == 7 else "x" * i for i in range(1300)]})
    found = inference.answers([batch], lambda texts: (seen.extend(texts), [[float(len(t or "")), 1.0] for t in texts])[1], inference.Calls())
    first = next(found)
    assert len(seen) == first.num_rows == inference.TEXTS < 1300
    rows = [r for part in [first, *found] for r in part.to_pylist()]
    assert [(r["cache_key"], r["embedding"], r["error"], r["calls"]) for r in rows] == [(f"k{i}", [0.0 if i == 7 else float(i), 1.0], None, 1) for i in range(1300)]
