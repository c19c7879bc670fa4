"""BM25 by products and by joins, what a search lets through, times of cases, and nothing left in the session."""

from __future__ import annotations

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import retrieval
from corpusloom.operators.packing import Packing
from corpusloom.plans import search as s

FIELDS = {"content": 0.9, "title": 0.1}
NOW = datetime(2024, 2, 1)


def texts(spark, n=300, seed=2):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Été", "naïve", "x1", f"w{int(rng.paretovariate(0.8)) % 90}"])
    rows = [(f"d{i:03}", None if i % 50 == 7 else " ".join(word() for _ in range(rng.randrange(40))), rng.choice(["w1 title", None, "été"])) for i in range(n)]
    return spark.createDataFrame(rows, "id string, content string, title string").repartition(3)


@pytest.mark.parametrize("every_term", [False, True])
def test_products_equal_joins(spark, monkeypatch, every_term):
    docs = texts(spark)
    asked = spark.createDataFrame([("a", "ETE w1 w2 w3"), ("b", "w5"), ("c", "unknown"), ("d", ""), ("e", "naive été x1 w1 w1")], "query_id string, query string")
    plain = lambda rows: {(r["query_id"], r["id"]): r["score"] for r in rows.collect()}
    fast = plain(retrieval.bm25(asked, docs, FIELDS, every_term))
    top = retrieval.best_text(retrieval.bm25(asked, docs, FIELDS, every_term, k=7), 7)
    best = sorted((r["query_id"], r["rank"], r["id"]) for r in top.collect())
    monkeypatch.setattr(retrieval, "SENT_CELLS", 0)
    slow = plain(retrieval.bm25(asked, docs, FIELDS, every_term))
    assert fast.keys() == slow.keys()
    assert all(fast[k] == pytest.approx(slow[k]) for k in slow)
    assert best == sorted((r["query_id"], r["rank"], r["id"]) for r in retrieval.best_text(retrieval.bm25(asked, docs, FIELDS, every_term), 7).collect())
    assert retrieval.bm25(asked.filter("false"), docs, FIELDS).count() == 0


def model(spark):
    docs = texts(spark, 60)
    notes = docs.withColumns({"source_id": F.lit("s"), "source_generation": F.lit(1).cast("long"), "created_at": F.lit("2024-01-01").cast("timestamp")})
    sources = spark.createDataFrame([("s", "u", 1, 1, "ready")], "id string, uri string, successful_generation long, generation long, status string")
    vectors = docs.select("id", F.array(F.lit(1.0), F.length("id") + F.xxhash64("id") % 7).alias("embedding"))
    ghosts = spark.createDataFrame([("ghost", [1.0, 1.0])], "id string, embedding array<double>")
    return s.Model(notes, sources, vectors.unionByName(ghosts))


def test_stages_are_counted_while_a_search_runs(spark):
    queries = spark.createDataFrame([("a", "w1 w2", [1.0, 1.0]), ("b", "w3", None)], "query_id string, query string, embedding array<double>")
    how, watch = s.Search(limit=5, use_graph="off"), s.Watch()
    hits = s.search(model(spark), queries, how, NOW, watch).collect()
    report = json.loads(watch.report(how))
    pool = retrieval.hybrid(queries, model(spark).notes, model(spark).vectors, FIELDS, s.merged_pool(5))
    rows = {x["stage"]: x["rows"] for x in report["stages"]}
    assert rows == {"notes": pool.count(), "scoped": pool.count(), "merged": pool.count(), "hits": len(hits)}
    assert report["options"]["limit"] == 5
    assert report["milliseconds"] > 0
    assert all(r["id"] != "ghost" and r["title"] != "" for r in hits)
    assert {r["id"] for r in hits} <= {r["id"] for r in model(spark).notes.select("id").collect()}


def test_cases_one_by_one_find_what_they_find_together(spark):
    cases = spark.createDataFrame([("a", "w1 w2", [1.0, 1.0]), ("b", "w3 été", None)], "query_id string, query string, embedding array<double>")
    how = s.Search(limit=4, use_graph="off")
    together = {}
    for r in s.search(model(spark), cases, how, NOW).orderBy("final_rank").collect():
        together.setdefault(r["query_id"], []).append(r["id"])
    timed = s.timed_cases(model(spark), cases, how, NOW)
    assert {t.case_id: t.ids for t in timed} == together
    found = s.latency(timed)
    assert found["cases"] == 2
    assert found["p50"] <= found["p95"] == found["max"]
    assert s.latency([]) == {"cases": 0}


def test_every_query_has_a_context_or_a_reason(spark):
    queries = spark.createDataFrame([("a", "w1 w2", [1.0, 1.0]), ("b", "unknown", None)], "query_id string, query string, embedding array<double>")
    how = s.Search(limit=4, use_graph="off")
    for total, want in ((0, {"a": "no budget", "b": "no budget"}), (4000, {"a": "packed", "b": "no hits"}), (1, {"a": "nothing fits", "b": "no hits"})):
        budget = Packing(total=total)
        states = s.context_states(queries, s.augment(model(spark), queries, how, budget, NOW), budget)
        assert {r["query_id"]: r["state"] for r in states.collect()} == want


def test_nothing_stays_cached(spark, sf):
    from corpusloom.plans import registered

    for name in ("graph_one_hop", "aligned_chunks", "bm25_summaries"):
        registered.QUERIES[name](spark, sf).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
