"""Stored indexes, versions, model calls and runs that make vectors anew."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import inference, vector_index
from corpusloom.operators.inference import Calls, ModelError, inferred, outcome, with_fallback
from corpusloom.operators.reembedding import Reembedding
from corpusloom.operators.text_index import TextIndex
from corpusloom.operators.vector_index import VectorIndex
from corpusloom.sources.storage import Conflict, Folder, Versions, scratch

FIELDS = {"content": 0.9, "title": 0.1}
DOC = "id string, content string, title string"


# ---- versions


def test_a_reader_sees_whole_versions_only(spark):
    store = Versions(spark, scratch(spark, "versions"))
    assert store.at().number == 0
    assert store.read("t") is None
    first = store.commit(store.at(), {"t": [store.write(spark.range(3), "t")]}, who="a")
    left = store.write(spark.range(100), "t")  # a writer that stops here has changed nothing
    assert store.read("t").count() == 3
    second = store.commit(first, {"t": [*first.tables["t"], store.write(spark.range(2), "t")]}, who="b")
    assert (store.read("t").count(), store.read("t", first).count()) == (5, 3)
    with pytest.raises(Conflict):
        store.commit(first, {"t": []})
    assert store.at() == second
    store.tidy()
    assert left not in Folder(spark, f"{store.path}/data").names()
    assert store.read("t").count() == 5


# ---- text index


def best(docs, queries, k):
    """BM25 over all documents, plainly."""
    scores = defaultdict(float)
    for f, (field, weight) in enumerate(FIELDS.items()):
        words = {i: re.findall(r"[a-z]+|[0-9]+", (d[f] or "").lower()) for i, d in docs.items()}
        mean = sum(map(len, words.values())) / max(len(docs), 1)
        df = Counter(w for ws in words.values() for w in set(ws))
        for query_id, text in queries:
            for w in set(re.findall(r"[a-z]+|[0-9]+", text.lower())):
                for i, ws in words.items():
                    if tf := ws.count(w):
                        idf = math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))
                        scores[query_id, i] += weight * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
    out = []
    for query_id, _ in queries:
        own = sorted(((-round(s, 9), i) for (q, i), s in scores.items() if q == query_id))[:k]
        out += [(query_id, i, pytest.approx(-s, abs=1e-6), n) for n, (s, i) in enumerate(own, 1)]
    return sorted(out, key=lambda x: (x[0], x[1]))


def searched(index, spark, queries, k):
    found = index.search(spark.createDataFrame(queries, "query_id string, query string"), FIELDS, k)
    return sorted((r["query_id"], r["id"], r["score"], r["rank"]) for r in found.collect())


def corpus(rng, n, at=0):
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 300}"  # noqa: E731  few frequent words, many rare ones
    return {f"d{at + i:04}": (" ".join(word() for _ in range(rng.randrange(60))) or None, rng.choice(["en one", "de two", None])) for i in range(n)}


def rows(docs):
    return [(i, *d) for i, d in docs.items()]


def test_index_follows_changes(spark):
    rng = random.Random(11)
    docs = corpus(rng, 260)
    queries = [(f"q{i}", " ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.choice([1, 2, 8, 25])))) for i in range(12)] + [("none", "nothing here"), ("empty", "")]
    path = scratch(spark, "text-index")
    index = TextIndex.create(spark, path, spark.createDataFrame(rows(docs), DOC), list(FIELDS))
    assert searched(index, spark, queries, 5) == best(docs, queries, 5)
    new = corpus(rng, 60, 230)  # thirty changed, thirty new
    docs |= new
    index = index.put(spark.createDataFrame(rows(new), DOC))
    gone = [i for n, i in enumerate(sorted(docs)) if n % 6 == 0]
    index.remove(spark.createDataFrame([(i,) for i in [*gone, "unknown"]], "id string"))
    for i in gone:
        del docs[i]
    index = TextIndex.open(spark, path)
    assert index.version.number == 3
    assert searched(index, spark, queries, 5) == best(docs, queries, 5)
    again = {gone[0]: ("w1 w2 back again", "en one")}
    docs |= again
    index = index.put(spark.createDataFrame(rows(again), DOC))
    assert searched(index, spark, queries, 500) == best(docs, queries, 500)
    index = index.compact()
    assert index.table("dead") is None or index.table("dead").count() == 0
    assert searched(index, spark, queries, 5) == best(docs, queries, 5)


def test_search_reads_the_buckets_of_asked_terms_only(spark):
    rng = random.Random(4)
    index = TextIndex.create(spark, scratch(spark, "text-index"), spark.createDataFrame(rows(corpus(rng, 300)), DOC), list(FIELDS))
    asked = spark.createDataFrame([("q", "w7 w250")], "query_id string, query string")
    known = index.weights(asked.select("query_id", F.explode(F.split("query", " ")).alias("term")), FIELDS)
    buckets = {r[0] for r in known.select("bucket").collect()}
    plan = index.table("postings").filter(F.col("bucket").isin(list(buckets)))
    assert {re.search(r"bucket=(\d+)", f)[1] for f in plan.inputFiles()} == {str(b) for b in buckets}
    assert len(buckets) <= 2 < index.table("postings").select("bucket").distinct().count()


def test_terms_that_cannot_reach_the_least_score_bring_no_candidates(spark):
    """Every document has the frequent word, a few have the rare ones: only these are scored in full."""
    docs = {f"d{i:04}": ("common " * 3 + f"filler{i} " + ("rare1 rare2" if i % 40 == 0 else ""), None) for i in range(400)}
    index = TextIndex.create(spark, scratch(spark, "text-index"), spark.createDataFrame(rows(docs), DOC), list(FIELDS))
    completed = []
    plain = TextIndex.complete

    def watched(self, pairs, plan, known):
        completed.append(pairs.count())
        return plain(self, pairs, plan, known)

    TextIndex.complete = watched
    try:
        found = searched(index, spark, [("q", "common rare1 rare2")], 5)
    finally:
        TextIndex.complete = plain
    assert found == best(docs, [("q", "common rare1 rare2")], 5)
    assert completed[-1] <= 10  # of 400 that match


# ---- vector index


def clustered(seed=1, n=600, dims=24, centres=12, spread=0.06):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    v = c[rng.integers(centres, size=n)] + rng.normal(size=(n, dims)) * spread * np.linalg.norm(c, axis=1).mean() / np.sqrt(dims) * 3
    v[7] = v[8]
    return v


@pytest.mark.parametrize(("k", "least"), [(4, None), (3, 0.8), (50, 0.95), (700, None)])
def test_near_rows_by_blocks_equal_all_pairs(spark, monkeypatch, k, least):
    monkeypatch.setattr(vector_index, "QUERIES", 40)
    monkeypatch.setattr(vector_index, "WAVE", 5)
    v = clustered()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    far = np.round(1 - u @ u.T, 9)
    table = spark.createDataFrame([(f"v{i:03}", r.tolist()) for i, r in enumerate(v)] + [("none", None), ("empty", [])], "id string, embedding array<double>")
    index = VectorIndex.build(table, pivots=12, rows=30)
    asked = table.filter("id < 'v100'" if k == 700 else "true").withColumnRenamed("id", "query_id")
    got = defaultdict(list)
    for r in index.near(asked, k, exclude_self=True, least=least).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["id"])
    for i in range(100 if k == 700 else 600):
        own = sorted((far[i, j], j) for j in range(600) if j != i and (least is None or u[i] @ u[j] > least))[:k]
        assert got.get(f"v{i:03}", []) == [f"v{j:03}" for _, j in own]


def test_blocks_far_apart_never_meet(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "QUERIES", 40)
    table = spark.createDataFrame([(f"v{i:03}", r.tolist()) for i, r in enumerate(clustered())], "id string, embedding array<double>")
    index = VectorIndex.build(table, pivots=12, rows=30)
    left, every = index.skipped(table.withColumnRenamed("id", "query_id"), 0.8)
    assert left > 0.7 * every


def test_index_of_no_vectors(spark):
    none = spark.createDataFrame([("a", None)], "id string, embedding array<float>")
    index = VectorIndex.build(none)
    assert index.near(none.withColumnRenamed("id", "query_id"), 3).count() == 0


# ---- calls of a model


def test_a_failed_batch_falls_back_to_single_items():
    asked = []

    def embed(texts):
        asked.append(len(texts))
        if any("bad" in t for t in texts):
            raise ModelError("refused", 400)
        return [[float(len(t))] for t in texts]

    texts = ["a", "bb", "bad", "cccc", "d", "bad too", "e"]
    found = list(with_fallback(texts, embed, Calls()))
    assert [f[0] for f in found] == [[float(len(t))] if "bad" not in t else None for t in texts]
    assert {f[1] for f in found} == {None, "refused"}
    assert max(asked) == 7
    assert asked.count(1) >= 2


def test_what_may_pass_is_tried_again_and_flaws_are_failures():
    state = Counter()

    def shaky(texts):
        state["n"] += 1
        if state["n"] < 3:
            raise ModelError("busy", 503)
        return [[1.0] for _ in texts]

    assert list(with_fallback(["x"], shaky, Calls(pause=0.001))) == [([1.0], None, 3)]
    state.clear()
    assert list(with_fallback(["x"], shaky, Calls(tries=2, pause=0.001))) == [(None, "busy", 2)]
    given = {"short": [1.0], "nan": [1.0, math.nan], "none": None, "good": [1.0, 2.0]}
    found = list(with_fallback(list(given), lambda ts: [given[t] for t in ts], Calls(dimension=2)))
    assert [f[0] for f in found] == [None, None, None, [1.0, 2.0]]
    assert all(f[1] for f in found[:3])
    assert [f[1] for f in with_fallback(["a", "b"], lambda ts: [[1.0]] * 3, Calls())] == ["3 vectors for 1 texts"] * 2


def test_each_text_is_asked_for_once_and_failures_are_rows(spark):
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        if any(len(t) == 3 for t in texts):
            raise ModelError("no", 422)
        return [[float(len(t))] for t in texts]

    items = spark.createDataFrame([(f"i{n}", "x" * (n % 6)) for n in range(60)], "id string, text string")
    identity = {"operation": "embed", "provider": "p", "model": "m", "version": "1"}
    results, new = inferred(items, None, embed, Calls(batch=1), **identity)
    assert outcome(results).first().asDict() == {"completed": 50, "failed": 10}
    assert new.count() == 5
    made = calls.value
    assert made == 6
    again, more = inferred(items, new, embed, Calls(batch=4), **identity)
    assert outcome(again).first().asDict() == {"completed": 50, "failed": 10}
    assert more.count() == 0
    assert calls.value == made + 1  # only what failed
    assert {r["id"]: r["embedding"] for r in again.filter("error is null").collect()} == {f"i{n}": [float(n % 6)] for n in range(60) if n % 6 != 3}


# ---- vectors anew

IDENTITY = {"operation": "embed", "provider": "p", "model": "m", "version": "1"}


def test_a_stopped_run_goes_on_and_equals_a_fresh_one(spark):
    asked = spark.sparkContext.accumulator(0)

    def embed(texts):
        asked.add(len(texts))
        return [[float(len(t)), float(sum(map(ord, t)) % 97)] for t in texts]

    texts = {f"n{i}": f"text {i} " * (i % 5) for i in range(80)} | {"nothing": None}
    state = dict(texts)
    read = lambda: spark.createDataFrame(list(state.items()), "id string, text string")
    run = Reembedding(spark, scratch(spark, "run"), IDENTITY, parts=5)
    first = run.run(read, embed, most_parts=3)
    assert (first.finished, first.ran, first.committed) == (3, 3, None)
    assert run.current() is None
    # meanwhile some texts change, one goes, one comes
    for i in range(0, 80, 9):
        state[f"n{i}"] = f"changed {i}"
    del state["n5"]
    state["new"] = "came later"
    before = asked.value
    second = Reembedding(spark, run.path, IDENTITY, parts=5).run(read, embed)
    assert second.committed == 1
    assert second.failed == 0
    assert asked.value - before <= second.embedded < 80  # what was staged and unchanged isn't asked for again
    fresh = Reembedding(spark, scratch(spark, "run"), IDENTITY, parts=5)
    fresh.run(read, embed)
    as_dict = lambda r: {x["id"]: tuple(x["embedding"]) for x in r.current().collect()}
    assert as_dict(run) == as_dict(fresh)
    assert set(as_dict(run)) == set(state)
    third = run.run(read, embed)
    assert (third.ran, third.committed) == (0, 1)


def test_readers_keep_the_old_version_until_all_parts_fit(spark):
    state = {f"n{i}": f"t{i}" for i in range(20)}
    read = lambda: spark.createDataFrame(list(state.items()), "id string, text string")
    run = Reembedding(spark, scratch(spark, "run"), IDENTITY, parts=3)
    run.run(read, lambda ts: [[1.0]] * len(ts))
    other = Reembedding(spark, run.path, IDENTITY | {"model": "two"}, parts=3)
    other.run(read, lambda ts: [[2.0]] * len(ts), most_parts=1)
    assert {tuple(r["embedding"]) for r in run.current().collect()} == {(1.0,)}

    def failing(texts):
        if any(t == "t3" for t in texts):
            raise inference.ModelError("no", 400)
        return [[2.0]] * len(texts)

    stuck = other.run(read, failing)
    assert (stuck.finished, stuck.failed, stuck.committed) == (3, 1, None)
    assert {tuple(r["embedding"]) for r in run.current().collect()} == {(1.0,)}
    done = other.run(read, lambda ts: [[2.0]] * len(ts))
    assert (done.embedded, done.failed, done.committed) == (1, 0, 2)
    assert {tuple(r["embedding"]) for r in other.current().collect()} == {(2.0,)}
    assert other.vectors.at().notes["identity"]["model"] == "two"


def test_items_that_change_during_a_run_hold_the_commit_back(spark):
    reads = Counter()

    def read():
        reads["n"] += 1
        return spark.createDataFrame([("a", "one" if reads["n"] < 4 else "two"), ("b", "x")], "id string, text string")

    run = Reembedding(spark, scratch(spark, "run"), IDENTITY, parts=2)
    assert run.run(read, lambda ts: [[float(len(t))] for t in ts]).committed is None
    assert run.run(read, lambda ts: [[float(len(t))] for t in ts]).committed == 1
