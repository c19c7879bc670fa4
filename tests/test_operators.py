"""Operators against golden values, brute force and their own invariants."""

from __future__ import annotations

import json
import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import lexical
from corpusloom.functions import text as tx
from corpusloom.operators import chat, chunking, evaluation, gardener, graph, jobs, lifecycle, packing, portable, retrieval, vector_index
from corpusloom.plans import search
from corpusloom.sources import files

#: The published fusion case and its results.
VECTOR = [("vector-only", 0.0), ("shared", 0.2), ("keyword-only", 0.9), *[(f"filler-{i}", 0.9 + i / 100) for i in range(1, 8)]]
TEXT = [("keyword-only", 10.0), ("shared", 2.0), *[(f"filler-{i}", s) for i, s in zip(range(7, 0, -1), (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4), strict=True)], ("vector-only", 0.1)]
GOLDEN = {"rrf": (["shared", "keyword-only", "vector-only"], 1.0, 1.0), "weighted": (["vector-only", "keyword-only", "shared"], 0.5, 0.5413408)}


@pytest.mark.parametrize("strategy", GOLDEN)
@pytest.mark.parametrize("seed", [0, 1])
def test_fusion_golden_in_any_order(spark, strategy, seed):
    random.seed(seed)
    v, t = ([("q", f"note:{i}", s) for i, s in random.sample(x, len(x))] for x in (VECTOR, TEXT))
    fused = retrieval.fuse(spark.createDataFrame(v, "query_id string, id string, distance double"), spark.createDataFrame(t, "query_id string, id string, score double"), retrieval.Fusion(strategy))
    ids, mrr, ndcg = GOLDEN[strategy]
    top = fused.filter("final_rank <= 3").orderBy("final_rank")
    assert [r["id"] for r in top.collect()] == [f"note:{i}" for i in ids]
    given = spark.createDataFrame([("q", "note:shared", 3), ("q", "note:keyword-only", 1), ("q", "note:filler-1", 0)], "case_id string, id string, grade int")
    m = evaluation.case_metrics(top.select(F.col("query_id").alias("case_id"), "id", F.col("final_rank").alias("rank")), given, 3).first()
    assert m["recall"] == 1.0
    assert m["reciprocal_rank"] == pytest.approx(mrr)
    assert m["ndcg"] == pytest.approx(ndcg, abs=1e-5)


def test_matching_note_ranks_first(spark):
    docs = spark.createDataFrame([("a", "Cooking pasta at home", "x"), ("b", "Machine learning with neural networks", "y"), ("c", "Gardening", "z")], "id string, content string, title string")
    q = spark.createDataFrame([("q", "machine learning")], "query_id string, query string")
    assert [r["id"] for r in retrieval.best_text(retrieval.bm25(q, docs, {"content": 0.9, "title": 0.1}), 5).collect()] == ["b"]
    assert retrieval.bm25(spark.createDataFrame([("q", "machine pasta")], "query_id string, query string"), docs, {"content": 1.0}, every_term=True).count() == 0


@pytest.mark.parametrize("sent", [8, 0])
def test_nearest_rows_equal_all_pairs(spark, monkeypatch, sent):
    import numpy as np

    for module, name, value in ((retrieval, "QUERY_BLOCK", 7), (retrieval, "SENT_BLOCKS", sent), (vector_index, "ROWS", 11), (vector_index, "QUERIES", 7), (vector_index, "WAVE", 2)):
        monkeypatch.setattr(module, name, value)
    v = np.random.default_rng(3).normal(size=(40, 6)).astype("float32")
    v[5] = v[6]
    rows = spark.createDataFrame([(f"v{i:02}", r.tolist()) for i, r in enumerate(v)] + [("none", None), ("empty", [])], "id string, embedding array<float>")
    asked = rows.filter("id < 'v20'").withColumnRenamed("id", "query_id") if sent else rows.withColumnRenamed("id", "query_id")
    got = {}
    for r in retrieval.knn(asked, rows, 4, exclude_self=True).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    u = v.astype("float64") / np.linalg.norm(v.astype("float64"), axis=1, keepdims=True)
    d = np.round(1 - u @ u.T, 9)
    for q, near in got.items():
        i = int(q[1:])
        assert near == [f"v{j:02}" for j in sorted((j for j in range(40) if j != i), key=lambda j: (d[i, j], j))[:4]]
    assert len(got) == (20 if sent else 40)


def test_entity_tiers(spark):
    e = spark.createDataFrame([("e1", "new york", ["big apple"]), ("e2", "new", []), ("e3", "atlas", None)], "id string, canonical_name string, aliases array<string>")
    q = spark.createDataFrame([("exact", "New-York"), ("alias", "the Big Apple?"), ("both", "what of new york today"), ("prefix", "tell atla"), ("none", "what")], "query_id string, query string")
    got = {}
    for r in graph.entity_matches(q, e, 4).orderBy("entity_rank").collect():
        got.setdefault(r["query_id"], []).append((r["entity_id"], r["tier"]))
    assert got == {"exact": [("e1", 1)], "alias": [("e1", 2)], "both": [("e1", 2), ("e2", 2)], "prefix": [("e3", 3)]}


def test_graph_candidates_equal_a_step_by_step_walk(spark):
    """One query, two hops, few places: the closed form against admission one state at a time."""
    random.seed(5)
    how = graph.Expansion(hops=2, fanout=3, candidates=6)
    for round_ in range(3):
        nodes = [f"n{i:02}" for i in range(14)]
        rows = [(f"e{i:03}", random.choice(["supports", "contradicts"]), *random.sample(nodes, 2), random.choice([None, 0.5, 0.9])) for i in range(40)]
        seeds = [("q", n, i) for i, n in enumerate(random.sample(nodes, 4))]
        edges = spark.createDataFrame(rows, "id string, edge_type string, from_id string, to_id string, confidence double")
        got = {r["id"]: (round(r["score"], 9), r["hops"], tuple(s["edge_id"] for s in r["path"])) for r in graph.expand(spark.createDataFrame(seeds, "query_id string, note_id string, entity_rank int"), edges, how).collect()}
        assert got == walk(rows, [s[1] for s in seeds], how), round_


def test_bounded_adjacency_gives_the_same_walk(spark):
    """Parallel edges, self loops and visited notes use up places; the kept edges are still enough."""
    random.seed(9)
    how = graph.Expansion(hops=2, fanout=2, candidates=9)
    for round_ in range(3):
        nodes = [f"n{i}" for i in range(6)]
        rows = [(f"e{i:03}", random.choice(["supports", "contradicts"]), random.choice(nodes), random.choice(nodes), random.choice([None, 0.5, 0.9, 0.9])) for i in range(90)]
        edges = spark.createDataFrame(rows, "id string, edge_type string, from_id string, to_id string, confidence double")
        seeds = spark.createDataFrame([("q", n, i) for i, n in enumerate(nodes[:2])], "query_id string, note_id string, entity_rank int")
        kept = graph.adjacency(edges, how)
        assert kept.groupBy("__from", "edge_type").count().agg(F.max("count")).first()[0] <= 6
        for adjacent in (None, kept):
            got = {r["id"]: (round(r["score"], 9), r["hops"], tuple(s["edge_id"] for s in r["path"])) for r in graph.expand(seeds, edges, how, adjacent=adjacent).collect()}
            assert got == walk(rows, nodes[:2], how), round_


def test_a_hub_of_a_million_edges(spark):
    n = 1_000_000
    number = F.col("id")
    edges = spark.range(0, n, 1, 8).select(
        F.format_string("e%07d", number).alias("id"), F.lit("supports").alias("edge_type"), F.lit("hub").alias("from_id"), F.format_string("n%07d", number).alias("to_id"), (F.pmod(number * 7919, F.lit(n)) / n).alias("confidence")
    )
    how = graph.Expansion(hops=2, fanout=4)
    assert graph.adjacency(edges, how).filter("__from = 'hub'").count() == 12
    seeds = spark.createDataFrame([(f"q{i}", "hub" if i % 2 else "n0000005", 0) for i in range(50)], "query_id string, note_id string, entity_rank int")
    best = sorted(range(n), key=lambda i: (-(i * 7919 % n), i))[:4]
    got = {}
    for r in graph.expand(seeds, edges, how).filter("hops > 0").collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    assert got["q1"] == {f"n{i:07}" for i in best}
    assert got["q0"] == {"hub", *got["q1"]}
    assert len(got) == 50


def walk(rows, seeds, how):
    state = {s: {"score": how.seed_score, "path": (), "visited": {s}, "seed": s} for s in seeds}
    order = lambda n, x: (-round(x["score"], 9), [(e, a, b, d) for e, a, b, d in x["path"]], x["seed"], n)
    held = {n: x | {"hops": 0} for n, x in state.items()}
    current = dict(state)
    for hop in range(1, how.hops + 1):
        new = {}
        for n, x in current.items():
            moves = []
            for kind in ("supports", "contradicts"):
                own = [(e, n, b, "out", c) for e, k, a, b, c in rows if k == kind and a == n] + [(e, n, a, "in", c) for e, k, a, b, c in rows if k == kind and b == n]
                own = [m for m in own if m[2] not in x["visited"]]
                moves += sorted(own, key=lambda m: (m[4] is None, -(m[4] or 0), m[0]))[: how.fanout]
            states = [(m[2], {"score": x["score"] * how.decay * (1.0 if m[4] is None else m[4]), "path": (*x["path"], m[:4]), "visited": x["visited"] | {m[2]}, "seed": x["seed"]}) for m in moves]
            for to, s in sorted(states, key=lambda y: (-round(y[1]["score"], 9), y[1]["path"][-1][0], y[0]))[: how.fanout]:
                if to not in new or (-round(s["score"], 9), s["path"][-1][0]) < (-round(new[to]["score"], 9), new[to]["path"][-1][0]):
                    new[to] = s
        current = {}
        for to, s in sorted(new.items(), key=lambda y: (-round(y[1]["score"], 9), y[0])):
            s = s | {"hops": hop}
            if to in held:
                if order("", s) < order("", held[to]):
                    held[to] = s
                current[to] = s
            elif len(held) < how.candidates:
                held[to] = current[to] = s
            else:
                worst = max(held, key=lambda n: order(n, held[n]))
                if order(to, s) < order(worst, held[worst]):
                    del held[worst]
                    current.pop(worst, None)
                    held[to] = current[to] = s
    return {n: (round(x["score"], 9), x["hops"], tuple(p[0] for p in x["path"])) for n, x in held.items()}


def test_pairs_equal_a_walk_over_turns(spark):
    random.seed(2)
    rows = [(f"c{c}", i, random.choice(["human", "assistant", "system"]), random.choice(["short", "a text that is long enough to keep", "é" * 11])) for c in range(60) for i in range(random.randint(1, 9))]
    got = {(r["conversation_id"], r["message_index"]) for r in chat.qa_pairs(spark.createDataFrame(rows, "conversation_id string, message_index int, role string, content string")).collect()}
    want, waiting = set(), {}
    for c, i, role, content in rows:
        if role == "human":
            waiting[c] = content
        elif role == "assistant" and (q := waiting.pop(c, None)) is not None and len(q.encode()) > 10 and len(content.encode()) > 20:
            want.add((c, i))
    assert got == want


def test_titles(spark):
    rows = [("Can you Can you Please explain this?", 1), ("", 2), ("word " * 20, 3), ("x" * 60, 4), ("first\nsecond", 5)]
    got = [r[0] for r in spark.createDataFrame(rows, "q string, n int").select(chat.qa_title(F.col("q"), F.col("n"))).collect()]
    assert got == ["explain this?", "Q&A #2", "word word word word word word word word word...", "x" * 48 + "...", "first"]


TEXTS = ["# A\n\nOne two. Three four.\n\n## B\n- x\n- y\n\n> quote\n\n```py\ncode # no heading\n```\n", "Title\n=====\n\nBody\n\n---\n\nAfter", "a" * 2500, "word. " * 500, "# only\n## headings", "", "\n\n", "é " * 700, "~~~\nopen fence\n" + "z" * 1500]


@pytest.mark.parametrize("text", TEXTS)
def test_chunks_cover_the_text(text):
    sizes = chunking.Sizes(50, 300, 400, 0)
    chunks = list(chunking.chunk("s", text, sizes))
    raw = text.encode()
    for c in chunks:
        assert raw[c["start_byte"] : c["end_byte"]].decode() == c["content"]
        assert len(c["content"]) <= sizes.most
    assert bool(chunks) == bool(text.strip())
    kept = "".join("".join(c["content"].split()) for c in chunks)
    assert len({c["key"] for c in chunks}) == len(chunks)
    assert text.startswith("#") or "=====" in text or kept == "".join(text.split())


def test_headings_and_overlap():
    chunks = list(chunking.chunk("s", TEXTS[0], chunking.Sizes(1, 20, 1000, 5)))
    assert chunks[0]["heading_path"] == ["A"]
    assert chunks[-1]["heading_path"] == ["A", "B"]
    assert chunks[1]["overlap_chars"] == 5
    assert chunks[1]["overlap_from"] == chunks[0]["key"]
    assert "# no heading" in chunks[-1]["content"]
    setext = list(chunking.chunk("s", TEXTS[1], chunking.Sizes()))
    assert [c["heading_path"] for c in setext] == [["Title"], ["Title"]]


def test_paragraphs(spark):
    df = spark.createDataFrame([("a" * 25 + "\n\nshort\n\n" + "b" * 10,)], "t string")
    assert df.select(chunking.paragraph_chunks(F.col("t"), 10, 12)).first()[0] == ["a" * 12, "a" * 3, "a" * 10, "b" * 10]


def align(old: list[tuple], new: list[tuple]) -> list[tuple[int, int, bool]]:
    """By a walk: (old place, new place, exact) of chunks of two generations; a chunk is (heading path, content).

    Anchors that are as frequent on both sides pair off in order if their order is the
    same; else only single ones that keep rising do. A lone changed chunk between two
    pairs under the same headings is the successor of the one it replaced.
    """
    a, b = Counter(old), Counter(new)
    left = [i for i, x in enumerate(old) if a[x] == b[x]]
    right = [j for j, x in enumerate(new) if a[x] == b[x]]
    if [old[i] for i in left] == [new[j] for j in right]:
        exact = list(zip(left, right, strict=True))
    else:
        place, exact, last = {x: j for j, x in enumerate(new)}, [], -1
        for i, x in enumerate(old):
            if a[x] == b[x] == 1 and place[x] > last:
                last = place[x]
                exact.append((i, last))
    out = [(i, j, True) for i, j in exact]
    for (i, j), (k, m) in zip(exact, exact[1:], strict=False):
        if k == i + 2 and m == j + 2 and len({tuple(x[0]) for x in (*old[i : k + 1], *new[j : m + 1])}) == 1:
            out.append((i + 1, j + 1, False))
    return sorted(out, key=lambda x: x[1])


def test_alignment():
    a, b, c, x = (("h",), "a"), (("h",), "b"), (("h",), "c"), (("h",), "x")
    assert align([a, b, c], [a, x, c]) == [(0, 0, True), (1, 1, False), (2, 2, True)]
    assert align([a, a, b], [a, a, b]) == [(0, 0, True), (1, 1, True), (2, 2, True)]
    assert align([a, b], [b, a]) == [(0, 1, True)]


@pytest.mark.parametrize("bucket", [4096, 3])
def test_alignment_equals_a_walk(spark, monkeypatch, bucket):
    monkeypatch.setattr(chunking, "BUCKET", bucket)
    random.seed(11)
    rows = {"old": [], "new": []}
    want = set()
    for n in range(40):
        old = [((random.choice("hk"),), random.choice("abcdef") if n % 2 else f"c{i}") for i in range(random.randint(1, 12))]
        new = [x if random.random() < 0.8 else (x[0], f"changed{i}") for i, x in enumerate(old) if random.random() < 0.9]
        if n % 5 == 0:
            random.shuffle(new)
        for name, side in (("old", old), ("new", new)):
            rows[name] += [(f"s{n}", 10 + 2 * i, list(h), c) for i, (h, c) in enumerate(side)]
        want |= {(f"s{n}", 10 + 2 * i, 10 + 2 * j, e) for i, j, e in align(old, new)}
    schema = "source_id string, ordinal int, heading_path array<string>, content string"
    got = chunking.aligned_chunks(spark.createDataFrame(rows["old"], schema), spark.createDataFrame(rows["new"], schema))
    assert {tuple(r) for r in got.collect()} == want


def test_headings_of_old_chunks_are_recovered(spark):
    old = [("s", 0, None, [], "a"), ("s", 1, None, [], "changed"), ("s", 2, None, [], "c"), ("s", 3, None, [], "twice"), ("s", 4, "k", ["own"], "d"), ("t", 0, None, [], "a")]
    staged = [("s", ["h"], "a"), ("s", ["h"], "c"), ("s", ["h"], "twice"), ("s", ["i"], "twice"), ("s", ["other"], "d")]
    got = chunking.recovered_headings(spark.createDataFrame(old, "source_id string, ordinal int, chunk_key string, heading_path array<string>, content string"), spark.createDataFrame(staged, "source_id string, heading_path array<string>, content string"))
    assert {(r["source_id"], r["ordinal"]): r["heading_path"] for r in got.collect()} == {("s", 0): ["h"], ("s", 1): ["h"], ("s", 2): ["h"], ("s", 3): [], ("s", 4): ["own"], ("t", 0): []}


def test_a_stored_report_and_its_version(spark, tmp_path):
    case = {"name": "n", "query": "q", "metrics": {"k": 3, "recall_at_k": 1.0, "chunks": 2, "tokens": 148}}
    for version in (1, 2, 3):
        (tmp_path / f"{version}.json").write_text(json.dumps({"metadata": {"schema_version": version, "provider": "p", "model": "m"}, "cases": [case]}))
    row = files.baseline_report(spark, f"file://{tmp_path}/2.json").first()
    assert (row["case_id"], row["recall_at_k"], row["precision_at_k"], row["tokens"]) == ("n", 1.0, None, 148)
    with pytest.raises(Exception, match="unsupported report version 3"):
        files.baseline_report(spark, f"file://{tmp_path}/3.json").collect()


def test_files_of_markdown(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# A\n\ntext")
    (tmp_path / "sub" / "b.md").write_bytes(b"one\r\ntwo")
    rows = {r["uri"].rsplit("/", 1)[1]: r for r in files.markdown_files(spark, f"file://{tmp_path}").collect()}
    assert rows["a.md"]["content"] == "# A\n\ntext"
    assert rows["b.md"]["content_hash"].startswith("sha256:")


def seeded(spark, scope):
    """The published regression corpus (one-hot vectors) and its three questions."""
    one = lambda i: [1.0 if j == i else 0.0 for j in range(4)]
    notes = spark.createDataFrame(
        [("note:music", "Music", "A local music service on the media host", "source:homelab"), ("note:lan", "LAN", "Network settings for the media host LAN", "source:homelab"), ("note:other", "Music", "A local music service on the other host", "source:other")],
        "id string, title string, content string, source_id string",
    ).selectExpr("*", "1L as source_generation", "timestamp'2024-01-01' as created_at")
    sources = spark.createDataFrame([("source:homelab", "fixture://notes/homelab.md", 1), ("source:other", "fixture://notes/other.md", 1)], "id string, uri string, successful_generation long")
    chats = spark.createDataFrame([("conversation:support", "fixture-conversation-support", None, "The migration decision is to retain stable identifiers.")], "id string, uuid string, title string, summary string")
    messages = spark.createDataFrame([("message:adapter", "conversation:support", 0, "human", "Pair the adapter before connecting")], "id string, conversation_id string, message_index int, role string, content string")
    vectors = spark.createDataFrame([("note:music", one(0)), ("note:lan", one(0)), ("note:other", one(0)), ("message:adapter", one(1)), ("conversation:support", one(2))], "id string, embedding array<double>")
    queries = spark.createDataFrame([("notes", "local music service", one(0)), ("messages", "adapter pairing", one(1)), ("all", "what was decided", one(2))], "query_id string, query string, embedding array<double>")
    return search.Model(notes, sources, vectors, messages, chats), queries.filter(F.col("query_id") == scope)


@pytest.mark.parametrize(("scope", "k", "uri", "relevant", "recall", "precision"), [("notes", 3, "fixture://notes/homelab.md", {"note:music": 3, "note:lan": 1}, 1.0, 2 / 3), ("messages", 2, None, {"message:adapter": 3}, 1.0, 0.5), ("all", 3, None, {"conversation:support": 3}, 1.0, 1 / 3)])
def test_seeded_searches(spark, scope, k, uri, relevant, recall, precision):
    model, queries = seeded(spark, scope)
    how = search.Search(scope=scope, limit=k, use_graph="off", source_uri=uri)
    given = spark.createDataFrame([(scope, i, g) for i, g in relevant.items()], "case_id string, id string, grade int")
    row = search.evaluate(model, queries, given, how, k).first()
    assert row["recall"] == recall
    assert row["precision"] == pytest.approx(precision)
    hits = search.search(model, queries, how).orderBy("final_rank").collect()
    assert [r["final_rank"] for r in hits] == list(range(1, len(hits) + 1))
    assert all(r["evidence"]["final_rank"] == r["final_rank"] for r in hits)
    if scope == "notes":
        assert hits[0]["id"] == "note:music"
        assert {r["source_uri"] for r in hits} == {uri}
    if scope == "messages":
        assert hits[0]["title"] == "human message #1"
    packed = search.augment(model, queries, how).filter("reason = 'selected'").collect()
    assert set(relevant) <= {r["id"] for r in packed}


def test_days_count_back_from_the_call(spark):
    model, queries = seeded(spark, "notes")
    how = search.Search(use_graph="off", since_days=30)
    assert search.search(model, queries, how).count() == 0
    assert search.search(model, queries, how, datetime(2024, 1, 20)).count() == 3


def test_folding_of_marks(spark):
    row = spark.createDataFrame([("Ångström ŻÓŁĆ œuvre naïve Šří ệ",)], "t string").select(retrieval.terms(F.col("t")).alias("x")).first()
    assert row["x"][0] == "angstrom"
    assert row["x"][-2:] == ["sri", "e"]


def hits(texts):
    return [{"id": f"n{i}", "hit_type": "note", "title": None, "content": t, "score": 1.0 - i / 10} for i, t in enumerate(texts)]


def greedy(rows, how):
    """The choice written out: every waiting hit against every chosen one, each time."""
    counts = {h["id"]: lexical.token_counts(h["content"]) for h in rows}

    def alike(a, b):
        both, all_ = sum((counts[a] & counts[b]).values()), sum((counts[a] | counts[b]).values())
        return both / all_ if both else 0.0

    scores = [h["score"] for h in rows]
    relevance = {h["id"]: (h["score"] - min(scores)) / (max(scores) - min(scores)) for h in rows}
    left, chosen, out = [h["id"] for h in rows], [], {}
    while left and len(chosen) < how.chunks:
        worth = {i: (1 - how.novelty) * relevance[i] + how.novelty * (1 - max((alike(i, c) for c in chosen), default=0.0)) for i in left}
        i = max(left, key=lambda i: (worth[i], -left.index(i)))
        left.remove(i)
        near = max((alike(i, c) for c in chosen), default=0.0)
        if chosen and near >= how.near_duplicate:
            out[i] = ("near_duplicate", None, round(1 - near, 9))
        else:
            chosen.append(i)
            out[i] = ("selected", len(chosen), round(1 - near, 9))
    return out | dict.fromkeys(left, ("diagnostic_limit", None, None))


@pytest.mark.parametrize("novelty", [0.0, 0.25, 0.7, 1.0])
def test_choices_equal_plain_greedy(monkeypatch, novelty):
    compared = []
    plain = packing.multiset_jaccard
    monkeypatch.setattr(packing, "multiset_jaccard", lambda a, b: compared.append(1) or plain(a, b))
    random.seed(11)
    words = [f"w{i}" for i in range(12)]
    some = every = 0
    for _ in range(40):
        n = random.randint(2, 60)
        rows = [{"id": f"h{i:02}", "hit_type": "note", "title": "t", "content": " ".join(random.choices(words, k=random.randint(1, 9))), "score": random.choice([i / 7, random.random()])} for i in range(n)]
        how = packing.Packing(chunks=random.randint(1, 9), total=10**6, per_chunk=10**5, novelty=novelty, near_duplicate=0.6)
        compared.clear()
        got = {r["id"]: (r["reason"], r.get("citation"), None if r.get("novelty") is None else round(r["novelty"], 9)) for r in packing.pack_query(rows, "w1", how)}
        want = greedy(rows, how)
        assert got == want
        some += len(compared)
        every += n * sum(r[0] == "selected" for r in want.values())
    assert some < every * (0.6 if novelty < 0.5 else 1)


def test_packing_reasons_and_budget():
    how = packing.Packing(chunks=2, total=400, per_chunk=60)
    texts = ["alpha beta gamma delta", "alpha beta gamma delta", "", "Something else. The needle is here. And a tail that goes on and on for long.", "third one"]
    out = {r["id"]: r for r in packing.pack_query(hits(texts), "needle", how)}
    assert {k: r["reason"] for k, r in out.items()} == {"n0": "selected", "n1": "near_duplicate", "n2": "empty_content", "n3": "selected", "n4": "diagnostic_limit"}
    assert "needle" in out["n3"]["snippet"]
    assert out["n3"]["tokens"] <= 60
    dup = packing.pack_query(hits([texts[0], texts[1]]), "q", packing.Packing(novelty=0.0))
    assert [r["reason"] for r in dup] == ["selected", "near_duplicate"]
    assert packing.pack_query(hits(["x"]), "q", packing.Packing(total=0))[0]["reason"] == "token_budget"


@pytest.mark.parametrize("text", ["one long run of words " * 30, "漢字" * 100, "x" * 300, "a. b. c. " * 40, "```\ncode\n```\n" * 20])
@pytest.mark.parametrize("most", [0, 5, 20, 80])
def test_clips_fit(text, most):
    snippet, _ = packing.clip(text, "words 字漢 c", most, packing.utf8_bytes)
    assert len(snippet.encode()) <= most


def test_multisets():
    a, b = lexical.token_counts("Deploy done ✅"), lexical.token_counts("deploy DONE ❌")
    assert lexical.multiset_jaccard(a, b) == pytest.approx(2 / 4)
    assert lexical.multiset_jaccard(lexical.token_counts("漢字仮名"), lexical.token_counts("漢字仮名")) == 1.0
    assert lexical.phrase_span("catalog of cats", "cat") is None
    assert lexical.phrase_span("The CAT sat", "cat") == (4, 7)


def test_near_duplicates_equal_all_pairs(spark):
    random.seed(3)
    texts = {f"t{i:02}": [random.choice("abcdefgh") for _ in range(random.randint(2, 9))] for i in range(40)}
    rows = [("g", i, w, ws.count(w)) for i, ws in texts.items() for w in set(ws)]
    got = {(r["left_id"], r["right_id"]) for r in gardener.near_duplicates(spark.createDataFrame(rows, "group_id string, id string, token string, n long"), 0.6).collect()}
    from collections import Counter

    want = {(a, b) for a in texts for b in texts if a < b and lexical.multiset_jaccard(Counter(texts[a]), Counter(texts[b])) >= 0.6 - 1e-12}
    assert got == want


def test_proposal_states(spark):
    schema = "id string, from_id string, to_id string, edge_type string, confidence double, generator string, status string, resulting_edge_id string"
    p = spark.createDataFrame([(f"p{i}", *r) for i, r in enumerate([
        ("a", "b", "related_to", 0.9, "gardener-similarity", "pending", None), ("a", "c", "related_to", 0.9, "gardener-similarity", "pending", None), ("a", "gone", "related_to", 0.9, "gardener-similarity", "accepting", None),
        ("b", "c", "related_to", 0.9, "gardener-similarity", "accepted", None), ("b", "c", "related_to", 0.1, "gardener-similarity", "pending", None), ("b", "c", "related_to", 0.9, "gardener-similarity", "rejected", None)])], schema)
    edges = spark.createDataFrame([("e", "related_to", "c", "a", None)], "id string, edge_type string, from_id string, to_id string, confidence double")
    visible = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    state = {r["id"]: r["status"] for r in lifecycle.acceptance(p, visible, edges, 0.5).collect()}
    assert state == {"p0": "accepted", "p1": "superseded", "p2": "superseded", "p3": "accepted", "p4": "pending", "p5": "rejected"}
    once = lifecycle.reviewed(p, ["p0", "p5"], "rejected", "me")
    assert [r["status"] for r in lifecycle.reviewed(once, ["p0"], "accepted", "me").filter("id in ('p0', 'p5')").collect()] == ["rejected", "rejected"]


def test_search_text_after_an_edit(spark):
    rows = [("body", ["H"], None, "new", ["H"], None, "H\n\nnew"), ("body", [], "custom", "new", [], None, "custom"), ("body", [], None, "body", [], "mine", "mine"), ("body", ["H"], "H\n\nbody", "body", ["I"], None, "I\n\nbody")]
    df = spark.createDataFrame(rows, "a string, b array<string>, c string, d string, e array<string>, f string, want string")
    got = df.select(tx.updated_search_content(dict(content=F.col("a"), headings=F.col("b"), search=F.col("c")), dict(content=F.col("d"), headings=F.col("e"), search=F.col("f"))).alias("x"), "want").collect()
    assert all(r["x"] == r["want"] for r in got)


def test_leases(spark):
    from datetime import datetime, timedelta

    now = datetime(2024, 1, 1)
    rows = [("a", "pending", None, None), ("b", "running", "other", now + timedelta(seconds=5)), ("c", "running", "other", now - timedelta(seconds=5)), ("d", "completed", None, None)]
    df = spark.createDataFrame(rows, "id string, status string, lease_owner string, lease_expires_at timestamp")
    owners = {x: {r["id"]: r["lease_owner"] for r in jobs.claim(df, x, "me", now).collect()}[x] for x in "abcd"}
    assert owners == {"a": "me", "b": "other", "c": "me", "d": None}


def test_archive_round_trip(spark, tmp_path):
    notes = spark.createDataFrame([("note:1", "x\ny", "source:1"), ("note:2", "é", "source:9")], "id string, content string, source_id string")
    sources = spark.createDataFrame([("source:1", "file:///tmp/a"), ("source:2", "https://x")], "id string, uri string")
    manifest = portable.write_archive({"note": notes, "source": sources}, f"file://{tmp_path}/a")
    lines = portable.read_archive(spark, f"file://{tmp_path}/a")
    found = portable.problems(lines, manifest, ["note", "source"], {"note": {"source_id": "source"}}).collect()
    assert [tuple(r) for r in found] == [("dangling reference", "note", "note:2")]
    assert sorted(map(tuple, portable.restore(lines, "note", "id string, content string, source_id string").collect())) == sorted(map(tuple, notes.collect()))
    assert portable.restore(lines, "source", "id string, uri string").filter("uri is null").count() == 1
    assert portable.problems(lines.unionByName(lines), manifest, ["note"], {}).select("problem").distinct().count() == 3


def test_chat_export_shapes(spark, tmp_path):
    one = {"uuid": "a", "name": "n", "chat_messages": [{"sender": "human", "text": "hi"}]}
    for i, x in enumerate([[one, {"uuid": "e", "chat_messages": []}], {"conversations": [{"uuid": "b", "messages": [{"role": "assistant", "content": "yo"}]}]}, one | {"uuid": "c"}]):
        (tmp_path / f"{i}.json").write_text(json.dumps(x))
    got = {r["uuid"]: [(m["role"], m["content"]) for m in r["messages"]] for r in files.chat_exports(spark, f"file://{tmp_path}/*.json").collect()}
    assert got == {"a": [("human", "hi")], "b": [("assistant", "yo")], "c": [("human", "hi")]}


def test_evaluation_cases_are_strict(spark, tmp_path):
    (tmp_path / "ok").write_text('# c\n\n{"query": "q", "k": 2, "other": 1}\n')
    assert files.evaluation_cases(spark, f"file://{tmp_path}/ok").first()["k"] == 2
    (tmp_path / "bad").write_text('{"schema_version": 2, "query": "q", "other": 1}\n')
    with pytest.raises(Exception, match="unknown fields: other"):
        files.evaluation_cases(spark, f"file://{tmp_path}/bad").collect()


def test_stream_imports_what_is_new(spark, tmp_path):
    from corpusloom.operators.importing import Library
    from corpusloom.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# T\n\nText.")
    for _ in range(2):
        ingest(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/library", f"file://{tmp_path}/state").awaitTermination()
    assert [r["content"] for r in Library.open(spark, f"file://{tmp_path}/library").rows("notes").collect()] == ["Text."]
