"""Decontamination, the filter audit and hard negatives against brute force, with the odd cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, filter_audit, hard_negatives

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, digest string, n long, hits string, words int"


# ---- 11: decontamination


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def leaks(docs, items, window=10):
    """(doc_id, words, words that are hit, item_ids) for each row, by every window of every text."""
    of = defaultdict(set)
    for item_id, text in items:
        w = words_of(text)
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            of[tuple(w[p : p + n])].add(item_id)
    sizes = {len(k) for k in of}
    out = []
    for doc_id, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (key := tuple(w[p : p + n])) in of:
                    hit.update(range(p, p + n))
                    found |= of[key]
        out.append((doc_id, len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return out


def assert_leaks(spark, docs, items, window=10):
    d = spark.createDataFrame([(i, t, "en", "x", 1, "h", 2) for i, t in docs], DOCS).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.digests(d, b, window).collect()]
    want = [(i, n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0) for i, n, h, x in leaks(docs, items, window)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    return d, b


def test_leaks_equal_every_window(spark):
    rng = random.Random(5)
    vocabulary = ["aa", "Bb", "c1", "été", "ñu", "漢字", "x"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 14, 30]) + 3 * (i % 2))) for i in range(40)]
    docs = []
    for i in range(120):
        text = say(rng.randrange(40))
        if i % 3 == 0:
            w = rng.choice(items)[1].split()
            at = rng.randrange(len(w))
            text = f"{text}, {'-'.join(w[at : at + rng.randrange(1, 15)])}! {say(5)}"
        docs.append((i, text))
    assert_leaks(spark, docs, items)
    assert_leaks(spark, docs, items, window=3)


def test_long_items_alone_and_odd_texts(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    again = " ".join(["go"] * 50)
    items = [(1, passage), (1, "second text of item one " * 3), (2, passage), (None, "no number has this item but it is hit all the same"), (3, None), (4, ""), (5, " ,;- "), (6, again), (11, passage.upper())]
    docs = [
        (1, None), (2, ""), (3, " \t,"), (4, passage), (4, passage), (5, passage), (None, passage), (None, "clean"),
        (6, " ".join(passage.split()[7:17])), (7, " ".join(passage.split()[7:16])),
        (8, "é".join(["x"] * 30) + " " + passage.replace(" ", "\n--\n").upper() + " tail"),
        (9, "NO number has this item but it is hit all the same?"), (10, "go " * 30_000), (11, "go " * 9), (12, " ".join(f"q{i}" for i in range(100_000)) + " " + passage),
    ]
    d, b = assert_leaks(spark, docs, items)
    kept = decontaminate.keep_clean(d, b)
    assert kept.columns == d.columns
    dirty = {i for (i, *_), (_, _, h, _) in zip(docs, leaks(docs, items), strict=True) if h and i is not None}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, t in docs if i not in dirty and t != passage)
    spans = {r["doc_id"]: r["spans"] for r in decontaminate.contamination(d, b).collect() if r["doc_id"] in (6, 8)}
    assert [tuple(s) for s in spans[6]] == [(0, 10)]
    assert [tuple(s) for s in spans[8]] == [(1, 60)]  # é is a letter here: one word before


def test_leaks_where_either_table_is_empty_and_by_shuffles(spark, monkeypatch):
    passage = " ".join(f"w{i}" for i in range(20))
    assert_leaks(spark, [(1, "some text"), (2, passage)], [(1, None)])
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert decontaminate.digests(none, items).count() == 0
    # what is too large to send is joined by shuffles
    monkeypatch.setattr(decontaminate, "MOST_SENT", 0)
    monkeypatch.setattr("corpusloom.llm.shared.BROADCAST_ROWS", 0)
    assert_leaks(spark, [(i, passage + f" {i % 7}") for i in range(700)] + [(900, "clean words")], [(1, passage), (2, "w3 w4")])


# ---- 12: the filter audit


def audit(docs, labels):
    """The audit by going through all orders for each document."""
    first = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for doc_id, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": doc_id is not None and first.get(t, doc_id) < doc_id,
        }
        rows.append((lang or "", {k for k, v in failed.items() if v}, doc_id in good, doc_id in toxic))
    out = {}
    for order in permutations("ABCDE"):
        for step, f in enumerate(order):
            before = set(order[:step])
            for part in {r[0] for r in rows}:
                own = [r for r in rows if r[0] == part]
                gone = [r for r in own if f in r[1] and not before & r[1]]
                out[part, "".join(order), step + 1] = [
                    sum(not (before | {f}) & r[1] for r in own), len(gone), sum(f in r[1] and bool(before & r[1]) for r in own),
                    sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
    total = defaultdict(int)
    for (part, order, step), v in out.items():
        total[part, order[step - 1]] += v[1]
    return sorted((p, o, s, *v, total[p, o[s - 1]]) for (p, o, s), v in out.items())


def assert_audit(spark, docs, labels):
    d = spark.createDataFrame([(i, t, lang, "x", 3) for i, t, lang in docs], "doc_id long, text string, lang string, mask string, n int").repartition(3)
    found = filter_audit.audit_documents(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in found.select(columns).collect()) == audit(docs, labels)


def test_audit_equals_all_orders(spark):
    rng = random.Random(3)
    docs = []
    for i in range(300):
        n = rng.choice([5, 90, 100, 130, 300])
        text = " ".join(rng.choice(["a%d", "B%d", "Cc%d", "#%d", "word%d", "word%d", "word%d"]) % rng.randrange(rng.choice([20, 1000])) for _ in range(n))
        if rng.random() < 0.7:
            text = text.replace("#", "")
        docs.append((i, text if rng.random() < 0.8 else docs[-1][1] if docs else "", rng.choice(["en", "de", None, ""])))
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 320, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1)]
    docs += [(None, docs[0][1], "en"), (None, None, None), (3, docs[3][1], "en"), (500, None, "de"), (501, "", "de"), (502, "WORD " * 40_000, "fr"), (503, " \n", "fr")]
    assert_audit(spark, docs, labels)


def test_audit_of_few_rows(spark):
    assert_audit(spark, [(1, "x", "en")], [])
    assert_audit(spark, [], [(1, 1, 1)])


def test_parity_sums_say_what_counts_by_mask_say(spark):
    rng = random.Random(1)
    rows = [("p", False, False, rng.randrange(32), rng.randrange(1, 9)) for _ in range(200)]
    want = [sum(r[4] for r in rows if r[3] == m) for m in range(32)]
    found = filter_audit.cells(spark.createDataFrame(rows, "part string, good boolean, toxic boolean, mask int, n long"), 5).first()
    assert found["all"] == want
    assert found["good"] == [0] * 32


# ---- 13: hard negatives


def negatives(rows, positives=5, negatives=10, anchor=lambda i: i is not None and i % 100 == 0):
    """By all pairs; rows are (vec_id, vector, label), labels as given."""
    own = [(i, [int(np.floor(256 * float(x))) for x in v], y) for i, v, y in rows if v is not None and y is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    order = lambda x: (-x[1], x[0] is None, x[0] or 0)
    for a in sorted({r[0] for r in own if anchor(r[0])}):
        _, q, label = min((r for r in own if r[0] == a), key=lambda r: (r[2], r[1]))
        met = [(i, sum(x * y for x, y in zip(q, v, strict=True)), kind) for i, v, kind in own if i != a and len(v) == len(q)]
        for p in sorted((m for m in met if m[2] == label), key=order)[:positives]:
            near = sorted((m for m in met if m[2] != label and 30 * p[1] <= 100 * m[1] <= 90 * p[1]), key=order)[:negatives]
            out += [(a, p[0], k, n[0], p[1], n[1]) for k, n in enumerate(near, 1)]
    return sorted(map(str, out))


def mined(spark, rows, **how):
    e = spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows], "vec_id long, embedding array<float>, label int, q string, rank int").repartition(4)
    own = hard_negatives.quantised(e, 256, F.col("vec_id"), F.col("label"), F.col("embedding"))
    return sorted(str(tuple(r)) for r in hard_negatives.mine(own, F.col("id") % 100 == 0, **how).collect())


def unit_rows(n, dims, labels, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims))
    kind = rng.integers(labels, size=n)
    v = centres[kind] + rng.normal(size=(n, dims)) * 1.2
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(int(i), [float(np.float32(x)) for x in v[i]], int(kind[i] if i % 5 else (kind[i] + 1) % labels)) for i in range(n)]


def test_negatives_equal_all_pairs(spark, monkeypatch):
    rows = unit_rows(700, 16, 4, 7)
    assert mined(spark, rows) == negatives(rows)
    assert mined(spark, rows, positives=2, negatives=3) == negatives(rows, 2, 3)
    # narrow digits and small waves: every round of the search is needed
    monkeypatch.setattr(hard_negatives, "GATHER", 1)
    monkeypatch.setattr(hard_negatives, "WAVE", 2)
    assert mined(spark, rows) == negatives(rows)


def test_negatives_where_scores_tie(spark, monkeypatch):
    """Hundreds of equal vectors: the digits of the numbers decide."""
    monkeypatch.setattr(hard_negatives, "GATHER", 12)
    rng = random.Random(2)
    ids = [0, 100, *rng.sample(range(101, 1 << 62), 500), *[-i for i in range(1, 60)]]
    rows = [(i, [0.5, 0.5] if k % 3 else [0.75, 0.5], k % 2) for k, i in enumerate(ids)]
    rows += [(None, [0.5, 0.5], 0), (None, [0.5, 0.5], 1), (None, [0.75, 0.5], 1), (7, [0.5, 0.5], 1), (7, [0.5, 0.5], 1)]
    assert mined(spark, rows) == negatives(rows)


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 0.0], 1), (0, [0.5, 0.5], 0), (1, [1.0, 0.25], 0), (2, None, 0), (3, [1.0, float("nan")], 0), (4, [1.0, float("inf")], 0), (5, [1.0, None], 0), (6, [1.0, 0.5], None),
        (8, [0.75, 0.5], 2), (9, [0.25, 0.1], 3), (10, [1.0], 0), (11, [], 0), (100, [], 0), (200, [-1.0, -1.0], 0), (12, [1.0, 0.25], 0), (300, [0.0, 0.0], 5), (13, [0.1, 0.1], 5),
    ]
    assert mined(spark, rows) == negatives(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1)]) == []
    large = [(i, [float(1 << 20), float(i)], i % 2) for i in range(0, 300, 25)]
    assert mined(spark, large) == negatives(large)
    with pytest.raises(ValueError, match="62 bits"):
        mined(spark, [(100, [1e30], 1), (1, [1e30], 1)])
