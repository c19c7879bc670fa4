"""The training-data operators against brute force, round trips and held-out labels, with the odd cases."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import components, divergence, exact_dedup, html_text, linear, mixing, near_join, pieces, quality, queries, shared, token_files, toxicity, warc
from corpusloom.llm.shared import scratch, table
from corpusloom.llm.text_features import lexical_features, training_sample, word_feature

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string, score double, size long"
ODD = [
    (1, None, None, None, None, "x", None, None),
    (2, "", "en", "b", 0, "x", 1.0, 1),
    (3, " \t\n", "en", "b", 3, None, None, None),
    (4, "same text  here", "en", "a", 1, "y", None, None),
    (5, "same  text here", "en", "a", 1, "y", None, None),
    (5, "same  text here", "en", "a", 1, "y", None, None),
    (6, "sametexthere", None, "a", 1, "y", None, None),
    (None, "no number", "en", "é", 1, "y", None, None),
    (7, "<|endoftext|>   x　y  z 's it's\r\n\n  漢字 𝔘 \x00 é", "ja", "b", 1, None, None, None),
    (8, "long " * 60_000, "en", "b", 1, None, None, None),
    (9, "one two three four", "en", "b", 1, None, None, None),
    (10, "one two three four", "en", "c", 1, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- 1: token files


def test_token_files_equal_the_library(spark, odd, empty):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    want, start = [], 0
    for doc_id, text in sorted(((r[0], r[1] or "") for r in ODD), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_files.tokens_through_files(odd, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_files.tokens_through_files(empty, path).count() == 0


def test_sequences_by_number(spark, sf, tmp_path):
    path = queries.vocabulary("byte_bpe_50k.json")
    manifest = token_files.write_tokens(table(spark, sf, "documents"), path, scratch(spark, "t"), length=64)
    shard = manifest.orderBy("shard").first()
    everything = [x for _, _, parts in token_files.shard_documents(shard["path"]) for p in parts for x in p.tolist()]
    for first, count in ((0, 1), (3, 2), (255, 3), (len(everything) // 64, 1)):
        ids, mask = token_files.read_sequences(shard["path"], first, count)
        flat = ids.reshape(-1)[mask.reshape(-1)].tolist()
        assert flat == everything[first * 64 : first * 64 + len(flat)]
        assert ids.shape[1] == 64


def test_every_sequence_of_a_shard_of_several_adds(tmp_path):
    length, ids = 64, np.random.default_rng(1).integers(0, 1 << 16, 64 * 700 + 5)
    shard = token_files.Shard(str(tmp_path), length, pa.uint16())
    for i, part in enumerate(np.split(ids, [64 * 257 + 7, 64 * 257 + 8, 64 * 530])):
        shard.add(pa.array([i]), part, np.array([len(part)]))
    shard.close()
    path = f"{tmp_path}/{shard.name}"
    for first in range(701):
        for count in (1, 300):
            got, mask = token_files.read_sequences(path, first, count)
            want = ids[first * length : (first + count) * length]
            assert got.shape == mask.shape == (min(count, 701 - first), length)
            assert np.array_equal(got[mask], want) and mask.sum() == len(want)
    assert len(token_files.read_sequences(path, 701, 1)[0]) == 0
    assert [np.concatenate(parts).tolist() for _, _, parts in token_files.shard_documents(path)] == [x.tolist() for x in np.split(ids, [64 * 257 + 7, 64 * 257 + 8, 64 * 530])]


def test_sequences_are_views_of_the_mapped_file(tmp_path):
    shard = token_files.Shard(str(tmp_path), 64, pa.uint16())
    shard.add(pa.array([1]), np.arange(64 * 600 + 3) % 60_000, np.array([64 * 600 + 3]))
    shard.close()
    sequences = token_files.Sequences(f"{tmp_path}/{shard.name}")
    sequences.source.seek(0)
    mapped = sequences.source.read_buffer()
    inside = range(mapped.address, mapped.address + mapped.size)
    before, seen = pa.total_allocated_bytes(), 0
    for ids, masks in sequences.views(100, 500):
        assert ids.__array_interface__["data"][0] in inside
        assert masks.values.buffers()[1].address in inside
        assert masks.values.type == pa.bool_()
        seen += len(ids)
    assert seen == 500
    assert len(sequences) == 601
    assert pa.total_allocated_bytes() == before


def test_scratch_space_is_cleared(spark, sf):
    from pathlib import Path
    from urllib.parse import urlsplit

    base = Path(urlsplit(spark.conf.get("spark.checkpoint.dir")).path)
    before = set(base.iterdir()) if base.exists() else set()
    with shared.scratch_space(spark):
        n = exact_dedup.exact_groups(table(spark, sf, "documents")).count()
        assert set(base.iterdir()) - before
    assert n > 0
    assert set(base.iterdir()) == before


# ---- 2: mixing


def test_knapsack_equals_brute_force():
    random.seed(1)
    for _ in range(200):
        lengths = random.sample(range(1, 12), random.randint(1, 4))
        spare = [random.randint(0, 3) for _ in lengths]
        budget = random.randint(0, 40)
        sums = {0}
        for length, n in zip(lengths, spare, strict=True):
            sums = {s + k * length for s in sums for k in range(n + 1)}
        taken = mixing.reachable(lengths, spare, budget)
        assert all(0 <= k <= n for k, n in zip(taken, spare, strict=True))
        assert sum(k * x for k, x in zip(taken, lengths, strict=True)) == max(s for s in sums if s <= budget)


def water(sizes: dict, weights=(3, 1, 2), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > cap * sizes[s]]
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            open_.remove(s)
        left = share * sum(sizes.values()) - sum(target.values())
    return target


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_mix_meets_its_targets(spark, sf, odd, which):
    docs = table(spark, sf, "documents") if which == "sf" else odd
    source = {}
    size = Counter()
    for r in docs.select("doc_id", "source", "text").collect():
        source[r["doc_id"]] = r["source"]
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    target = water(dict(size))
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    taken = Counter()
    longest = Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == size[s]
        assert r["target"] == pytest.approx(target[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
        longest[s] = max(longest[s], r["size"])
    for s in size:
        assert abs(taken[s] - target[s]) <= (0.02 * target[s] + 10 if which == "sf" else longest[s])
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))


@pytest.mark.parametrize("which", ["sf", "odd", "repeated"])
def test_mixture_has_the_words_that_the_mix_takes(spark, sf, odd, which):
    docs = table(spark, sf, "documents") if which == "sf" else odd
    if which == "repeated":
        docs = spark.createDataFrame([(1, f"a b c d {x}", "s", x) for x in "eeef"] + [(2, "g h", "s", "x")], "doc_id long, text string, source string, row string")
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    got = Counter()
    for r in out.collect():
        got[r["source"]] += len(WORD.findall(r["text"]))
    want = Counter()
    sources = {(r["doc_id"], len(WORD.findall(r["text"] or ""))): r["source"] for r in docs.collect()}
    for r in mixing.mix(docs).collect():
        want[sources[r["doc_id"], r["size"]]] += r["taken"]
    assert +got == +want
    rows = Counter(map(tuple, docs.collect()))
    assert all(n <= 2 * rows[tuple(r)] for r, n in Counter(map(tuple, out.collect())).items())


def test_mix_of_nothing_and_of_one_hot_length(spark, empty):
    assert mixing.mix(empty).count() == 0
    docs = spark.range(3000).selectExpr("id as doc_id", "'word word' as text", "if(id % 3 = 0, 'a', 'b') as source")
    rows = mixing.mix(docs).groupBy("source_size").agg({"taken": "sum", "target": "max"}).collect()
    for r in rows:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 2


# ---- 3: divergence


def test_divergence_counts_equal_brute_force(spark, odd, empty, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang").unionByName(odd.select("doc_id", "text", "lang"))
    texts = docs.collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in divergence.judge(docs).collect())
    want = Counter()
    for doc_id, text, _ in texts:
        text = text or ""
        words = WORD.findall(text)
        seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want[doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)] += 1
    assert got == want
    assert divergence.judge(empty).count() == 0


def divergence_brute(rows):
    """(doc_id, distance of characters, distance of words, kept) for rows of (doc_id, text, lang)."""
    import unicodedata

    def classes(word):
        out = [0] * 6
        for c in word:
            kind = unicodedata.category(c)
            at = 0 if kind == "Lu" else 1 if kind[0] == "L" else 2 if c in "0123456789" else 3 if c in "#*$%&|<>" else 4 if c in "!\"'()+,-./:;=?@[\\]^_`{}~" else 5
            out[at] += 1
        return np.array(out, float)

    def distance(p, q):
        p, q = p / p.sum(), q / q.sum()
        m = (p + q) / 2
        part = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x)
        return max(0.0, (part(p) + part(q)) / 2) ** 0.5

    words = [WORD.findall(text or "") for _, text, _ in rows]
    counts = defaultdict(Counter)
    for (_, _, lang), found in zip(rows, words, strict=True):
        counts[lang].update(w for w in found if any(unicodedata.category(c)[0] == "L" for c in w))
    common = {lang: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:32]] for lang, c in counts.items()}
    chars = [sum((classes(w) for w in found), np.zeros(6)) for found in words]
    commons = []
    for (_, _, lang), found in zip(rows, words, strict=True):
        c = Counter(found)
        here = [c[w] for w in common.get(lang, [])]
        commons.append(np.array([*here, len(found) - sum(here)], float))
    sums = defaultdict(float)
    for (_, _, lang), a, b in zip(rows, chars, commons, strict=True):
        sums["c", lang] = sums["c", lang] + a
        sums["w", lang] = sums["w", lang] + b
    out = []
    for (doc_id, _, lang), found, a, b in zip(rows, words, chars, commons, strict=True):
        seen = Counter(zip(found, found[1:], found[2:], strict=False))
        covered = {j for i in range(len(found) - 2) if seen[tuple(found[i : i + 3])] > 1 for j in range(i, i + 3)}
        failed = len(found) < 50 or 100 * len(covered) > 50 * len(found)
        js_chars = distance(a, sums["c", lang]) if a.sum() >= 200 else None
        js_words = distance(b, sums["w", lang]) if len(found) >= 100 and common.get(lang) else None
        out.append((doc_id, js_chars, js_words, not failed and (js_chars or 0) < divergence.MOST_CHARS and (js_words or 0) < divergence.MOST_WORDS))
    return out


def test_divergence_equals_brute_force(spark, sf, odd):
    more = [(901, "漢字 かな ﾊﾟ " * 60, "ja"), (902, "\ufffd\ufffd☺ ─── a+b" * 80, "en"), (903, "x " * 120, ""), (904, "y " * 120, None), (905, "Größe ähnlich Ähre nicht nicht " * 40, "de")]
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang").unionByName(odd.select("doc_id", "text", "lang")).unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    want = divergence_brute([tuple(r) for r in docs.collect()])
    got = [tuple(r) for r in divergence.judge(docs).select("doc_id", "js_chars", "js_words", "kept").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1])[:6])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[0] == b[0]
        assert a[3] == b[3]
        assert a[1:3] == tuple(None if x is None else pytest.approx(x, abs=2e-6) for x in b[1:3])


def test_divergence_tells_junk_from_prose(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    rows = divergence.judge(docs).join(labels, "doc_id").filter("not base_failed and n_words >= 100").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean(good) > 0.99
    assert np.mean(bad) < 0.2


# ---- 4: exact dedup


def exact_brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", text or "")].append((-len(text or ""), doc_id is None, doc_id))
    return {n: (min(g)[2], len(g)) for n, g in groups.items()}


def test_exact_groups(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 20)
    many = [(100 + i, random.choice(["hot text", "hottext", "hot  te xt"])) for i in range(300)] + [(900 + i, f"text {i // 2}") for i in range(60)]
    docs = odd.select("doc_id", "text", "extra").unionByName(spark.createDataFrame([(i, t, "e") for i, t in many], "doc_id long, text string, extra string"))
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = exact_brute(data)
    rows = exact_dedup.exact_groups(docs).collect()
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows)
    expected = Counter()
    for doc_id, text in data:
        norm = re.sub(r"[\x20\x09-\x0D]+", "", text or "")
        keep, n = want[norm]
        expected[doc_id, keep, n, doc_id == keep, hashlib.sha256(norm.encode()).hexdigest()] += 1
    assert got == expected
    kept = exact_dedup.keep_one(docs).collect()
    assert len(kept) == len(want)
    assert set(kept[0].asDict()) == {"doc_id", "text", "extra"}
    assert exact_dedup.exact_groups(empty).count() == 0


# ---- 5: near join


def near_brute(rows, n=5, threshold=0.8):
    sets = {}
    for i, (_, text) in enumerate(rows):
        w = WORD.findall(text or "")
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    links = defaultdict(set)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a].add(b)
                links[b].add(a)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in links:
        for b in links[a]:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    classes = defaultdict(list)
    for i in sets:
        classes[root(i)].append(i)
    least = {r: min((rows[i][0] for i in c if rows[i][0] is not None), default=None) for r, c in classes.items()}
    return Counter((rows[i][0], least[root(i)], len(links[i]), len(classes[root(i)])) for i in sets)


def variants(seed=4, families=12, size=14):
    random.seed(seed)
    rows = []
    for f in range(families):
        base = [f"w{f}_{k}" for k in range(random.randint(5, 120))]
        for _ in range(size):
            words = base.copy()
            for _ in range(random.randint(0, 3)):
                words[random.randrange(len(words))] = f"x{random.randrange(5)}"
            rows.append((1000 + len(rows), " ".join(words)))
    return rows


def test_near_classes(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(near_join, "BLOCK", 8)
    monkeypatch.setattr(near_join, "SMALL_BLOCK", 3)
    monkeypatch.setattr(shared, "HOT_ROWS", 3)
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(variants(), "doc_id long, text string"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter(tuple(r) for r in near_join.near_classes(docs).collect()) == near_brute(rows)
    assert near_join.near_classes(empty).count() == 0


def test_rows_without_a_number_meet_where_their_texts_are_alike(spark, monkeypatch):
    """Null and repeated doc_ids are no key: each node's set is made of its own row."""
    monkeypatch.setattr(near_join, "BLOCK", 8)
    monkeypatch.setattr(near_join, "SMALL_BLOCK", 3)
    texts = [t for _, t in variants(9, 5, 12)]
    rows = [(None if i % 3 else 7, t) for i, t in enumerate(texts)] + [(None, texts[0])] * 40 + [(7, texts[1])] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert Counter(tuple(r) for r in near_join.near_classes(docs).collect()) == near_brute(rows)


def test_blocks_meet_wherever_sets_may_link(spark, monkeypatch):
    """Every pair of sizes that can reach the threshold shares a pair of blocks."""
    monkeypatch.setattr(near_join, "BLOCK", 8)
    monkeypatch.setattr(near_join, "SMALL_BLOCK", 3)
    members = spark.range(150).selectExpr("1L as family", "150L as n", "cast(5 + id * id / 40 as int) as size", "cast(id as string) as node")
    rows = near_join.blocks_of(members, 0.8).collect()
    assert len(rows) == 150
    for a in rows:
        assert a["block"] in a["others"]
        for b in rows:
            meet = b["block"] in a["others"]
            assert meet == (a["block"] in b["others"])
            assert meet or min(a["size"], b["size"]) < 0.8 * max(a["size"], b["size"])
    assert any(b["block"] not in a["others"] for a in rows for b in rows)


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, rows = near_join.choose_bands(threshold, 0.9999)
        assert 1 - (1 - threshold**rows) ** bands >= 0.9999
        assert bands * rows <= 200


@pytest.mark.parametrize("hot", [500, 4])
def test_components(spark, monkeypatch, hot):
    monkeypatch.setattr(shared, "HOT_ROWS", hot)
    random.seed(9)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(400, i) for i in range(401, 460)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == want


# ---- 6 and 9: classifiers


def test_dual_coordinate_descent_equals_plain_descent():
    """The weights against a subgradient method on the same problem."""
    random = np.random.default_rng(5)
    rows = [np.flatnonzero(random.random(12) < 0.4) for _ in range(80)]
    signs = np.where(np.array([(r < 4).sum() + random.random() for r in rows]) > 1.8, 1.0, -1.0)
    values, cost = random.uniform(-2, 2, 12), np.full(80, 0.1)
    x = np.zeros((80, 13))
    for i, r in enumerate(rows):
        x[i, r], x[i, 12] = values[r], 1

    def loss(w):
        return 0.5 * w @ w + (cost * np.maximum(0, 1 - signs * (x @ w))).sum()

    weights, bias = linear.dual_coordinate_descent(rows, values, signs, cost, epochs=400)
    got = np.append(np.where(values != 0, weights / values, 0), bias)
    w = np.zeros(13)
    best = np.inf
    for t in range(1, 20_001):
        w = w - (w - x.T @ (cost * signs * (signs * (x @ w) < 1))) / (t + 10)
        best = min(best, loss(w))
    assert loss(got) <= best + 1e-3


def test_dual_coordinate_descent_separates():
    random = np.random.default_rng(0)
    rows = [np.sort(random.choice(20, 5, replace=False)) + (20 if y else 0) for y in (0, 1) * 50]
    y = np.array((0.0, 1.0) * 50)
    model = linear.fit(rows, y, y, 40, least_z=1.0)
    scores = model.score(np.array([model.bias + model.weights[r].sum() for r in rows]))
    assert ((scores > 0.5) == (y > 0.5)).all()


def test_features_of_one_class_only_count():
    toxic, clean = 300, 2_700
    hits = [(5, 0), (0, 60), (5, 45), (1, 0), (30, 30)]  # toxic and clean rows with each feature
    rows = [np.array([j for j, (a, _) in enumerate(hits) if i < a], np.int64) for i in range(toxic)]
    rows += [np.array([j for j, (_, b) in enumerate(hits) if i < b], np.int64) for i in range(clean)]
    target = np.array([1.0] * toxic + [0.0] * clean)
    assert np.sign(linear.log_count_ratios(rows, target, 5, 3.0)).tolist() == [1, -1, 0, 0, 1]


def test_all_voters_are_kept():
    rows = [np.array([i // 6]) for i in range(3_600)] + [np.array([5_000])] * 20_000
    assert len(toxicity.mine_voters(rows, np.array([1.0] * 3_600 + [0.0] * 20_000))) == 600


def test_posterior_equals_brute_force():
    shares, rates = np.array([0.8, 0.15, 0.05]), np.array([[0.05, 0.1, 0.02], [0.6, 0.5, 0.1], [0.2, 0.1, 0.7]])
    model = toxicity.LabelModel(shares, rates)
    votes = np.array([[a, b, c] for a in (0, 1) for b in (0, 1) for c in (0, 1)], bool)
    joint = np.array([[s * np.prod([q if v else 1 - q for q, v in zip(qs, row, strict=True)]) for s, qs in zip(shares, rates, strict=True)] for row in votes])
    assert np.allclose(model.posterior(votes), joint[:, 1:].sum(axis=1) / joint.sum(axis=1), atol=1e-5)
    assert np.allclose(model.accuracies(), [joint[votes[:, j], 1:].sum() / joint[votes[:, j]].sum() for j in range(3)])
    toxic = joint[:, 1:].sum(axis=1) / joint[:, 1:].sum()
    mean = toxic @ votes
    both = np.array([[toxic @ (votes[:, i] & votes[:, j]) for j in range(3)] for i in range(3)])
    want = (both - np.outer(mean, mean)) / np.sqrt(np.outer(mean * (1 - mean), mean * (1 - mean)))
    off = ~np.eye(3, dtype=bool)
    assert np.allclose(model.correlations()[off], want[off])


def test_label_model_learns_from_votes_alone():
    random = np.random.default_rng(3)
    kind = random.choice(3, 20_000, p=[0.9, 0.07, 0.03])  # clean, and two kinds of toxic whose voters differ
    rates = np.full((3, 12), 0.003)
    rates[1, :6], rates[2, 6:11] = 0.5, 0.6
    rates[:, 11] = 0.001, 0.3, 0.3
    votes = random.random((20_000, 12)) < rates[kind]
    model = toxicity.fit_label_model(votes)
    assert ((model.posterior(votes) >= 0.5) == (kind > 0)).mean() > 0.99
    assert 1 - model.shares[0] == pytest.approx(0.1, abs=0.01)
    true = np.array([(kind[votes[:, j]] > 0).mean() for j in range(12)])
    assert np.abs(model.accuracies() - true).max() < 0.05
    assert model.correlations()[0, 1] > 0.2 > -0.2 > model.correlations()[0, 7]


def test_posterior_against_labels(spark):
    """The posterior is the votes' own: it differs from given labels, on training and on held-out documents, and is near both."""
    sf = "/root/testdata/sf0.1"
    rows, target = training_sample(table(spark, sf, "documents"), table(spark, sf, "labels"), "toxic", lexical_features, 12_000, 12_000)
    known = ~np.isnan(target)
    assert 0 < (~known).sum()
    lexicons = [np.array([word_feature(w) for w in words.split()]) for words in toxicity.LEXICONS.values()]
    votes = toxicity.vote(rows, lexicons, toxicity.mine_voters([rows[i] for i in np.flatnonzero(known)], target[known]))
    named = toxicity.fit_label_model(votes).posterior(votes)[known] >= 0.5
    toxic = target[known] > 0
    assert (named != toxic).any()
    assert (named & toxic).sum() > 0.9 * toxic.sum()
    assert (named & ~toxic).sum() < 0.05 * toxic.sum()


@pytest.mark.parametrize("block", [7, 512])
def test_label_model_over_all_documents_equals_that_in_memory(spark, monkeypatch, block):
    """Votes of whole texts, grouped and summed in Spark, against the same votes as one matrix."""
    monkeypatch.setattr(toxicity, "VOTER_BLOCK", block)
    draw = random.Random(4)
    lists = [["idiot", "moron", "loser", "scum"], ["salaud", "bouffon", "ordure"]]
    plain = "the a of river tree stone green cloud".split()
    texts = []
    for _ in range(600):
        kind = draw.random()
        own = draw.sample(lists[kind < 0.1], 2) if kind < 0.2 else draw.sample(lists[0], 1) if kind > 0.98 else []
        texts.append(" ".join(draw.choices(plain, k=6) + own))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None), (None, "")], "doc_id long, text string")
    voters = toxicity.Voters.of([np.array([word_feature(w) for w in words]) for words in lists], np.array([word_feature(w) for w in ("river", "absent", "tree", "idiots")]))
    there = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 4 != 2] + ["", ""]
    rows = [np.sort(lexical_features(pa.array([t]))[1]) for t in there]
    votes = toxicity.all_votes(rows, voters)
    for row, text in zip(votes, there, strict=True):
        words = text.split()
        assert [row[np.flatnonzero(voters.features == word_feature(w))[0]] for w in ("idiot", "river", "scum")] == ["idiot" in words, "river" in words, "scum" in words]
        assert list(row[-2:]) == [len(set(words) & set(x)) > 1 for x in lists]
    table_ = toxicity.vote_table(docs, voters)
    assert table_.agg({"n": "sum"}).first()[0] == len(there)
    kept, kinds = toxicity.voters_that_count(table_, len(voters))
    fires = [tuple(c) for c in votes.T]
    assert kept.tolist() == [i for i, c in enumerate(fires) if any(c) and c not in fires[:i]]
    assert kinds.tolist() == toxicity.kinds_of(votes[:, kept]).tolist()
    got, want = toxicity.fit_to_table(table_, len(voters), kept, kinds), toxicity.fit_label_model(votes[:, kept])
    assert got.shares == pytest.approx(want.shares, abs=1e-9)
    assert got.rates == pytest.approx(want.rates, abs=1e-9)


def test_a_sample_has_a_row_for_each_document(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(60)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (None, 1)], "doc_id long, toxic int")
    rows, target = training_sample(docs, labels, "toxic", lexical_features, 10, 10)
    assert sorted(map(str, target)) == ["0.0", "1.0", "nan"]
    assert len(training_sample(docs, labels, "toxic", lexical_features, 1)[0]) == 1


@pytest.mark.parametrize(("operator", "label", "least"), [(quality, "quality", 0.97), (toxicity, "toxic", 0.97)])
def test_held_out_ranking(spark, operator, label, least):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    rows = operator.classify(docs, docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good, bad = (np.array([r["score"] for r in rows if r[label] == y]) for y in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2 > least
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


@pytest.mark.parametrize(("operator", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_odd_rows(spark, odd, empty, operator, label):
    labels = spark.createDataFrame([(i, i % 2 if i != 9 else None) for i in range(12)], f"doc_id long, {label} int")
    rows = operator.classify(odd, odd, labels).collect()
    assert len(rows) == len(ODD)
    assert all(0 <= r["score"] <= 1 and r["extra"] in ("x", "y", None) for r in rows)
    assert operator.classify(empty, odd, labels).count() == 0
    nothing = operator.classify(odd, odd, labels.filter("false")).first()
    assert nothing["score"] == 0.5


def test_keeping_good_documents_leaves_their_columns_alone(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    named = docs.selectExpr("doc_id", "text", "-5.0D as score", "77 as predicted", "'no' as held_out", "doc_id as __score")
    rows = quality.keep_good(named, docs, labels).collect()
    assert {tuple(r)[2:5] for r in rows} == {(-5.0, 77, "no")}
    assert all(r["__score"] == r["doc_id"] for r in rows)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in quality.classify(docs, docs, labels).filter("predicted = 1").collect()}


# ---- 7: HTML


@pytest.mark.parametrize(("page", "text"), [
    (None, ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>a<p>b<br>c", "a\n\nb\nc"),
    ("<ul><li>x<li>y<ol start=3><li>k<li>l</ol></ul>z", "- x\n- y\n  3. k\n  4. l\n\nz"),
    ("<table><tr><th>A<th>Bee<tr><td>12<td>two</table>", "A  | Bee\n12 | two"),
    ("<div hidden>no</div><span style='display: none'>n</span><b aria-hidden=true>q</b>yes", "yes"),
    ("<head><title>t</title></head><body>b<script>var a='</p>'</script><style>p{}</style><!-- c --></body>", "b"),
    ("<pre>  q\n   r</pre>", "  q\n   r"),
    ("a</nothing>b<p>c</div>d", "ab\n\ncd"),
    ("<div><p>one</div>two", "one\n\ntwo"),
    ("x < y <3 <", "x < y <3 <"),
])
def test_rendering(page, text):
    assert html_text.visible_text(page) == text


@pytest.mark.parametrize(("page", "text"), [
    ("a<select><option>one<option>two<optgroup label='More &amp; more'><option label=three>3<optgroup label=Last><option>four</select>z", "a\none\ntwo\nMore & more\nthree\nLast\nfour\nz"),
    ("x <math><semantics><mrow><mi>a</mi><mo>=</mo><mn>2</mn></mrow><annotation>a=2</annotation></semantics></math> y", "x a=2 y"),
    ("<svg><title/><defs><text>no</text></defs><text x=1>A</text><text>B<tspan>C</tspan></text><style>t{}</style></svg>z <text>i</text>n", "A\nBC\nz in"),
    ("<p>a<xmp> <b> &amp;\n  c</xmp>d", "a\n\n <b> &amp;\n  c\n\nd"),
    ("<table><tr>stray<td>1</td> too <td>2</td></tr></table>", "stray\ntoo\n1 | 2"),
    ("<p title=it's>Visible text isn't lost</p>", "Visible text isn't lost"),
    ("<p title=a'hidden class = 'x > y' data-q=\"it's>\">b</p>", "b"),
    ("<p title=\"open>kept", "kept"),
])
def test_all_visible_text_is_rendered(page, text):
    assert html_text.visible_text(page) == text


@pytest.mark.parametrize(("page", "text"), [
    ("<table><tr><td colspan=2>wide<td>c<tr><td>aaa<td>b<td>d</table>", "wide    | c\naaa | b | d"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>cc<tr><td>d<td>e</table>", "a | b\n  | cc\nd | e"),
    ("<table><tr><td>|<td><tr><td><td></table>", "| |"),
    ("<ul><li><p>one<p>two<ul><li>x<p>y</ul></ul>z", "- one\n\n  two\n\n  - x\n\n    y\n\nz"),
    ("<a x='q>' <a y='>kept", "kept"),
    ("a<b", "a<b"),
    ("<!-- never ended", ""),
    ("</1>x</>y<?z>", "xy"),
])
def test_layout(page, text):
    assert html_text.visible_text(page) == text


def laid_out(rows):
    """Every place of a grid by itself: where a cell's column begins, and its whole text there."""
    taken, cells = set(), []
    for y, row in enumerate(rows):
        x = 0
        for text, wide, tall in row:
            while (y, x) in taken:
                x += 1
            taken |= {(y + j, x + i) for j in range(tall) for i in range(wide)}
            cells.append((y, x, x + wide, text))
            x += wide
    width = {}
    for _, x, end, text in cells:
        if end == x + 1:
            width[x] = max(width.get(x, 0), len(text))
    return [(y, sum(width.get(i, 0) + 3 for i in range(x)), text) for y, x, _, text in cells]


@pytest.mark.parametrize("seed", range(30))
def test_cells_begin_where_their_columns_do(seed):
    """Tables with spans, long sentences and many columns against a layout place by place."""
    draw = random.Random(seed)
    columns = draw.choice([2, 3, 8, 100])
    rows, taken = [], set()
    for y in range(draw.randint(2, 12)):
        row, x = [], 0
        while x < columns:
            if (y, x) in taken:
                x += 1
                continue
            free = next((i for i in range(x, columns) if (y, i) in taken), columns) - x
            wide, tall = (draw.randint(1, min(3, free)), draw.randint(1, 3)) if y and draw.random() < 0.2 else (1, 1)
            taken |= {(y + j, x + i) for j in range(tall) for i in range(wide)}
            size = draw.choice([1, 9, 80]) if wide == 1 else 1
            row.append(("x" * (size if y else 80), wide, tall))
            x += wide
        if row:
            rows.append(row)
        else:
            rows.append([("x", 1, 1)])
    lines = html_text.aligned_rows(rows)
    assert len(lines) == len(rows)
    for y, at, text in laid_out(rows):
        assert lines[y][at : at + len(text)] == text
        assert at == 0 or lines[y][at - 3 : at] == " | "


def test_padding_keeps_to_the_text():
    """One long cell in a column of short ones isn't aligned with them; the others are, and nothing is cut."""
    rows = [[("k" * (i % 7 + 1), 1, 1), ("w" * 5_000 if i == 3 else "v" * (i % 5 + 1), 1, 1), ("z", 1, 1)] for i in range(200)]
    lines = html_text.aligned_rows(rows)
    assert {line.index("v") for i, line in enumerate(lines) if i != 3} == {10}
    assert {line.index("z") for i, line in enumerate(lines) if i != 3} == {18}
    assert "w" * 5_000 in lines[3]
    assert sum(map(len, lines)) < 12 * sum(len(t) + 3 for row in rows for t, _, _ in row)


@pytest.mark.parametrize("page", [
    "<a " * 40_000,
    "<a " * 40_000 + "q='>'",
    "<b>" * 20_000 + "</x>" * 20_000,
    "<b><table>" + "<i>" * 20_000 + "</b>" * 20_000,
    "<p><table>" + "<b>" * 20_000 + "</p>" * 20_000,
    "<svg>" + "<g>" * 20_000 + "<text>t</text>" * 10_000,
    "<table><tr><td>" + "w" * 30_000 + "<tr><td>x<td>y" * 10_000,
    "<table><tr>" + "<td rowspan=60000 colspan=3>a" * 5_000 + "<tr><td>b" * 10_000,
    "<table><tr>" + "<td rowspan=60000>a" * 60 + "<tr><td>b" * 10_000,
    "<table>" + "<tr>" + "".join(f"<td rowspan={i + 2}>a" for i in range(8_000)) + "<tr><td>b" * 8_000,
    "<table>" + "<tr><td colspan=1000 rowspan=60000>a" * 20_000,
    "<table>" + "".join("<tr>" + "<td>" * (i % 300) + "w" * i for i in range(600)),
    "<ul><li>x" * 20_000,
    "<p a='" * 20_000,
    "<!-" * 60_000,
])
def test_hostile_pages_take_linear_time_and_room(page):
    import time

    began = time.perf_counter()
    text = html_text.visible_text(page)
    assert time.perf_counter() - began < 5
    assert len(text) < 32 * len(page)


def test_words_equal_those_of_the_library_parser(spark, sf):
    """The words of each page, in order, against a reading by the standard parser; marks of layout aside."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.hidden, self.words = [], []

        def handle_starttag(self, tag, attrs):
            named = dict(attrs)
            if tag in html_text.VOID:
                self.words.append(" ")
            elif self.hidden or tag in html_text.NEVER_SHOWN or "hidden" in named or named.get("aria-hidden") == "true" or html_text.HIDING_STYLE.search(named.get("style") or ""):
                self.hidden.append(tag)
            elif tag in html_text.BLOCKS:
                self.words.append(" ")

        def handle_endtag(self, tag):
            if tag in self.hidden:
                while self.hidden.pop() != tag:
                    pass
            elif tag in html_text.BLOCKS:
                self.words.append(" ")

        def handle_data(self, data):
            if not self.hidden:
                self.words.append(data)

    def words(text):
        return [w for w in text.split() if not re.fullmatch(r"[-|]|\d+\.", w)]

    pages = [r["html"] for r in table(spark, sf, "pages").collect()]
    assert pages
    for page in pages:
        reader = Reader()
        reader.feed(page)
        reader.close()
        assert words(html_text.visible_text(page)) == words("".join(reader.words))


def test_rendering_of_deep_and_broken_pages(spark, empty):
    assert html_text.visible_text("<div>" * 20_000 + "deep") == "deep"
    assert html_text.visible_text("<table><tr><td>" * 2_000 + "x").strip(" |") == "x"
    assert html_text.visible_text("<p>" + "w " * 200_000).count("w") == 200_000
    pages = spark.createDataFrame([(1, None, "old"), (2, "<p>a", None)], "page_id long, html string, text string")
    assert {tuple(r) for r in html_text.extract(pages).collect()} == {(1, None, ""), (2, "<p>a", "a")}
    assert html_text.extract(pages.filter("false")).count() == 0


# ---- 8: pieces


def brute_pieces(model, text):
    marked = "▁" + text.replace(" ", "▁") if text else ""
    known = {p: i for i, p in enumerate(model.pieces) if model.piece_scores[i] or i in model.ends}
    known = {p: i for p, i in known.items() if i not in set(model.byte_ids.tolist()) and i > 2}
    best = [(-np.inf, 0, None)] * (len(marked) + 1)
    best[0] = (0.0, 0, None)
    longest = max(map(len, known))
    for j in range(1, len(marked) + 1):
        for n in range(min(longest, j), 0, -1):
            i = known.get(marked[j - n : j])
            if i is not None and best[j - n][0] + model.piece_scores[i] > best[j][0]:
                best[j] = (best[j - n][0] + model.piece_scores[i], n, i)
        if marked[j - 1] not in known and best[j - 1][0] + model.unknown_score > best[j][0]:
            best[j] = (best[j - 1][0] + model.unknown_score, 1, None)
    out, j = [], len(marked)
    while j:
        _, n, i = best[j]
        out += [i] if i is not None else [int(model.byte_ids[b]) for b in reversed(marked[j - 1].encode())]
        j -= n
    return out[::-1]


def test_pieces_equal_brute_force_and_come_back(spark, odd, empty, sf):
    path = queries.vocabulary("piece_bpe_32k.model")
    model = pieces.model(path)
    docs = odd.filter("doc_id <> 8").select("doc_id", "text", "extra").unionByName(table(spark, sf, "documents").limit(20).selectExpr("doc_id + 1000 as doc_id", "substring(text, 1, 300) as text", "lang as extra"))
    rows = pieces.decode(pieces.encode(docs, path), path).collect()
    for r in rows:
        assert list(r["piece_ids"]) == brute_pieces(model, r["text"] or "")
        assert r["decoded"] == (r["text"] or "")
    long = pieces.decode(pieces.encode(odd.filter("doc_id = 8").select("text"), path), path).first()
    assert long["decoded"] == long["text"]
    got = {(r["doc_id"], r["n_pieces"], r["ids_crc32"], r["round_trip"]) for r in pieces.digests(docs, path).collect()}
    assert got == {(r["doc_id"], len(r["piece_ids"]), zlib.crc32(np.array(r["piece_ids"], "<u4").tobytes()), True) for r in rows}
    assert pieces.encode(empty, path).count() == 0


def test_a_long_run_without_spaces():
    model = pieces.model(queries.vocabulary("piece_bpe_32k.model"))
    ids, counts, _ = model.encode(pa.array(["x" * 30_000, "é" * 3_000]))
    assert model.decode(ids, counts).to_pylist() == ["x" * 30_000, "é" * 3_000]


# ---- 10: WARC


def test_captures_come_back(spark):
    pages = [(1, "http://a/\r\nx", "<p>é"), (2, None, "<p>é"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (5, "http://e", "twice"), (5, "http://e", "twice"), (None, "http://n", "<p>é"), (6, "u", "y" * 300_000)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, target_uri string").repartition(3)
    rows = warc.through_archives(df, payloads=True).collect()
    first = {}
    for i, _, h in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        first.setdefault(h or "", i)
    want, got = Counter(), Counter()
    for i, _, h in pages:
        raw = (h or "").encode()
        kind = "response" if first[h or ""] == i else "revisit"
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, None if kind == "response" else first[h or ""], raw if kind == "response" else None] += 1
    for r in rows:
        fields = r["metadata"]["fields"]
        number = lambda k: int(fields[k]) if k in fields else None
        payload = r["response"]["payload"]
        got[number("page-id"), r["response"]["payload_bytes"], r["response"]["payload_digest"], r["response"]["record_type"], number("refers-to-page-id"), bytes(payload) if payload is not None else None] += 1
        assert r["request"]["target_uri"] == r["response"]["target_uri"]
    assert got == want
    assert warc.through_archives(df.filter("false")).count() == 0
    small = warc.through_archives(df, least_bytes=10).filter("response.record_type = 'revisit'").count()
    assert small == 0


def foreign(*records, packed=False, version="1.0"):
    """An archive by hand: (type, id, several concurrent-to, block)."""
    out = b""
    for kind, number, concurrent, block in records:
        head = [f"WARC/{version}", f"warc-type: {kind}", f"WARC-Record-ID:<{number}>", "WARC-Target-URI: http://x", *(f"WARC-Concurrent-To: <{c}>" for c in concurrent), f"Content-Length: {len(block)}"]
        one = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
        out += gzip.compress(one) if packed else one
    return out


HTTP = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"


@pytest.mark.parametrize("packed", [True, False])
def test_foreign_archives(spark, tmp_path, packed):
    files = {
        "chain": foreign(("warcinfo", "w", [], b"x"), ("response", "r1", [], HTTP + b"one"), ("request", "q1", ["r1"], b"GET /"), ("metadata", "m1", ["q1"], b"page: 1\r\npage: 2\r\nlong: a\r\n b"), packed=packed),
        "several": foreign(("metadata", "m2", ["q2", "r2"], b"k:v"), ("request", "q2", ["r2", "m2"], b"GET /"), ("response", "r2", ["q2"], HTTP + b"\r\n\r\ntwo"), packed=packed, version="1.1"),
        "missing": foreign(("request", "q3", ["r3"], b"GET /"), ("metadata", "m3", ["r3"], b""), ("revisit", "r4", [], b"HTTP/1.1 200 OK\r\n"), ("resource", "r5", [], b"plain"), packed=packed),
        "repeated": foreign(("response", "r1", [], HTTP + b"one"), ("request", "q1", ["r1"], b"GET /"), ("conversion", "c5", ["r5"], b"text"), packed=packed),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    paths = spark.createDataFrame([(f"file://{tmp_path}/{name}",) for name in files], "path string")
    rows = warc.assemble(warc.read_records(paths)).collect()
    short = lambda part, of: part and part[of]
    got = sorted((str(short(r["response"], "record_id")), str(short(r["request"], "record_id")), str(short(r["metadata"], "record_id")), r["n_records"]) for r in rows)
    assert got == [("<r1>", "<q1>", "<m1>", 5), ("<r2>", "<q2>", "<m2>", 3), ("<r4>", "None", "None", 1), ("<r5>", "None", "None", 2), ("None", "<q3>", "<m3>", 2)]
    by = {short(r["response"], "record_id"): r for r in rows}
    assert by["<r1>"]["metadata"]["fields"] == {"page": "1\n2", "long": "a b"}
    assert bytes(by["<r1>"]["response"]["payload"]) == b"one"
    assert bytes(by["<r2>"]["response"]["payload"]) == b"\r\n\r\ntwo"
    assert by["<r4>"]["response"]["payload_bytes"] is None
    assert (bytes(by["<r5>"]["response"]["payload"]), by["<r5>"]["response"]["record_type"]) == (b"plain", "resource")


def test_an_archive_that_is_cut_off(spark, tmp_path):
    (tmp_path / "cut").write_bytes(foreign(("response", "r1", [], HTTP + b"one"))[:-9])
    paths = spark.createDataFrame([(f"file://{tmp_path}/cut",)], "path string")
    with pytest.raises(Exception, match="doesn't end where its length says"):
        warc.read_records(paths).collect()


def test_a_payload_of_very_many_pages(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 20)
    pages = spark.range(200).selectExpr("id as page_id", "'http://x' as url", "if(id % 3 = 0, null, if(id % 3 = 1, 'same', concat('p', id div 6))) as html")
    rows = warc.through_archives(pages).select("metadata.fields", "response.record_type").collect()
    first = {}
    for i in range(200):
        first.setdefault("" if i % 3 == 0 else "same" if i % 3 == 1 else f"p{i // 6}", i)
    responses = {int(r["fields"]["page-id"]) for r in rows if r["record_type"] == "response"}
    assert responses == set(first.values())
    assert len(rows) == 200
