"""Plain functions: extractor answers, addresses, leases, identities, manifests."""

from __future__ import annotations

import pytest

from corpusloom.functions.extraction import parse
from corpusloom.functions.uris import file_uri
from corpusloom.operators import jobs, portable


@pytest.mark.parametrize(("answer", "names"), [
    ('{"entities": [{"name": "Ada", "type": "person"}, {"entity": "ada"}, {"text": "B"}]}', ["Ada", "B"]),
    ('Sure!\n```json\n{"entities": ["A", "B"]}\n```\nDone', ["A", "B"]),
    ('[{"name": "A"}, {"name": "B", "x": "}"}, {"na', ["A", "B"]),
    ('{"entities": {"A": "org", "B": {}}}', ["A", "B"]),
    ('{"name": "A"}', ["A"]),
    ("no json here", []),
    ("", []),
    ('{"entities": [1, null, {"name": " "}]}', []),
])
def test_answers(answer, names):
    assert [n for n, _ in parse(answer)[0]] == names


def test_relationships():
    found = parse('{"entities": [], "relationships": [{"source": "A", "target": "B", "relationship_type": "uses"}, {"source": "A"}, {"from": "C", "to": "D"}]}')
    assert found[1] == [("A", "B", "uses"), ("C", "D", "related_to")]


@pytest.mark.parametrize(("path", "uri"), [
    ("/a/./b/../c d.md", "file:///a/c%20d.md"),
    ("file:///a/c%20d.md", "file:///a/c%20d.md"),
    (r"c:\Users\x.md", "file:///C:/Users/x.md"),
    (r"\\Server\share\x.md", "file://server/share/x.md"),
    ("https://a/b", "https://a/b"),
    ("file://localhost/a", "file:///a"),
])
def test_file_uris(path, uri):
    assert file_uri(path) == uri
    assert file_uri(uri) == uri


def test_retries():
    assert jobs.retryable(None, True) and jobs.retryable(503) and jobs.retryable(429) and not jobs.retryable(400)
    delays = [jobs.retry_delay(i, "k") for i in range(8)]
    assert all(0 < d <= 6 for d in delays)
    assert delays == [jobs.retry_delay(i, "k") for i in range(8)]


def test_identities():
    mine = {"provider": "p", "model": "m", "dimension": 3}
    assert [jobs.identity_state(*x) for x in ((None, mine, 0), (None, mine, 2), (mine, mine, 2), (mine | {"dimension": 4}, mine, 2))] == ["empty", "legacy", "matching", "mismatch"]


def test_manifests():
    good = {"format": portable.FORMAT, "format_version": 1, "includes_embeddings": False}
    assert portable.manifest_problems(good) == []
    assert portable.manifest_problems(good | {"includes_embeddings": True, "payload": "../x", "format_version": 9}) == ["unknown version", "vectors and their identity must come together", "unsafe path"]


def test_stable_vectors():
    assert jobs.fnv_vector("a", 3) == jobs.fnv_vector("a", 3) != jobs.fnv_vector("b", 3)
    assert all(-1 <= x < 1 for x in jobs.fnv_vector("text", 8))
