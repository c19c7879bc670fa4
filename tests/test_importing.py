"""Imports as one commit: batches, streams, replays, and what hangs on replaced notes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.chunking import Sizes
from corpusloom.operators.importing import TABLES, Library
from corpusloom.sources.storage import Conflict, scratch

TEXTS = ["First text.", "Second text.", "Third text.", "Fourth text.", "Last text."]
OLD = "# Title\n\n" + "\n\n".join(TEXTS)
NEW = OLD.replace("Second text.", "Second text, changed.").replace("\n\nLast text.", "")
SMALL = Sizes(1, 5, 1000, 0)  # a chunk for each paragraph


def files(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "uri string, content string")


def table(library, name):
    return sorted(map(tuple, library.rows(name).collect()), key=str)


def by_content(library):
    return {r["content"]: r["id"] for r in library.rows("notes").collect()}


def test_what_hangs_on_replaced_notes_follows(spark):
    library = Library.open(spark, scratch(spark, "library")).put(files(spark, one=OLD, two="# Other\n\nOther text."), sizes=SMALL)
    ids = by_content(library)
    assert sorted(ids) == sorted([*TEXTS, "Other text."])
    a, b, c, d, e = (ids[x] for x in TEXTS)
    other = ids["Other text."]
    library = library.changed({
        "mentions": (None, spark.createDataFrame([(a, "e1"), (b, "e1"), (c, "e2"), (d, "e2"), (e, "e3"), (other, "e1")], TABLES["mentions"][0])),
        "vectors": (None, spark.createDataFrame([(a, [1.0]), (b, [2.0]), (other, [3.0])], TABLES["vectors"][0])),
        "edges": (None, spark.createDataFrame([("x1", "supports", a, d, 0.5), ("x2", "supports", other, b, 0.4), ("x3", "related_to", e, other, 0.3), ("x4", "derived_from", other, other, 1.0), ("x5", "contradicts", b, c, 1.0)], TABLES["edges"][0])),
    })
    before = library
    library = library.put(files(spark, one=NEW, two="# Other\n\nOther text."), sizes=SMALL)
    new = by_content(library)
    assert sorted(new) == ["First text.", "Fourth text.", "Other text.", "Second text, changed.", "Third text."]
    assert new["Other text."] == other
    assert set(new.values()) & set(ids.values()) == {other}
    assert {(r["uri"], r["generation"], r["successful_generation"], r["status"]) for r in library.rows("sources").collect()} == {("one", 2, 2, "ready"), ("two", 1, 1, "ready")}
    first, second, third, fourth = (new[x] for x in ("First text.", "Second text, changed.", "Third text.", "Fourth text."))
    assert set(table(library, "mentions")) == {(first, "e1"), (third, "e2"), (fourth, "e2"), (other, "e1")}
    assert {(i, tuple(v)) for i, v in table(library, "vectors")} == {(first, (1.0,)), (other, (3.0,))}
    edges = {(r["edge_type"], r["from_id"], r["to_id"], r["confidence"]) for r in library.rows("edges").collect()}
    ends = tuple(sorted((second, third)))  # the order of a symmetric edge's ends goes by id
    assert {x if x[0] != "contradicts" else (x[0], *sorted(x[1:3]), x[3]) for x in edges} == {("supports", first, fourth, 0.5), ("supports", other, second, 0.4), ("derived_from", other, other, 1.0), ("contradicts", *ends, 1.0)}
    outcome = library.version.notes["outcome"]
    want = {"created_sources": 0, "updated_sources": 1, "unchanged_sources": 1, "created_notes": 4, "retired_notes": 5, "exact_successors": 3, "changed_successors": 1, "notes_without_successor": 1, "copied_mentions": 3, "reused_vectors": 1, "to_embed": 3, "lost_edges": 4, "moved_edges": 3}
    assert outcome == want
    # the version before is as it was
    assert by_content(Library(before.store, before.version)) == ids


def test_streams_and_batches_end_alike_and_replays_change_nothing(spark):
    batches = [{"a": "# A\n\nOne.", "b": "Two."}, {"a": "# A\n\nOne.", "c": None}, {"a": "# A\n\nOne, later.", "d": "# D\n\nx\n\n## E\n\ny"}]
    library = Library.open(spark, scratch(spark, "library"))
    for epoch, texts in enumerate(batches):
        library = library.put(files(spark, **texts), "s", epoch)
        again = library.put(files(spark, **texts), "s", epoch)
        assert again.version == library.version
    assert Library.open(spark, library.store.path).put(files(spark, a="older"), "s", 0).version == library.version
    once = Library.open(spark, scratch(spark, "library")).put(files(spark, a="# A\n\nOne, later.", b="Two.", c=None, d="# D\n\nx\n\n## E\n\ny"))
    plain = lambda x: sorted((r["uri"], r["ordinal"], tuple(r["heading_path"] or ()), r["content"]) for r in x.rows("notes").collect())
    assert plain(library) == plain(once)
    assert {r["uri"]: r["generation"] for r in library.rows("sources").collect()} == {"a": 2, "b": 1, "c": 1, "d": 1}


def test_a_stopped_import_leaves_nothing_and_two_writers_conflict(spark, monkeypatch):
    library = Library.open(spark, scratch(spark, "library")).put(files(spark, a="One."))
    monkeypatch.setattr(type(library.store), "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError, match="killed"):
        library.put(files(spark, a="Two."))
    monkeypatch.undo()
    assert sorted(by_content(Library.open(spark, library.store.path))) == ["One."]
    library.put(files(spark, b="Mine."))
    with pytest.raises(Conflict):
        library.put(files(spark, c="Theirs."))
    assert sorted(by_content(Library.open(spark, library.store.path))) == ["Mine.", "One."]


def test_odd_files_and_failed_sources(spark):
    odd = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "z"), ("b", ""), ("c", None)], "uri string, content string")
    library = Library.open(spark, scratch(spark, "library")).put(odd)
    assert {r["uri"] for r in library.rows("sources").collect()} == {"a", "b", "c"}
    assert library.rows("notes").count() == 1
    marked = library.failed("a")
    assert {r["uri"]: r["status"] for r in marked.rows("sources").collect()} == {"a": "failed", "b": "ready", "c": "ready"}
    assert marked.rows("notes").count() == 1
    forced = marked.put(odd.filter("uri = 'b'"), force=True)
    assert forced.rows("sources").filter("uri = 'b'").first()["generation"] == 2
    assert forced.put(spark.createDataFrame([], "uri string, content string")).rows("sources").count() == 3


def test_only_buckets_with_changes_are_written(spark):
    library = Library.open(spark, scratch(spark, "library")).put(spark.range(200).select(F.concat(F.lit("u"), "id").alias("uri"), F.concat(F.lit("text "), "id").alias("content")))
    after = library.put(files(spark, u7="changed"))
    old, new = (x.version.notes["live"]["notes"] for x in (library, after))
    assert sum(old[b] != new[b] for b in old) == 1
    assert after.rows("notes").count() == 200
