"""Archives as a data source: what is written comes back, and whatever is wrong is found."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import portable
from corpusloom.sources import archive
from corpusloom.sources.storage import Versions

SCHEMAS = {"source": "id string, uri string", "note": "id string, content string, source_id string, score double"}
REFERENCES = {"note": {"source_id": "source"}}


@pytest.fixture
def tables(spark):
    notes = spark.range(500).select(
        F.concat(F.lit("note:"), "id").alias("id"), F.when(F.col("id") % 7 != 0, F.concat(F.lit('text "é"\n '), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")))).alias("content"),
        F.concat(F.lit("source:"), F.col("id") % 3).alias("source_id"), (F.col("id") / 4).alias("score"), F.lit("s").alias("api_key"),
    ).repartition(3)
    sources = spark.range(3).select(F.concat(F.lit("source:"), "id").alias("id"), F.concat(F.lit("https://x/"), "id").alias("uri"))
    return {"note": notes, "source": sources}


def test_round_trip_by_one_version(spark, tables, tmp_path):
    path, target = f"file://{tmp_path}/a", f"file://{tmp_path}/library"
    manifest = archive.export(tables, path)
    assert manifest["record_counts"] == {"note": 500, "source": 3}
    assert sum(p["records"] for p in manifest["payloads"]) == 503
    assert manifest["bytes"] == sum((tmp_path / "a" / p["name"]).stat().st_size for p in manifest["payloads"])
    text = "".join((tmp_path / "a" / p["name"]).read_text() for p in manifest["payloads"])
    ids = [json.loads(x)["record"]["id"] for x in text.splitlines()]
    assert ids == sorted(ids)
    assert "api_key" not in text
    assert not any(p.name.startswith(".") and not p.name.endswith(".crc") for p in (tmp_path / "a").iterdir())
    version = archive.restored(spark, path, target, SCHEMAS, REFERENCES)
    for name, rows in tables.items():
        kept = rows.drop("api_key")
        assert sorted(map(tuple, Versions(spark, target).read(name, version).select(kept.columns).collect()), key=str) == sorted(map(tuple, kept.collect()), key=str)
    with pytest.raises(ValueError, match="has a version already"):
        archive.restored(spark, path, target, SCHEMAS, REFERENCES)
    with pytest.raises(Exception, match="there is an archive"):
        archive.export(tables, path)


def damaged(lines, how):
    rng = random.Random(how)
    i = rng.randrange(1, len(lines) - 1)
    if how == "byte":
        return [*lines[:i], lines[i].replace("text", "tent").replace("note", "Note", 1), *lines[i + 1 :]]
    if how == "moved":
        return [*lines[: i - 1], lines[i], lines[i - 1], *lines[i + 1 :]]
    if how == "doubled":
        return [*lines[:i], lines[i], *lines[i:]]
    return [*lines[:i], *lines[i + 1 :]]


@pytest.mark.parametrize("how", ["byte", "moved", "doubled", "gone"])
def test_a_changed_payload_is_found_and_nothing_restored(spark, tables, tmp_path, how):
    path, target = f"file://{tmp_path}/a", f"file://{tmp_path}/library"
    manifest = archive.export(tables, path)
    file = tmp_path / "a" / max(manifest["payloads"], key=lambda p: p["records"])["name"]
    file.write_text("".join(damaged(file.read_text().splitlines(keepends=True), how)))
    with pytest.raises(Exception, match="damaged payload"):
        archive.restored(spark, path, target, SCHEMAS, REFERENCES)
    assert Versions(spark, target).numbers() == []


def test_what_is_whole_and_wrong_is_not_restored(spark, tables, tmp_path):
    path, target = f"file://{tmp_path}/a", f"file://{tmp_path}/library"
    archive.export(tables | {"source": tables["source"].filter("id <> 'source:1'")}, path)
    with pytest.raises(ValueError, match="dangling reference: note note:"):
        archive.restored(spark, path, target, SCHEMAS, REFERENCES)
    with pytest.raises(ValueError, match="unknown table: source"):
        archive.restored(spark, path, target, {"note": SCHEMAS["note"]}, {})
    assert Versions(spark, target).numbers() == []


def test_a_failed_write_leaves_no_archive(spark, tables, tmp_path):
    path = f"file://{tmp_path}/a"
    broken = tables["note"].withColumn("content", F.when(F.col("id") == "note:77", F.raise_error(F.lit("no text"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no text"):
        archive.export(tables | {"note": broken}, path)
    with pytest.raises(FileNotFoundError):
        archive.manifest_of(path)
    assert archive.export(tables, path)["record_counts"]["note"] == 500


def test_an_empty_archive(spark, tables, tmp_path):
    path, target = f"file://{tmp_path}/a", f"file://{tmp_path}/library"
    archive.export({k: v.filter("false") for k, v in tables.items()}, path)
    version = archive.restored(spark, path, target, SCHEMAS, REFERENCES)
    assert Versions(spark, target).read("note", version).count() == 0


def test_references_are_found_in_one_scan(spark, tables):
    lines = portable.archive_lines(tables | {"source": tables["source"].filter("id = 'source:0'")})
    got = {tuple(r) for r in portable.dangling(lines, REFERENCES).collect()}
    assert got == {("note", f"note:{i}", "source_id", f"source:{i % 3}") for i in range(500) if i % 3}
