"""Portable archives: JSON lines of all tables with a manifest, checked and restored."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import is_local_path
from corpusloom.sources.storage import written

FORMAT, VERSION = "portable-archive", 1
SECRET = re.compile(r"(secret|token|password|api_?key)", re.IGNORECASE)


def sanitized(rows: DataFrame, with_vectors: bool = False) -> DataFrame:
    """Without secrets and vectors; addresses of this machine become null."""
    kept = [f for f in rows.schema.fields if not SECRET.search(f.name) and (with_vectors or f.name != "embedding")]
    columns = [F.when(~is_local_path(F.col(f.name)), F.col(f.name)).alias(f.name) if "uri" in f.name else F.col(f.name) for f in kept]
    return rows.select(*columns)


def archive_lines(tables: dict[str, DataFrame], with_vectors: bool = False) -> DataFrame:
    """table_name, id, line: one JSON object per record."""
    out = None
    for name, rows in tables.items():
        one = sanitized(rows, with_vectors)
        one = one.select(F.lit(name).alias("table_name"), "id", F.to_json(F.struct(F.lit(name).alias("table"), F.struct(*one.columns).alias("record"))).alias("line"))
        out = one if out is None else out.unionByName(one)
    return out


def table_counts(lines: DataFrame) -> DataFrame:
    """Records, bytes (with line ends) and an order-free checksum per table."""
    return lines.groupBy("table_name").agg(
        F.count("*").alias("records"), F.sum(F.octet_length("line") + 1).alias("bytes"), F.bit_xor(F.xxhash64("line")).alias("checksum")
    )


def write_archive(tables: dict[str, DataFrame], path: str, with_vectors: bool = False) -> dict:
    """Lines in order of table and id, and the manifest; an existing path is refused by the writer."""
    lines = archive_lines(tables, with_vectors)
    lines.orderBy("table_name", "id").select("line").write.text(f"{path}/records")
    spark = lines.sparkSession
    back = read_archive(spark, path)
    counts = {r["table_name"]: r.asDict() for r in table_counts(back).collect()}  # a row per table
    manifest = {"format": FORMAT, "format_version": VERSION, "includes_embeddings": with_vectors, "record_counts": {t: c["records"] for t, c in counts.items()},
                "bytes": sum(c["bytes"] for c in counts.values()), "checksums": {t: c["checksum"] for t, c in counts.items()}}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return manifest


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(f"{path}/records").withColumnRenamed("value", "line")
    return lines.select(F.get_json_object("line", "$.table").alias("table_name"), F.get_json_object("line", "$.record.id").alias("id"), "line")


def parsed(lines: DataFrame, references: dict[str, dict[str, str]]) -> DataFrame:
    """table_name, id, bytes and targets (array of field, other table, id) of each line: one scan, whatever is asked of it."""
    wanted = []
    for name, fields in references.items():
        for field, other in fields.items():
            target = F.when(F.col("table_name") == name, F.get_json_object("line", f"$.record.{field}"))
            wanted.append(F.struct(F.lit(field).alias("field"), F.lit(other).alias("other"), target.alias("target")))
    kind = "array<struct<field:string,other:string,target:string>>"
    targets = F.filter(F.array(*wanted), lambda x: x["target"].isNotNull()) if wanted else F.array().cast(kind)
    return lines.select("table_name", "id", (F.octet_length("line") + 1).cast("long").alias("bytes"), targets.cast(kind).alias("targets"))


def problems(lines: DataFrame, manifest: dict, allowed: list[str], references: dict[str, dict[str, str]]) -> DataFrame:
    """problem, table_name, id: unknown tables, wrong prefixes, repeated ids, dangling references, wrong counts.

    The lines are read once; what is left of each is narrow.
    """
    rows = written(parsed(lines, references), "archive-parsed")
    unknown = rows.filter(~F.col("table_name").isin(allowed) | F.col("table_name").isNull()).select(F.lit("unknown table").alias("problem"), "table_name", "id")
    prefix = rows.filter(~F.startswith("id", F.concat("table_name", F.lit(":"))) | F.col("id").isNull()).select(F.lit("wrong prefix"), "table_name", "id")
    twice = rows.groupBy("table_name", "id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("repeated id"), "table_name", "id")
    lost = _dangling(rows).select(F.lit("dangling reference"), "table_name", "id")
    expected = lines.sparkSession.createDataFrame(list(manifest["record_counts"].items()), "table_name string, expected long")
    counts = rows.groupBy("table_name").agg(F.count("*").alias("records"))
    wrong = counts.join(expected, "table_name", "full_outer").filter("not (records <=> expected)").select(F.lit("wrong count"), "table_name", F.lit(None).cast("string").alias("id"))
    return unknown.union(prefix).union(twice).union(lost).union(wrong)


def dangling(lines: DataFrame, references: dict[str, dict[str, str]]) -> DataFrame:
    """table_name, id, field and target of references without a record. ``references``: table to its fields' tables."""
    return _dangling(written(parsed(lines, references), "archive-parsed"))


def _dangling(rows: DataFrame) -> DataFrame:
    """Ids that are wanted and not there are few; the records that want them are found by these."""
    held = rows.select("table_name", "id", F.explode("targets").alias("x")).select("table_name", "id", "x.*")
    has = rows.select(F.col("table_name").alias("other"), F.col("id").alias("target"), F.lit(1).alias("there"))
    missing = held.select("other", "target", F.lit(0).alias("there")).unionByName(has).groupBy("other", "target").agg(F.max("there").alias("there")).filter("there = 0")
    return held.join(missing.select("other", "target"), ["other", "target"], "left_semi").select("table_name", "id", "field", "target")


def restore(lines: DataFrame, name: str, schema: str) -> DataFrame:
    """One table's records with their types."""
    record = F.from_json(F.get_json_object("line", "$.record"), schema, {"mode": "FAILFAST"})
    return lines.filter(F.col("table_name") == name).select(record.alias("r")).select("r.*")


def envelope(rows: DataFrame, command: str) -> DataFrame:
    """Rows as the data of a versioned result object."""
    return rows.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(command).alias("command"), F.lit(True).alias("success"), F.struct(*rows.columns).alias("data"), F.array().cast("array<string>").alias("warnings"), F.array().cast("array<string>").alias("errors"))).alias("line"))


def manifest_problems(manifest: dict) -> list[str]:
    """What is wrong with a manifest itself."""
    out = [] if manifest.get("format") == FORMAT else ["unknown format"]
    out += [] if manifest.get("format_version") == VERSION else ["unknown version"]
    identity = manifest.get("embedding_identity")
    out += [] if bool(manifest.get("includes_embeddings")) == bool(identity) or not identity and not manifest.get("includes_embeddings") else ["vectors and their identity must come together"]
    path = manifest.get("payload", "records")
    out += ["unsafe path"] if path.startswith("/") or ".." in path.split("/") else []
    return out
