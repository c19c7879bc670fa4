"""File sources: Markdown folders, chat exports, evaluation cases, and text sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import content_hash

MESSAGE = "struct<uuid:string,sender:string,role:string,text:string,content:string,created_at:timestamp,attachments:array<string>,files:array<string>>"
CHAT = f"uuid string, name string, summary string, created_at timestamp, updated_at timestamp, chat_messages array<{MESSAGE}>, messages array<{MESSAGE}>"


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """uri, content, content_hash of each file, read whole."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumnRenamed("value", "content")
    return files.select(F.col("_metadata.file_path").alias("uri"), "content", content_hash(F.col("content")).alias("content_hash"))


def chat_exports(spark: SparkSession, path: str) -> DataFrame:
    """One row per conversation from an array, a wrapped object, or a single conversation.

    Aliases of fields are resolved; conversations without messages are left out.
    """
    raw = spark.read.schema(f"{CHAT}, conversations array<struct<{_as_struct(CHAT)}>>").json(path, multiLine=True)
    bare = [c.split(" ")[0] for c in _fields(CHAT)]
    single = raw.filter("conversations is null").select(*bare)
    wrapped = raw.filter("conversations is not null").select(F.explode("conversations").alias("c")).select(*[F.col(f"c.{b}").alias(b) for b in bare])
    both = single.unionByName(wrapped)
    said = F.coalesce("chat_messages", "messages")
    resolved = F.transform(said, lambda m, i: F.struct(
        m["uuid"].alias("uuid"), F.coalesce(m["sender"], m["role"]).alias("role"), F.coalesce(m["text"], m["content"], F.lit("")).alias("content"), i.alias("message_index"), m["created_at"].alias("created_at"), m["files"].alias("files")
    ))
    return both.select("uuid", "name", F.nullif("summary", F.lit("")).alias("summary"), "created_at", "updated_at", resolved.alias("messages")).filter(F.size("messages") > 0)


def _fields(schema: str) -> list[str]:
    """Top-level fields of a schema text."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]


def _as_struct(schema: str) -> str:
    return ",".join(f.replace(" ", ":", 1) for f in _fields(schema))


CASE = (
    "schema_version int, name string, query string, scope string, k int, source_uri string, relevance array<struct<id:string,grade:int>>, expected_ids array<string>, "
    "expected_contains array<string>, expected_source_uris array<string>, forbidden_ids array<string>, forbidden_contains array<string>"
)


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSON-lines file; blank lines and those that start with # don't count.

    A case with a schema_version must have no unknown fields; a broken line fails the read.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> '' and not startswith(line, '#')")
    case = F.from_json("line", CASE, {"mode": "FAILFAST"})
    known = F.array(*[F.lit(f.split(" ")[0]) for f in _fields(CASE)])
    unknown = F.array_except(F.json_object_keys("line"), known)
    checked = F.when((F.get_json_object("line", "$.schema_version").isNotNull()) & (F.size(unknown) > 0), F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join(unknown, ", ")))).otherwise(F.lit(True))
    return lines.select(case.alias("c"), checked.alias("valid")).filter("valid").select("c.*")


#: The newest report format that is read.
REPORT_VERSION = 2


def baseline_report(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a stored evaluation report: name, query and metrics; a report of a newer format is refused."""
    metrics = "struct<k:int,recall_at_k:double,precision_at_k:double,reciprocal_rank:double,ndcg_at_k:double,provenance_accuracy:double,chunks:int,tokens:long>"
    report = spark.read.schema(f"metadata struct<schema_version:int,provider:string,model:string>, cases array<struct<name:string,query:string,metrics:{metrics}>>").json(path, multiLine=True, mode="FAILFAST")
    version = F.coalesce("metadata.schema_version", F.lit(1))
    gate = F.when(version > REPORT_VERSION, F.raise_error(F.concat(F.lit("unsupported report version "), version.cast("string")))).otherwise(F.lit(True))
    return report.filter(gate).select(F.explode("cases").alias("c")).select(F.col("c.name").alias("case_id"), "c.query", "c.metrics.*")


def write_lines(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)
