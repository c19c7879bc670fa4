"""Portable archives as a data source: JSON lines in payload files, with a manifest that says what each must be.

Tasks write a payload each and take its SHA-256, bytes and records while the lines pass;
the driver puts the manifest in place last, so there is an archive or there is none. A
task that ran twice leaves a file that no manifest names. A reader takes the same figures
while it reads and fails at the end of a payload that isn't what the manifest says, be a
line damaged, moved, doubled or gone.

``pyarrow.fs`` opens the path, on the driver and in tasks: a shared folder, or a store
that it knows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from corpusloom.operators.portable import FORMAT, VERSION, archive_lines, problems, restore
from corpusloom.sources.storage import Version, Versions, written

MANIFEST = "manifest.json"
#: Lines of a batch that a reader gives.
LINES = 5_000


def opened(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Tally:
    """What a payload is so far."""

    sha: object = field(default_factory=hashlib.sha256)
    size: int = 0
    records: int = 0

    def add(self, line: bytes) -> None:
        self.sha.update(line)
        self.size += len(line)
        self.records += 1

    def figures(self) -> dict:
        return {"sha256": self.sha.hexdigest(), "bytes": self.size, "records": self.records}


@dataclass
class Written(WriterCommitMessage):
    name: str
    figures: dict
    counts: dict[str, int]
    first: str


class ArchiveWriter(DataSourceArrowWriter):
    """Rows of table_name and line, in the order in which they come."""

    def __init__(self, path: str, notes: dict) -> None:
        self.path, self.notes = path.rstrip("/"), notes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written | None:
        store, at = opened(self.path)
        name, out = f"payload-{uuid.uuid4().hex}.jsonl", None
        tally, counts, first = Tally(), {}, ""
        for batch in iterator:
            tables, lines = batch.column(batch.schema.names.index("table_name")), batch.column(batch.schema.names.index("line"))
            for table, line in zip(tables.to_pylist(), lines.to_pylist(), strict=True):
                if out is None:
                    store.create_dir(at, recursive=True)
                    out, first = store.open_output_stream(f"{at}/{name}"), line
                data = f"{line}\n".encode()
                tally.add(data)
                counts[table] = counts.get(table, 0) + 1
                out.write(data)
        if out is None:
            return Written("", {}, {}, "")
        out.close()
        return Written(name, tally.figures(), counts, first)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = opened(self.path)
        payloads = sorted((m for m in messages if m and m.name), key=lambda m: m.first)
        counts: dict[str, int] = {}
        for m in payloads:
            for table, n in m.counts.items():
                counts[table] = counts.get(table, 0) + n
        manifest = {"format": FORMAT, "format_version": VERSION, "payloads": [{"name": m.name, **m.figures} for m in payloads], "record_counts": counts, "bytes": sum(m.figures["bytes"] for m in payloads)} | self.notes
        store.create_dir(at, recursive=True)
        draft = f"{at}/.draft-{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            out.write(json.dumps(manifest).encode())
        store.move(draft, f"{at}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        store, at = opened(self.path)
        for m in messages:
            if m and m.name:
                store.delete_file(f"{at}/{m.name}")


@dataclass
class Payload(InputPartition):
    name: str
    figures: dict


def lines_in(stream) -> Iterator[bytes]:
    """Lines with their ends; the last may lack it."""
    rest = b""
    while chunk := stream.read(1 << 20):
        *lines, rest = (rest + chunk).split(b"\n")
        for line in lines:
            yield line + b"\n"
    if rest:
        yield rest


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def partitions(self) -> list[Payload]:
        return [Payload(p["name"], {k: p[k] for k in ("sha256", "bytes", "records")}) for p in manifest_of(self.path)["payloads"]] or [Payload("", {})]

    def read(self, partition: Payload) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, at = opened(self.path)
        tally, lines = Tally(), []
        with store.open_input_stream(f"{at}/{partition.name}") as stream:
            for data in lines_in(stream):
                tally.add(data)
                lines.append(data.rstrip(b"\n").decode(errors="replace"))
                if len(lines) == LINES:
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["line"])
                    lines = []
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["line"])
        if tally.figures() != partition.figures:
            raise ValueError(f"damaged payload {partition.name}: {tally.figures()} instead of {partition.figures}")


class Archive(DataSource):
    """``spark.read.format("corpus-archive").load(path)`` and ``df.write.format("corpus-archive").mode("append").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "corpus-archive"

    def schema(self) -> str:
        return "line string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        path = self.options["path"].rstrip("/")
        store, at = opened(path)
        from pyarrow.fs import FileType

        if store.get_file_info(f"{at}/{MANIFEST}").type != FileType.NotFound:
            raise ValueError(f"there is an archive at {path} already")
        return ArchiveWriter(path, json.loads(self.options.get("notes", "{}")))


def manifest_of(path: str) -> dict:
    store, at = opened(path.rstrip("/"))
    with store.open_input_file(f"{at}/{MANIFEST}") as stream:
        return json.loads(stream.read())


def export(tables: dict[str, DataFrame], path: str, with_vectors: bool = False) -> dict:
    """All tables as one archive, in order of table and id; the manifest. A path that has an archive is refused."""
    lines = archive_lines(tables, with_vectors)
    spark = lines.sparkSession
    spark.dataSource.register(Archive)
    ordered = lines.repartitionByRange("table_name", "id").sortWithinPartitions("table_name", "id", "line")
    ordered.select("table_name", "line").write.format(Archive.name()).option("notes", json.dumps({"includes_embeddings": with_vectors})).mode("append").save(path)
    return manifest_of(path)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """table_name, id and line of each record; whoever reads all of it also checks it."""
    spark.dataSource.register(Archive)
    lines = spark.read.format(Archive.name()).load(path)
    return lines.select(F.get_json_object("line", "$.table").alias("table_name"), F.get_json_object("line", "$.record.id").alias("id"), "line")


def restored(spark: SparkSession, path: str, target: str, schemas: dict[str, str], references: dict[str, dict[str, str]]) -> Version:
    """An archive's tables as the first version under ``target``: all of them, or a ValueError and nothing.

    Payloads are read once and checked against their SHA-256; tables, ids, references and
    counts are checked before anything is committed. A target with a version is refused.
    """
    store = Versions(spark, target)
    if store.numbers():
        raise ValueError(f"{target} has a version already")
    lines = written(lines_of(spark, path), "archive-lines")
    found = problems(lines, manifest_of(path), list(schemas), references)
    wrong = found.limit(5).collect()
    if wrong:
        raise ValueError("; ".join(f"{r['problem']}: {r['table_name']} {r['id'] or ''}".strip() for r in wrong))
    return store.commit(store.at(), {name: [store.write(restore(lines, name, schema), name)] for name, schema in schemas.items()}, archive=path)
