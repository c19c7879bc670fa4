"""Tables in folders that driver and executors share: scratch that ends a lineage, and versions that readers see whole.

Parquet in a shared folder outlives its executors, unlike cached rows, and nothing has to be
released after an action. ``Versions`` holds tables that change: folders are written once
and never changed, and a version is a small file that names those of each table.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_made: ContextVar[list[str] | None] = ContextVar("_made", default=None)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local temporary folder only where that is unset and all is on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "corpusloom-scratch")
    return base.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder for one use."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(path)
    return path


def written(rows: DataFrame, label: str) -> DataFrame:
    """The rows, computed once and read from Parquet from then on."""
    path = scratch(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@contextmanager
def scratch_space(spark: SparkSession) -> Iterator[None]:
    """Scratch folders that calls inside make are deleted at its end; results must be written before it."""
    made: list[str] = []
    outer = _made.set(made)
    try:
        yield
    finally:
        _made.reset(outer)
        for path in made:
            Folder(spark, path).delete()


@dataclass
class Folder:
    """A path through Spark's own file system layer."""

    spark: SparkSession
    path: str

    def _at(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _system(self):
        return self._at().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        fs = self._system()
        return sorted(s.getPath().getName() for s in fs.listStatus(self._at())) if fs.exists(self._at()) else []

    def text(self, name: str) -> str:
        stream = self._system().open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Write a whole file under a name that must be free; False where it isn't.

        The file is written beside and renamed without overwriting, which is one step on
        file systems with atomic renames.
        """
        jvm = self.spark.sparkContext._jvm
        fs, draft = self._system(), self._at(f".draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at().toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        no_overwrite = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, self._at(name), no_overwrite)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(draft, False)
            return False
        return True

    def delete(self, *parts: str) -> None:
        self._system().delete(self._at(*parts), True)


class Conflict(RuntimeError):
    """Another writer has committed the next version."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    tables: dict[str, list[str]] = field(default_factory=dict)  # folders of each table, relative
    notes: dict = field(default_factory=dict)


@dataclass
class Versions:
    """Versions of some tables under one folder.

    A reader takes the newest version's file and reads the folders that it names, so it
    sees all of a commit or nothing of it. A commit says after which version it comes and
    fails if that isn't the newest any more. What a stopped writer leaves is named by no
    version, and goes with ``tidy``.
    """

    spark: SparkSession
    path: str

    @property
    def _log(self) -> Folder:
        return Folder(self.spark, f"{self.path}/versions")

    def numbers(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._log.names() if n.startswith("v") and n.endswith(".json"))

    def at(self, number: int | None = None) -> Version:
        """A version, by default the newest; number 0 is empty."""
        if number is None:
            number = max(self.numbers(), default=0)
        return Version(**json.loads(self._log.text(f"v{number:012d}.json"))) if number else Version()

    def write(self, rows: DataFrame, table: str, *by: str) -> str:
        """A new folder of rows for a table, which no version names yet."""
        name = f"{table}-{uuid.uuid4().hex}"
        writer = rows.write.partitionBy(*by) if by else rows.write
        writer.parquet(f"{self.path}/data/{name}")
        Folder(self.spark, f"{self.path}/data/{name}").put_new("_schema.json", rows.schema.json())  # a folder by partitions may be empty
        return name

    def read(self, table: str, version: Version | None = None) -> DataFrame | None:
        """The rows of all folders of a table; None where the version has none."""
        folders = (version or self.at()).tables.get(table, [])
        out = None
        for name in folders:
            path = f"{self.path}/data/{name}"
            schema = StructType.fromJson(json.loads(Folder(self.spark, path).text("_schema.json")))
            rows = self.spark.read.schema(schema).parquet(path)
            out = rows if out is None else out.unionByName(rows)
        return out

    def commit(self, after: Version, tables: dict[str, list[str]], **notes) -> Version:
        new = Version(after.number + 1, tables, notes)
        if not self._log.put_new(f"v{new.number:012d}.json", json.dumps({"number": new.number, "tables": tables, "notes": notes})):
            raise Conflict(f"version {new.number} of {self.path} is there already")
        return new

    def tidy(self, keep: int = 1) -> None:
        """Delete folders that none of the newest ``keep`` versions names; no writer may be at work."""
        numbers = self.numbers()
        named = {f for n in numbers[-keep:] for folders in self.at(n).tables.values() for f in folders}
        for name in Folder(self.spark, f"{self.path}/data").names():
            if name not in named:
                Folder(self.spark, f"{self.path}/data").delete(name)
        for n in numbers[:-keep]:
            self._log.delete(f"v{n:012d}.json")
