"""What the training-data operators share: the shared scratch folder and column helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Rows and bytes up to which a table that was just measured may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: ContextVar[list[str] | None] = ContextVar("_made", default=None)


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
            remove(spark, path)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Only where the session has no such setting (tests on one machine) is a local
    temporary folder set as the checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "corpusloom-scratch")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(path)
    return path


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write as Parquet in the shared folder and read back: the lineage ends there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: A key is hot from so many rows, and from one in HOT_GROUPS of all rows, on.
HOT_ROWS, HOT_GROUPS = 500, 1000


def join_counted(left: DataFrame, right: DataFrame, on: str, n: str, rows: int, how: str = "inner") -> DataFrame:
    """Join ``right``, which has a key once and in column ``n`` how many of the ``rows`` rows of ``left`` have it.

    Keys of very many rows, of which there are at most HOT_GROUPS, are broadcast, so that
    no task gets all rows of one; the others, or all where none is hot, are joined by a
    shuffle.
    """
    least = max(HOT_ROWS, rows // HOT_GROUPS)
    large = right.filter(F.col(n) > least)
    if large.isEmpty():
        return left.join(right, on, how)
    rest = left.join(F.broadcast(large.select(on)), on, "left_anti").join(right.filter(F.col(n) <= least), on, how)
    return left.join(F.broadcast(large), on).unionByName(rest)


def join_small(left: DataFrame, right: DataFrame, rows: int, on, how: str = "inner", size: int = 0) -> DataFrame:
    """Broadcast ``right`` only while its counted rows, and bytes where rows may be wide, stay under the bounds."""
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else right, on, how)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table doesn't have in any spelling, for a helper column that goes again."""
    taken = {c.lower() for c in df.columns}
    name = f"__{wanted}"
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
