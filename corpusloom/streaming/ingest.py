"""Incremental ingestion: new files become new generations of their sources.

Structured Streaming lists a folder; every micro-batch of changed files runs the same
import as a batch does (``operators.importing``), as one commit of all tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.chunking import Sizes
from corpusloom.operators.importing import Library


def ingest(spark: SparkSession, folder: str, library: str, checkpoint: str, sizes: Sizes = Sizes(), name: str = "files") -> StreamingQuery:
    """Import what is new in ``folder`` into the library until it is used up.

    Each micro-batch is one version of the library, with the stream's name and epoch: a
    batch that is run again after a failure finds its epoch there, or nothing of it.
    """
    files = spark.readStream.format("text").option("wholetext", True).load(folder)
    named = files.select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("content"))

    def batch(rows: DataFrame, epoch: int) -> None:
        Library.open(spark, library).put(rows, name, epoch, sizes)

    return named.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
