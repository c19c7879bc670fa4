"""Calls of a model over a table: batches made at once inside tasks, and a batch that fails falls back to its single items.

An item that fails is a row that says why, and stops no other. Results are written once,
so asking for them again calls nothing again.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.jobs import cache_key, retry_delay, retryable
from corpusloom.sources.storage import written

Embed = Callable[[list[str]], list[list[float]]]
RESULT = "cache_key string, embedding array<float>, error string, calls int"


class ModelError(RuntimeError):
    """A refusal by a model, with the status that it came with."""

    def __init__(self, message: str, status: int | None = None, timed_out: bool = False) -> None:
        super().__init__(message)
        self.status, self.timed_out = status, timed_out


@dataclass(frozen=True)
class Calls:
    """How a model is called: texts of a batch, batches at a time in a task, tries of one call, and the first pause between them."""

    batch: int = 32
    at_once: int = 4
    tries: int = 3
    pause: float = 0.25
    dimension: int | None = None


def flaw(vector: list[float] | None, dimension: int | None) -> str | None:
    """What is wrong with a vector."""
    if not vector:
        return "no vector"
    if dimension is not None and len(vector) != dimension:
        return f"{len(vector)} components instead of {dimension}"
    return None if all(math.isfinite(x) for x in vector) else "a component isn't finite"


def call_once(texts: list[str], embed: Embed, how: Calls) -> tuple[list | None, str | None, int]:
    """The vectors of a batch, or why there are none; and how many calls it took. Only what may pass by itself is tried again."""
    for attempt in range(how.tries):
        try:
            found = embed(texts)
            if len(found) == len(texts):
                return found, None, attempt + 1
            return None, f"{len(found)} vectors for {len(texts)} texts", attempt + 1
        except ModelError as e:
            if not retryable(e.status, e.timed_out) or attempt + 1 == how.tries:
                return None, str(e), attempt + 1
        except Exception as e:  # whatever a client raises is this batch's failure
            return None, f"{type(e).__name__}: {e}", attempt + 1
        time.sleep(retry_delay(attempt, texts[0][:64], how.pause))
    raise AssertionError("unreachable")


def with_fallback(texts: list[str], embed: Embed, how: Calls) -> Iterator[tuple[list | None, str | None, int]]:
    """A result for each text: (vector, error, calls). A batch that fails is halved, down to single texts."""
    found, why, calls = call_once(texts, embed, how)
    if found is not None:
        for vector in found:
            wrong = flaw(vector, how.dimension)
            yield (None, wrong, calls) if wrong else (vector, None, calls)
    elif len(texts) == 1:
        yield None, why, calls
    else:
        half = len(texts) // 2
        for part in (texts[:half], texts[half:]):
            for vector, error, more in with_fallback(part, embed, how):
                yield vector, error, calls + more


#: Texts that a task has as Python strings at a time.
TEXTS = 512


def called(items: DataFrame, embed: Embed, how: Calls = Calls()) -> DataFrame:
    """cache_key, embedding or error, and calls, for each of ``items`` (cache_key, text)."""
    return items.select("cache_key", "text").mapInArrow(lambda batches: answers(batches, embed, how), RESULT)


def answers(batches: Iterable[pa.RecordBatch], embed: Embed, how: Calls) -> Iterator[pa.RecordBatch]:
    """Results of batches of (cache_key, text), TEXTS at a time, as a batch may have thousands of long texts."""
    kind = pa.schema([("cache_key", pa.string()), ("embedding", pa.list_(pa.float32())), ("error", pa.string()), ("calls", pa.int32())])
    with ThreadPoolExecutor(how.at_once) as pool:
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(start, TEXTS)
                texts = batch.column(1).to_pylist()
                parts = [texts[at : at + how.batch] for at in range(0, len(texts), how.batch)]
                rows = [r for part in pool.map(lambda p: list(with_fallback(p, embed, how)), parts) for r in part]
                columns = [pa.array([r[i] for r in rows], kind.field(1 + i).type) for i in range(3)]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), *columns], schema=kind)


def inferred(items: DataFrame, cache: DataFrame | None, embed: Embed, how: Calls = Calls(), **identity: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of ``items`` (id, text and more) by cache: each missing text is asked for once, however many items have it.

    Returns (items with cache_key, embedding and error; new cache rows, of what succeeded).
    """
    keyed = items.withColumn("cache_key", cache_key(F.col("text"), **identity))
    known = cache.select("cache_key", "embedding") if cache is not None else None
    misses = keyed.select("cache_key", "text").dropDuplicates(["cache_key"])
    if known is not None:
        misses = misses.join(known.select("cache_key"), "cache_key", "left_anti")
    new = written(called(misses, embed, how), "inference")
    fresh = new.filter("error is null").select("cache_key", "embedding")
    answers = new.select("cache_key", "embedding", "error")
    if known is not None:
        answers = answers.unionByName(known.withColumn("error", F.lit(None).cast("string")))
    return keyed.join(answers, "cache_key"), fresh


def outcome(results: DataFrame) -> DataFrame:
    """One row: completed and failed items."""
    return results.agg(F.count_if(F.col("error").isNull()).alias("completed"), F.count_if(F.col("error").isNotNull()).alias("failed"))
