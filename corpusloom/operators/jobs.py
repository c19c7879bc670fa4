"""Durable batch work: what is left to do, cached inference, leases, and swapping vectors."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.extraction import parse
from corpusloom.functions.text import content_hash, entity_type, truncate_for_extraction

Embed = Callable[[list[str]], list[list[float]]]


def reindexable(notes: DataFrame, messages: DataFrame, chats: DataFrame) -> DataFrame:
    """Ids and texts of everything with a vector: notes, messages, summaries that aren't empty."""
    parts = [
        notes.select("id", F.lit("note").alias("kind"), F.col("content").alias("text")),
        messages.select("id", F.lit("message").alias("kind"), F.when(F.trim("content") == "", "[empty message]").otherwise(F.col("content")).alias("text")),
        chats.filter("summary is not null and trim(summary) <> ''").select("id", F.lit("summary").alias("kind"), F.col("summary").alias("text")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def left_to_do(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items without a result of the same fingerprint; a changed text is done again."""
    marked = items.withColumn("fingerprint", F.sha2("text", 256))
    return marked.join(done.select("id", "fingerprint"), ["id", "fingerprint"], "left_anti")


def widened(items: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Items that came after the snapshot was taken."""
    return items.join(snapshot.select("id"), "id", "left_anti")


def cache_key(text: Column, operation: str, provider: str, model: str, version: str, endpoint: str = "", settings: str = "") -> Column:
    fields = [F.lit(x) for x in (operation, provider, endpoint, model, settings, version)]
    return F.sha2(F.concat_ws("\0", *fields, content_hash(text)), 256)


def infer_cached(items: DataFrame, cache: DataFrame, embed: Embed, batch: int = 32, **identity: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of items by cache: each missing text is embedded once. Returns (results, new cache rows)."""
    keyed = items.withColumn("cache_key", cache_key(F.col("text"), **identity))
    misses = keyed.select("cache_key", "text").dropDuplicates(["cache_key"]).join(cache.select("cache_key"), "cache_key", "left_anti")

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield pd.DataFrame({"cache_key": part["cache_key"], "embedding": embed(part["text"].tolist())})

    new = misses.mapInPandas(run, "cache_key string, embedding array<float>")
    return keyed.join(cache.select("cache_key", "embedding").unionByName(new), "cache_key"), new


def fnv_vector(text: str, dimension: int) -> list[float]:
    """A stable vector for tests: 64-bit FNV-1a per dimension."""
    out = []
    for d in range(dimension):
        h = 0xCBF29CE484222325
        for b in f"{d}:{text}".encode():
            h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        out.append((h >> 40) / float(1 << 23) - 1.0)
    return out


def claimable(now: datetime, owner: str) -> Column:
    """A job's lease is free: none, run out, or mine."""
    return F.col("lease_owner").isNull() | (F.col("lease_owner") == owner) | (F.col("lease_expires_at") <= F.lit(now))


def claim(jobs: DataFrame, job: str, owner: str, now: datetime, seconds: int = 120) -> DataFrame:
    """Compare-and-set of the lease of one running or pending job."""
    hit = (F.col("id") == job) & F.col("status").isin("pending", "running") & claimable(now, owner)
    until = F.lit(now) + F.make_interval(secs=F.lit(seconds))
    return jobs.withColumns({"lease_owner": F.when(hit, owner).otherwise(F.col("lease_owner")), "lease_expires_at": F.when(hit, until).otherwise(F.col("lease_expires_at")), "status": F.when(hit, "running").otherwise(F.col("status"))})


TRANSITIONS = {"cancel": (("pending", "running"), "cancelled"), "resume": (("failed", "cancelled"), "pending"), "finish": (("running",), "completed"), "fail": (("running",), "failed")}


def transition(jobs: DataFrame, job: str, action: str) -> DataFrame:
    """A status change that its present status allows; else the job stays."""
    allowed, status = TRANSITIONS[action]
    return jobs.withColumn("status", F.when((F.col("id") == job) & F.col("status").isin(*allowed), status).otherwise(F.col("status")))


def adoptable(staged: DataFrame, current: DataFrame) -> DataFrame:
    """Staged vectors whose text is still what it was when they were made."""
    now = current.select("id", F.col("text").alias("now"))
    return staged.join(now, "id").filter(F.col("text").eqNullSafe(F.col("now"))).drop("now")


def commit_check(staged: DataFrame, items: DataFrame) -> DataFrame:
    """Whether a reindex may swap: complete, fresh and not widened, as one row of counts."""
    fresh = adoptable(staged, items)
    return items.agg(F.count("*").alias("items")).join(fresh.agg(F.count("*").alias("fresh"))).join(widened(items, staged).agg(F.count("*").alias("widened"))).withColumn("ready", (F.col("items") == F.col("fresh")) & (F.col("widened") == 0))


def retry_delay(attempt: int, key: str, first: float = 0.25, most: float = 5.0) -> float:
    """Exponential back-off with a jitter of 80 to 120 percent that the key decides."""
    jitter = 0.8 + 0.4 * ((sum(key.encode()) + 31 * attempt) % 101) / 100 if key else 1.0
    return min(first * 2**attempt, most) * min(max(jitter, 0.8), 1.2)


def retryable(status: int | None, timed_out: bool = False) -> bool:
    """Time-outs, throttling and server errors are tried again; other refusals aren't."""
    return timed_out or status is None or status in (408, 425, 429) or status >= 500


def extract_entities(items: DataFrame, extract: Callable[[str], str], most: int = 8000) -> DataFrame:
    """id, name, entity_type of what an extractor finds in each text; an answer that can't be read gives nothing."""

    def run(batches):
        for pdf in batches:
            rows = [(i, name, kind) for i, text in zip(pdf["id"], pdf["text"], strict=True) for name, kind in parse(extract(text))[0]]
            yield pd.DataFrame(rows, columns=["id", "name", "label"])

    cut = items.select("id", truncate_for_extraction(F.col("text"), most).alias("text"))
    return cut.mapInPandas(run, "id string, name string, label string").select("id", "name", entity_type(F.coalesce("label", F.lit("concept"))).alias("entity_type"))


def swapped(current: DataFrame, staged: DataFrame) -> DataFrame:
    """The vectors after a committed reindex: staged ones replace those of their ids, all others stay, even without a row."""
    new = staged.select("id", F.col("embedding").alias("__new"))
    return current.join(new, "id", "full_outer").withColumn("embedding", F.coalesce("__new", "embedding")).drop("__new")


def reindexed(current: DataFrame, items: DataFrame, staged: DataFrame, cache: DataFrame, embed: Embed, **identity: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One run of a reindex over ``items`` (id, text): (vectors after it, staged rows, new cache rows, the commit check).

    Staged vectors (id, text, embedding) of unchanged texts are adopted, the others are
    made by the cache; a run that was stopped goes on from what it staged.
    """
    kept = adoptable(staged, items).select("id", "text", "embedding")
    made, new = infer_cached(items.select("id", "text").join(kept.select("id"), "id", "left_anti"), cache, embed, **identity)
    after = kept.unionByName(made.select("id", "text", "embedding"))
    return swapped(current, after.select("id", "embedding")), after, new, commit_check(after, items)


def to_extract(notes: DataFrame, mentions: DataFrame, ids: list[str] | None = None, limit: int | None = None, force: bool = False) -> DataFrame:
    """The notes that an extraction job takes: the given ones or all, without those that have entities unless forced."""
    chosen = notes.filter(F.col("id").isin(ids)) if ids is not None else notes
    if not force:
        chosen = chosen.join(mentions.select(F.col("note_id").alias("id")), "id", "left_anti")
    return chosen if limit is None else chosen.orderBy("created_at", "id").limit(limit)


def identity_state(stored: dict | None, wanted: dict, vectors: int) -> str:
    """empty, matching, mismatch, or legacy (vectors without an identity): what a vector search may rely on."""
    if not stored:
        return "legacy" if vectors else "empty"
    return "matching" if all(stored.get(k) == wanted.get(k) for k in ("provider", "model", "dimension")) else "mismatch"
