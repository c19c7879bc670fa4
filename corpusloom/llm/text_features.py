"""Indicator features of whole Arrow batches of texts, as (document, feature number) pairs.

Everything is numpy over the flat bytes of a batch: words are hashed at once, n-grams are
hashes of neighbouring words, and each document's distinct features are kept.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.arrow_text import flat_bytes, small_batches, sorted_distinct, with_columns
from corpusloom.llm.linear import LinearModel
from corpusloom.llm.shared import free_name

SHAPE_BITS, WORD_BITS, AFFIX_BITS = 16, 18, 20
_RANDOM = np.random.default_rng(4_711)
BYTE_CODE = _RANDOM.integers(1 << 62, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE_CODE = _RANDOM.integers(1 << 62, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

Features = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def folded(x: np.ndarray, bits: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of true values; a text's start always cuts."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(inside)]
    first[cuts] = inside[cuts]
    begins = np.flatnonzero(first)
    upto = np.append(0, np.cumsum(inside))
    sizes = np.diff(np.append(upto[begins], upto[-1]))
    return begins, begins + sizes


def hash_runs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, codes: np.ndarray = BYTE_CODE) -> np.ndarray:
    """A hash of each slice of bytes (of the place in the slice modulo 64, and the byte)."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    sizes = ends - begins
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.repeat(begins, sizes) + place
    value = codes[data[at]] * PLACE_CODE[place & 63]
    return np.add.reduceat(value ^ (value >> np.uint64(29)), np.cumsum(sizes) - sizes) + sizes.astype(np.uint64)


def shape_classes() -> np.ndarray:
    """Classes of bytes: white space 0, lower case and beyond ASCII 1, upper case 2, digits 3, each other byte its own."""
    out = np.arange(256, dtype=np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = 0
    out[ord("a") : ord("z") + 1] = 1
    out[0x80:] = 1
    out[ord("A") : ord("Z") + 1] = 2
    out[ord("0") : ord("9") + 1] = 3
    return out


CLASSES = shape_classes()


def ngrams(tokens: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n neighbouring tokens of one document."""
    m = max(0, len(tokens) - n + 1)
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + tokens[k : k + m]
    same = owner[:m] == owner[n - 1 : n - 1 + m]
    return out[same], owner[:m][same]


def distinct(parts: list[tuple[np.ndarray, np.ndarray]], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs, in order."""
    both = sorted_distinct(np.concatenate([(owner.astype(np.int64) << bits) | feature for owner, feature in parts]))
    return both >> bits, both & ((1 << bits) - 1)


def quality_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of word shapes (with a mark on a word that repeats the last one) and of words."""
    data, offsets = flat_bytes(column)
    kind = CLASSES[data]
    begins, ends = runs(kind != 0, offsets)
    owner = np.searchsorted(offsets, begins, side="right") - 1
    words = hash_runs(data, begins, ends)
    changed = kind != 0
    changed[1:] &= kind[1:] != kind[:-1]
    changed[begins] = True
    upto = np.append(0, np.cumsum(changed))
    shapes = hash_runs(kind[changed], upto[begins], upto[ends])
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    shapes = np.where(again, shapes + np.uint64(1), shapes)
    base = 1 << WORD_BITS
    parts = [(o, folded(g, SHAPE_BITS) + base) for g, o in (ngrams(shapes, owner, n) for n in (1, 2, 3))]
    parts += [(o, folded(g, WORD_BITS)) for g, o in (ngrams(words, owner, n) for n in (1, 2))]
    return distinct(parts, WORD_BITS + 1)


QUALITY_FEATURES = 1 << (WORD_BITS + 1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
LETTER = np.zeros(256, bool)
LETTER[ord("a") : ord("z") + 1] = LETTER[0x80:] = True
AFFIXES = (4, 5, 6)


#: A word or beginning is frequent in a text that has it twice or more, and once in so many words or more often.
OFTEN = 100


def lexical_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words (runs of letters, ASCII letters in lower case) and their beginnings of 4 to 6 bytes.

    Each has two features: that a text has it, and that it is frequent in the text.
    """
    data, offsets = flat_bytes(column)
    data = LOWER[data]
    begins, ends = runs(LETTER[data], offsets)
    owner = np.searchsorted(offsets, begins, side="right") - 1
    parts = [(owner, folded(hash_runs(data, begins, ends), AFFIX_BITS))]
    for size in AFFIXES:
        long = ends - begins > size
        parts.append((owner[long], folded(hash_runs(data, begins[long], begins[long] + size) + np.uint64(size << 20), AFFIX_BITS)))
    pairs, count = np.unique(np.concatenate([(o.astype(np.int64) << (AFFIX_BITS + 1)) | f for o, f in parts]), return_counts=True)
    words = np.bincount(owner, minlength=len(offsets) - 1)
    often = pairs[(count > 1) & (OFTEN * count >= words[pairs >> (AFFIX_BITS + 1)])]
    both = np.sort(np.concatenate([pairs, often | (1 << AFFIX_BITS)]))
    return both >> (AFFIX_BITS + 1), both & (LEXICAL_FEATURES - 1)


LEXICAL_FEATURES = 1 << (AFFIX_BITS + 1)


def word_feature(word: str) -> int:
    """The number of the feature that a text has the word."""
    return int(lexical_features(pa.array([word]))[1][0]) if len(word.encode()) <= min(AFFIXES) else int(folded(hash_runs(np.frombuffer(word.encode(), np.uint8), np.array([0]), np.array([len(word.encode())])), AFFIX_BITS)[0])


def feature_rows(docs: DataFrame, features: Features, keep: str) -> DataFrame:
    """``keep`` and the features of each text as bytes of int32, for a bounded sample."""

    def run(batches):
        for batch in small_batches(batches, 0, 3_000_000):
            owner, found = features(batch.column(0))
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            numbers = found.astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([numbers[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=[keep, "features"])

    return docs.select(F.col("text").cast("string").alias("text"), F.col(keep).cast("double").alias(keep)).mapInArrow(run, f"{keep} double, features binary")


def training_sample(docs: DataFrame, labels: DataFrame, label: str, features: Features, most_rows: int, most_unlabelled: int = 0) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of at most ``most_rows`` labelled documents, and of at most ``most_unlabelled`` others (label nan).

    Only documents whose crc32 of doc_id as text is not 2 modulo 4 are taken, those of the
    smallest hashes of doc_id. Of labels that repeat a doc_id the largest counts, of
    documents that repeat it the smallest text, so the bounds hold for rows.
    """
    number = F.col("doc_id").cast("long").alias("doc_id")
    rows = labels.select(number, F.col(label).cast("double").alias("label")).dropna().filter(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    by_hash = [F.xxhash64("doc_id"), "doc_id"]
    rows = rows.orderBy(*by_hash).limit(most_rows)
    if most_unlabelled:
        others = docs.select(number).dropna().filter(~held_out()).distinct().orderBy(*by_hash).limit(most_unlabelled)
        rows = rows.unionByName(others.select("doc_id", F.lit(None).cast("double").alias("label"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select(number, F.col("text").cast("string").alias("text")).join(F.broadcast(rows), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    # in order of their features, so that a fit doesn't depend on how rows are dealt
    found = feature_rows(texts.drop("doc_id"), features, "label").toLocalIterator(prefetchPartitions=True)
    pairs = sorted((bytes(r["features"]), float("nan") if r["label"] is None else r["label"]) for r in found)
    return [np.frombuffer(f, np.int32) for f, _ in pairs], np.array([y for _, y in pairs])


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def add_scores(docs: DataFrame, model: LinearModel, features: Features, into: str = "score") -> DataFrame:
    """All columns and the model's score of each whole text, in small steps of texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        for batch in small_batches(batches, place, 3_000_000):
            owner, found = features(batch.column(place))
            yield with_columns(batch, {into: pa.array(sent.value.score(sent.value.margins(owner, found, batch.num_rows)))})

    kept = [f for f in docs.schema.fields if f.name != into]
    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(into, T.DoubleType())]))


def keep_scored(docs: DataFrame, model: LinearModel, features: Features, threshold: float) -> DataFrame:
    """The documents whose score reaches the threshold; their columns stay as they are, whatever their names."""
    score = free_name(docs, "score")
    return add_scores(docs, model, features, score).filter(F.col(score) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
