"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a word budget (its target). Documents are counted by exact length;
whole passes over a source come first, then the histogram of lengths is thinned in
proportion, and a bounded-knapsack dynamic program closes the gap that is left. The
seeded hash of a document decides which documents of a length are taken.

Defined results: a null text has size 0; a null source is a source of its own, last in
order; documents of size 0 are never taken; rows that share a doc_id are decided as rows,
and tie only with equal rows; a very long text counts whole, and a source's plan needs
memory for the distinct lengths of its documents, which its longest text bounds; an empty
table gives an empty result; other columns, whatever their names, are ignored by ``mix``
and kept by ``mixture``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import WORD, join_small, materialize, remove, scratch

PLAN_SCHEMA = "skey string, size long, source_size long, target double, base int, extra long, rows long"

#: Rows of one (source, length) that a bucket of seeded hashes holds, about, and buckets at most.
BUCKET_ROWS, MOST_BUCKETS = 64, 4096


def reachable(lengths: list[int], spare: list[int], budget: int) -> list[int]:
    """Bounded knapsack: how many of each length give the largest sum up to ``budget``.

    Multiplicities are split in powers of two; ``first`` keeps the item that first
    reached each sum, so walking it back uses every item at most once.
    """
    taken = [0] * len(lengths)
    if budget <= 0:
        return taken
    hit = np.zeros(budget + 1, dtype=bool)
    hit[0] = True
    first = np.full(budget + 1, -1, dtype=np.int64)
    items: list[tuple[int, int]] = []
    for at, (length, left) in enumerate(zip(lengths, spare, strict=True)):
        left, step = min(left, budget // length), 1
        while left > 0 and not hit[budget]:
            many = min(step, left)
            weight = length * many
            new = np.flatnonzero(hit[: budget + 1 - weight]) + weight
            new = new[~hit[new]]
            first[new] = len(items)
            hit[new] = True
            items.append((at, many))
            left -= many
            step *= 2
        if hit[budget]:
            break
    total = int(np.flatnonzero(hit)[-1])
    while total:
        at, many = items[first[total]]
        taken[at] += many
        total -= lengths[at] * many
    return taken


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come to ``budget``."""
    whole = int((lengths * counts).sum())
    if whole <= 0 or budget <= 0:
        return np.zeros_like(counts)
    if budget >= whole:
        return counts.copy()
    bound = 2 * int(lengths.max())
    share = counts * (max(0, budget - bound) / whole)
    taken = np.minimum(np.floor(share).astype(np.int64), counts)
    left = budget - int((lengths * taken).sum())
    scattered = (lengths * 2_654_435_761) % (1 << 32)
    for i in np.lexsort((scattered, taken - share)):
        if left <= bound:
            break
        if taken[i] < counts[i]:
            taken[i] += 1
            left -= int(lengths[i])
    for i in np.argsort(-lengths, kind="stable"):
        if left <= bound:
            break
        more = min(int(counts[i] - taken[i]), (left - bound) // int(lengths[i]) + 1)
        taken[i] += more
        left -= more * int(lengths[i])
    return taken + np.array(reachable(lengths.tolist(), (counts - taken).tolist(), left), dtype=np.int64)


def fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    """One source's histogram of lengths (bounded by its longest text) to its plan."""
    size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    base = int(target // size) if size else 0
    pdf = pdf.sort_values("size", kind="stable")
    real = (pdf["size"] > 0).to_numpy()
    extra = np.zeros(len(pdf), dtype=np.int64)
    if size:
        extra[real] = fit_counts(pdf["size"].to_numpy()[real], pdf["rows"].to_numpy()[real], round(target - base * size))
    return pdf.assign(base=np.where(real, base, 0).astype("int32"), extra=extra)[["skey", "size", "source_size", "target", "base", "extra", "rows"]]


def source_targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, cap: float) -> DataFrame:
    """Targets by water-filling: budget shared by weight, no source above ``cap`` times its size.

    One row per source is ordered in one task, never documents: some millions of sources
    (about 100 bytes each) are what it is made for. The level is the first at which the
    budget that is left, shared over the weights that are left, fits under the next cap.
    """
    per = sizes.groupBy("skey").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("limit", F.lit(cap) * F.col("source_size")).withColumn("at", F.col("limit") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("at", "skey").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn(
        "level",
        (F.lit(budget) * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    per = per.withColumn("water", F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "level"))).over(every)["level"])
    full = F.col("water").isNull() | (F.col("at") <= F.col("water"))
    return per.select("skey", "source_size", F.when(full, F.col("limit")).otherwise(F.col("water") * F.col("weight")).alias("target"))


def decide(docs: DataFrame, weights: tuple[int, ...], budget: float, cap: float, seed: int, whole: bool) -> DataFrame:
    """A row per document with what ``mix`` returns, and all of its columns as the struct ``row`` where ``whole``."""
    spark = docs.sparkSession
    sizes = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("source").cast("string"))).alias("skey"),
        F.xxhash64("text").alias("tie"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []),
    )
    own = ["row"] if whole else []
    sizes = materialize(sizes, scratch(spark, "mix-sizes"))
    raw = scratch(spark, "mix-targets")
    targets = materialize(source_targets(sizes, weights, budget, cap), raw)
    lengths = sizes.groupBy("skey", "size").agg(F.count("*").alias("rows"))
    plan = materialize(
        join_small(lengths, targets, targets.count(), "skey").groupBy("skey").applyInPandas(fit_source, PLAN_SCHEMA),
        scratch(spark, "mix-plan"),
    )
    remove(spark, raw)
    n_plan = plan.count()
    hashed = F.xxhash64(F.lit(seed), "doc_id", "size")
    buckets = F.least(F.greatest(F.ceil(F.col("rows") / BUCKET_ROWS), F.lit(1)), F.lit(MOST_BUCKETS))
    rows = (
        join_small(sizes.select("doc_id", "skey", "size", "tie", *own), plan, n_plan, ["skey", "size"])
        .withColumn("seeded", hashed)
        .withColumn("bucket", F.floor(F.pmod("seeded", F.lit(1 << 31)) * buckets / float(1 << 31)))
    )
    partial = (F.col("extra") > 0) & (F.col("extra") < F.col("rows"))
    within = Window.partitionBy("skey", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        rows.filter(partial)
        .groupBy("skey", "size", "bucket", "extra")
        .agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(within))
        .filter((F.col("upto") >= F.col("extra")) & (F.col("upto") - F.col("n") < F.col("extra")))
        .select("skey", "size", F.col("bucket").alias("edge"), (F.col("extra") - F.col("upto") + F.col("n")).alias("room"))
    )
    edge = materialize(edge, scratch(spark, "mix-edges"))
    cut = join_small(rows, edge, n_plan, ["skey", "size"], "left")
    on_edge = F.col("edge").isNotNull() & (F.col("bucket") == F.col("edge"))
    ranked = cut.filter(on_edge).withColumn(
        "more", (F.row_number().over(Window.partitionBy("skey", "size", "bucket").orderBy("seeded", "doc_id", "tie")) <= F.col("room")).cast("int")
    )
    plain = cut.filter(~on_edge).withColumn(
        "more", F.when(F.col("edge").isNotNull(), F.col("bucket") < F.col("edge")).otherwise((F.col("extra") > 0) & (F.col("extra") >= F.col("rows"))).cast("int")
    )
    copies = F.when(F.col("size") > 0, F.col("base") + F.col("more")).otherwise(F.lit(0)).cast("int")
    return plain.unionByName(ranked).select(
        "doc_id", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"), *own
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0, seed: int = 20_017) -> DataFrame:
    """Per document: doc_id, size, source_size, target, copies, taken = size * copies."""
    return decide(docs, weights, budget, cap, seed, False)


def mixture(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0, seed: int = 20_017) -> DataFrame:
    """The mixed documents with their columns: each row as many times as the mix takes it."""
    taken = decide(docs, weights, budget, cap, seed, True).filter("copies > 0")
    again = taken.select("row", F.explode(F.sequence(F.lit(1), "copies")))
    return again.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
