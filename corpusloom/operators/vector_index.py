"""Exact nearest neighbours of many rows, without the pairs of blocks that can't hold any.

Rows are put in blocks round pivots (a bounded sample of the rows), and a block keeps how
near and how far its rows are from every pivot. For unit vectors the straight distance
obeys the triangle inequality, so of two blocks whose distances to some pivot lie apart by
more than the distance wanted, no two rows can be near enough, and their product is never
made. The distance wanted is that of the threshold, or for the k nearest that of the k-th
row that a query finds in the blocks of its own pivot.

Blocks of queries go in waves that are sent to all tasks, and each wave reads only the
folders of pivots that it may need: the corpus is never shuffled once for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.blocks import NEAR_SCHEMA, Nearest, unit
from corpusloom.operators.scans import first_per
from corpusloom.sources.storage import scratch, written

#: Pivots at most, rows of a block of the corpus and of queries, and blocks of queries of a wave.
PIVOTS, ROWS, QUERIES, WAVE = 64, 1024, 512, 32
#: Distances are widened by so much against rounding.
SLACK = 1e-6


def straight(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Straight distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def choose_pivots(vectors: DataFrame, most: int) -> np.ndarray:
    """Rows far from each other, out of a sample of eight times as many: the next is the one farthest from all before."""
    sample = vectors.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(8 * most).collect()
    if not sample:
        return np.zeros((0, 0))
    rows = unit([r["embedding"] for r in sample])
    chosen, far = [0], straight(rows, rows[:1])[:, 0]
    while len(chosen) < most and far.max() > 0.1:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, straight(rows, rows[chosen[-1:]])[:, 0])
    return rows[chosen]


def packed(vectors: DataFrame, pivots: np.ndarray, rows: int) -> DataFrame:
    """pivot, block, ids, rows, lows, highs: blocks of about ``rows`` rows of one pivot, with distances to all pivots."""
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)

    def nearest(batches):
        for pdf in batches:
            if len(pdf):
                matrix = unit(pdf["embedding"].tolist())
                yield pd.DataFrame({"id": pdf["id"], "pivot": straight(matrix, sent.value).argmin(axis=1).astype(np.int32), "embedding": list(matrix)})

    placed = written(vectors.select("id", "embedding").mapInPandas(nearest, "id string, pivot int, embedding array<double>"), "vectors-placed")
    sizes = placed.groupBy("pivot").agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks"))  # a row for each pivot
    dealt = placed.join(F.broadcast(sizes), "pivot").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    blocks = dealt.groupBy("pivot", "block").agg(F.collect_list("id").alias("ids"), F.collect_list("embedding").alias("rows"))

    def bounded(batches):
        for pdf in batches:
            if len(pdf):
                far = [straight(np.stack([np.asarray(r) for r in rows]), sent.value) for rows in pdf["rows"]]
                yield pdf.assign(lows=[d.min(axis=0) for d in far], highs=[d.max(axis=0) for d in far])

    return blocks.mapInPandas(bounded, "pivot int, block int, ids array<string>, rows array<array<double>>, lows array<double>, highs array<double>")


def apart(lows: np.ndarray, highs: np.ndarray, other_lows: np.ndarray, other_highs: np.ndarray) -> np.ndarray:
    """How far any row of a block is from any row of another, at least: the largest gap over the pivots."""
    return np.maximum(lows[:, None, :] - other_highs[None, :, :], other_lows[None, :, :] - highs[:, None, :]).max(axis=2, initial=0)


@dataclass(frozen=True)
class Asked:
    """A block of queries."""

    names: np.ndarray
    matrix: np.ndarray
    lows: np.ndarray
    highs: np.ndarray
    reach: float  # the distance wanted


@dataclass
class VectorIndex:
    """Blocks of a corpus in a shared folder."""

    spark: SparkSession
    path: str
    pivots: np.ndarray

    @classmethod
    def build(cls, corpus: DataFrame, path: str | None = None, pivots: int = PIVOTS, rows: int | None = None) -> VectorIndex:
        """``corpus`` has id and embedding, all of one dimension; rows without a vector are left out."""
        spark = corpus.sparkSession
        vectors = corpus.filter(F.size("embedding") > 0)
        index = cls(spark, path or scratch(spark, "vectors"), choose_pivots(vectors, pivots))
        packed(vectors, index.pivots, rows or ROWS).write.partitionBy("pivot").parquet(index.path)
        return index

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def regions(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each pivot, how near and how far its rows are from all pivots: a row for each pivot."""
        n = len(self.pivots)
        lows, highs = (F.array(*[f(F.get(c, F.lit(i))) for i in range(n)]) for f, c in ((F.min, "lows"), (F.max, "highs")))
        return {r["pivot"]: (np.array(r["lows"]), np.array(r["highs"])) for r in self.blocks().groupBy("pivot").agg(lows.alias("lows"), highs.alias("highs")).collect()}

    def near(self, queries: DataFrame, k: int, exclude_self: bool = False, least: float | None = None) -> DataFrame:
        """query_id, id, distance (1 - cosine) and rank of the k nearest rows of each query, of those more similar than ``least``."""
        asked = queries.filter(F.size("embedding") > 0).select(F.col("query_id").alias("id"), "embedding")
        if not len(self.pivots):
            return self.spark.createDataFrame([], NEAR_SCHEMA).withColumn("rank", F.lit(1))
        blocks = written(packed(asked, self.pivots, QUERIES), "vectors-asked")
        wanted = np.sqrt(max(2 - 2 * least, 0)) if least is not None else np.inf
        regions = self.regions()
        found = None
        for own in self.waves(blocks):
            if least is None:
                reaches = self.reaches(own, k, exclude_self)
                own = [(p, Asked(b.names, b.matrix, b.lows, b.highs, r)) for (p, b), r in zip(own, reaches, strict=True)]
            else:
                own = [(p, Asked(b.names, b.matrix, b.lows, b.highs, wanted)) for p, b in own]
            asked_blocks = [b for _, b in own]
            needed = [p for p, (low, high) in regions.items() if any(apart(b.lows[None], b.highs[None], low[None], high[None])[0, 0] <= b.reach + SLACK for b in asked_blocks)]
            part = written(first_per(self.meet(asked_blocks, needed, k, exclude_self, least), ["query_id"], [F.round("distance", 9), "id"], k), "vectors-near")
            found = part if found is None else found.unionByName(part)
        return found if found is not None else self.spark.createDataFrame([], NEAR_SCHEMA).withColumn("rank", F.lit(1))

    def waves(self, blocks: DataFrame) -> Iterator[list[tuple[int, Asked]]]:
        """Blocks of queries, those of one pivot together, of about WAVE times QUERIES queries at a time."""
        sizes = [(r["pivot"], r["block"], r["n"]) for r in blocks.select("pivot", "block", F.size("ids").alias("n")).orderBy("pivot", "block").collect()]  # three numbers for each block
        while sizes:
            upto = max(1, int(np.searchsorted(np.cumsum([n for *_, n in sizes]), WAVE * QUERIES, side="right")))
            chosen, sizes = sizes[:upto], sizes[upto:]
            one = F.struct("pivot", "block").isin([F.struct(F.lit(p), F.lit(b)) for p, b, _ in chosen])
            rows = blocks.filter(one).orderBy("pivot", "block").collect()  # a wave of queries
            yield [(r["pivot"], Asked(np.array(r["ids"], dtype=object), np.array(r["rows"]), np.array(r["lows"]), np.array(r["highs"]), np.inf)) for r in rows]

    def reaches(self, own: list[tuple[int, Asked]], k: int, exclude_self: bool) -> list[float]:
        """For each block, the largest distance of a k-th row that its queries find round their own pivot; none where they find fewer."""
        asked, homes = [b for _, b in own], [p for p, _ in own]
        near = first_per(self.meet(asked, sorted(set(homes)), k, exclude_self, None, homes), ["query_id"], ["distance", "id"], k)
        last = {r["query_id"]: r["d"] for r in near.filter(F.col("rank") == k).select("query_id", F.col("distance").alias("d")).collect()}  # a row for each query of the wave
        return [float(np.sqrt(2 * max(max((last.get(n, np.inf) for n in b.names), default=0.0), 0.0))) for b in asked]

    def meet(self, asked: list[Asked], pivots: list[int], k: int, exclude_self: bool, least: float | None, homes: list[int] | None = None) -> DataFrame:
        """The k best rows of each task for each query, of pairs of blocks that are near enough; with ``homes``, of each block's own pivot only."""
        sent = self.spark.sparkContext.broadcast((asked, homes))

        def run(batches):
            asked, homes = sent.value
            lows, highs = np.stack([b.lows for b in asked]), np.stack([b.highs for b in asked])
            reach, own = np.array([b.reach for b in asked]) + SLACK, None if homes is None else np.array(homes)
            best: dict[int, Nearest] = {}
            for pdf in batches:
                for pivot, ids, rows, low, high in zip(pdf["pivot"], pdf["ids"], pdf["rows"], pdf["lows"], pdf["highs"], strict=True):
                    near = apart(lows, highs, np.asarray(low)[None], np.asarray(high)[None])[:, 0] <= reach
                    if own is not None:
                        near &= own == pivot
                    if near.any():
                        names, vectors = np.array(ids, dtype=object), np.stack([np.asarray(r) for r in rows])
                        for i in np.flatnonzero(near):
                            if i not in best:
                                best[i] = Nearest(asked[i].names, asked[i].matrix, k, exclude_self, least)
                            best[i].meet(names, vectors)
            for b in best.values():
                yield b.rows()

        return self.blocks().filter(F.col("pivot").isin(pivots)).select("pivot", "ids", "rows", "lows", "highs").mapInPandas(run, NEAR_SCHEMA)

    def skipped(self, queries: DataFrame, least: float) -> tuple[int, int]:
        """How many pairs of blocks a threshold leaves out, and how many there are."""
        asked = packed(queries.filter(F.size("embedding") > 0).select(F.col("query_id").alias("id"), "embedding"), self.pivots, QUERIES)
        reach, total, left = np.sqrt(max(2 - 2 * least, 0)) + SLACK, 0, 0
        own = [(np.array(r["lows"]), np.array(r["highs"])) for r in self.blocks().select("lows", "highs").toLocalIterator()]
        lows, highs = np.stack([x[0] for x in own]), np.stack([x[1] for x in own])
        for r in asked.select("lows", "highs").toLocalIterator():
            gaps = apart(np.array(r["lows"])[None], np.array(r["highs"])[None], lows, highs)
            total += gaps.size
            left += int((gaps > reach).sum())
        return left, total
