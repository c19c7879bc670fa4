"""Hard negatives for anchors and their positives, by distributed radix selection.

Every anchor's scores with all other rows are whole numbers, made block by block as
matrix products inside tasks, and never stored. What is to be found for a window (an
anchor with its positives-to-be, or an anchor and a positive with their negatives) are
the first k rows of a range of scores. Rows are in the order of a key: how far the score
is below the top of the range, then the row's number. Tasks count their rows by the first
digit of the key, Spark adds the counts up, and the running sum shows the digit of the
k-th row; the next round counts only rows of that digit, by the digit after it, and so on,
through the digits of the row's number where scores tie. Once few enough rows lie up to
that digit, only these are gathered and ranked. So what leaves the tasks are counts, and
at most GATHER rows for each window, however many rows tie.

Anchors are a stated part of the rows, and go in waves of about WAVE, so that what is sent
to the tasks, and what the driver holds, has a bounded size; each wave reads the quantised
rows, a narrow table, a few times.

Defined results: rows with a null label, a null vector, or a null or non-finite component
take no part; rows meet only rows with as many components; a row without a number comes
after the others among ties, and its number is null; rows that repeat a number count as
rows of their own, but none is a partner of the anchor of its number, and of anchor rows
that repeat a number, the one of the smallest label and vector counts; fewer rows than
wanted are all returned; components so large that scores would pass 62 bits are a
ValueError; an empty table gives an empty result; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import materialize, scratch

#: Anchors of a wave, rows of a product, bits of a digit, and rows that may be gathered for a window.
WAVE, ROWS, BITS, GATHER = 1024, 512, 11, 64
#: Digits of each of the two halves of a row's number, which follow those of the score.
ID_DIGITS = 3


def quantised(rows: DataFrame, scale: int, key: Column, label: Column, vector: Column) -> DataFrame:
    """id, label and whole-numbered components q of the rows that take part."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    parts = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    known = rows.select(key.cast("long").alias("id"), label.cast("long").alias("label"), parts.alias("q"), usable.alias("usable"))
    return known.filter("usable and label is not null").drop("usable")


@dataclass
class Windows:
    """Ranges of scores of some anchors, sorted by anchor, and how far the search of each has come."""

    anchor: np.ndarray  # the place of its anchor
    low: np.ndarray
    high: np.ndarray
    same: bool  # rows of the anchor's label, or of others
    k: int

    def __post_init__(self) -> None:
        n = len(self.anchor)
        widest = int((self.high - self.low).max(initial=0))
        self.sizes = (max(1, -(-widest.bit_length() // BITS)), ID_DIGITS, ID_DIGITS)  # digits of each part of the key
        self.prefix = np.zeros((3, n), np.int64)  # digits found so far, for each part
        self.level = np.zeros(n, np.int64)  # how many these are
        self.need = np.full(n, self.k)  # rows still wanted among those with these digits
        self.open = self.high >= self.low

    def keys(self, which: np.ndarray, ids: np.ndarray, none: np.ndarray, scores: np.ndarray) -> list[np.ndarray]:
        """The parts of rows' keys: the distance from the top, and the number's halves in ascending order, no number last."""
        u = ids.view(np.uint64) ^ np.uint64(1 << 63)
        upper = (u >> np.uint64(32)).astype(np.int64) | none.astype(np.int64) << 32
        return [self.high[which] - scores, upper, (u & np.uint64(0xFFFFFFFF)).astype(np.int64)]

    def compared(self, keys: list[np.ndarray], which: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: rows' keys, cut to the digits that their windows have, against these."""
        out, before = np.zeros(len(which), np.int64), 0
        for part, size in enumerate(self.sizes):
            known = np.clip(self.level[which] - before, 0, size)
            sign = np.sign((keys[part] >> BITS * (size - known)) - self.prefix[part, which])
            out = np.where(out == 0, sign, out)
            before += size
        return out

    def next_digit(self, keys: list[np.ndarray], which: np.ndarray) -> np.ndarray:
        """The digit of each key at its window's level."""
        out, before = np.zeros(len(which), np.int64), 0
        for part, size in enumerate(self.sizes):
            place = self.level[which] - before
            here = (place >= 0) & (place < size)
            out[here] = keys[part][here] >> BITS * (size - 1 - place[here]) & (1 << BITS) - 1
            before += size
        return out

    def found_digit(self, i: int, digit: int, smaller: int, upto: int) -> None:
        """Window i's next digit, and how many of the rows with its digits so far are before it, and up to it."""
        rows = self.k - self.need[i] + upto
        part = int(np.searchsorted(np.cumsum(self.sizes), self.level[i], side="right"))
        self.prefix[part, i] = self.prefix[part, i] << BITS | digit
        self.level[i] += 1
        self.need[i] -= smaller
        self.open[i] = rows > max(GATHER, self.k) and self.level[i] < sum(self.sizes)


@dataclass
class Wave:
    """Some anchors, all of one number of components."""

    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    exact: bool  # sums of products of doubles are exact


def meetings(batches: Iterator[pa.RecordBatch], wave: Wave, w: Windows, active: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For blocks of rows: windows (their places), rows' numbers, whether they have none, and scores, where a row is in a window's range.

    ``active`` has the windows to look at, sorted by anchor.
    """
    anchors = np.unique(w.anchor[active])
    begin = np.searchsorted(w.anchor[active], anchors)
    count = np.append(begin[1:], len(active)) - begin
    least, most = np.minimum.reduceat(w.low[active], begin), np.maximum.reduceat(w.high[active], begin)
    side = wave.q[anchors].T.astype(np.float64 if wave.exact else np.int64)
    own, kind = wave.ids[anchors], wave.labels[anchors]
    for batch in batches:
        sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
        fit = np.flatnonzero(sizes == len(side))
        if not len(fit):
            continue
        batch = batch.take(pa.array(fit))
        q = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(fit), len(side))
        none = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        labels = batch.column(1).to_numpy(zero_copy_only=False)
        for at in range(0, len(fit), ROWS):
            part = slice(at, at + ROWS)
            scores = q[part].astype(side.dtype) @ side
            match = labels[part, None] == kind[None, :]
            row, col = np.nonzero((scores >= least) & (scores <= most) & (match if w.same else ~match))
            apart = none[part][row] | (ids[part][row] != own[col])
            row, col = row[apart], col[apart]
            found = scores[row, col].astype(np.int64)
            times = count[col]  # each meeting once for each window of its anchor
            inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            which = active[np.repeat(begin[col], times) + inside]
            row, found = np.repeat(row, times), np.repeat(found, times)
            real = (found >= w.low[which]) & (found <= w.high[which])
            row = row[real]
            yield which[real], ids[part][row], none[part][row], found[real]


def added(parts: list[np.ndarray]) -> np.ndarray:
    """Keys and counts, those of equal keys added up."""
    both = np.concatenate(parts, axis=1)
    key, place = np.unique(both[0], return_inverse=True)
    return np.stack([key, np.bincount(place, weights=both[1], minlength=len(key)).astype(np.int64)])


def count_digits(rows: DataFrame, wave: Wave, w: Windows) -> DataFrame:
    """window, digit, n: how many rows of each open window have its digits so far, by the next digit."""
    sent = rows.sparkSession.sparkContext.broadcast((wave, w))

    def run(batches):
        wave, w = sent.value
        parts: list[np.ndarray] = []
        for which, *row in meetings(batches, wave, w, np.flatnonzero(w.open)):
            keys = w.keys(which, *row)
            right = w.compared(keys, which) == 0
            key, n = np.unique((which << BITS | w.next_digit(keys, which))[right], return_counts=True)
            parts.append(np.stack([key, n]))
            if sum(p.shape[1] for p in parts) > 1_000_000:
                parts = [added(parts)]
        if parts:
            key, n = added(parts)
            yield pa.RecordBatch.from_arrays([pa.array(key >> BITS), pa.array(key & (1 << BITS) - 1), pa.array(n)], names=["window", "digit", "n"])

    return rows.mapInArrow(run, "window long, digit long, n long").groupBy("window", "digit").agg(F.sum("n").alias("n"))


def refine(rows: DataFrame, wave: Wave, w: Windows) -> None:
    """One round: the next digit of the k-th row of each open window; windows with few enough rows up to it are done."""
    by_digit = Window.partitionBy("window").orderBy("digit")
    counts = count_digits(rows, wave, w).withColumn("upto", F.sum("n").over(by_digit))
    need = rows.sparkSession.createDataFrame([(int(i), int(w.need[i])) for i in np.flatnonzero(w.open)], "window long, need long")
    # the first digit with enough rows up to it; a row for each window
    hit = F.min(F.when(F.col("upto") >= F.col("need"), F.struct("digit", "upto", "n"))).alias("hit")
    found = {r["window"]: r["hit"] for r in counts.join(need, "window").groupBy("window").agg(hit).collect()}
    for i in np.flatnonzero(w.open):
        hit = found.get(int(i))
        if hit is None:
            w.open[i] = False  # fewer rows than wanted: all of them
        else:
            w.found_digit(i, hit["digit"], hit["upto"] - hit["n"], hit["upto"])


def gather(rows: DataFrame, wave: Wave, w: Windows) -> DataFrame:
    """window, id, score of the rows up to the digits found; of these a block's first k for each window."""
    sent = rows.sparkSession.sparkContext.broadcast((wave, w))

    def run(batches):
        wave, w = sent.value
        active = np.flatnonzero(w.high >= w.low)
        if not len(active):
            return
        for which, *row in meetings(batches, wave, w, active):
            fits = w.compared(w.keys(which, *row), which) <= 0
            which, ids, none, scores = which[fits], *(x[fits] for x in row)
            order = np.lexsort((ids, none, -scores, which))
            place = np.arange(len(order)) - np.searchsorted(which[order], which[order])
            order = order[place < w.k]
            if len(order):
                yield pa.RecordBatch.from_arrays([pa.array(which[order]), pa.array(ids[order], mask=none[order]), pa.array(scores[order])], names=["window", "id", "score"])

    return rows.mapInArrow(run, "window long, id long, score long")


def first_rows(rows: DataFrame, wave: Wave, w: Windows) -> DataFrame:
    """window, rank, id, score: the first k rows of each window."""
    while w.open.any():
        refine(rows, wave, w)
    order = Window.partitionBy("window").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return gather(rows, wave, w).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= w.k)


def negatives_of(rows: DataFrame, wave: Wave, largest: float, positives: int, negatives: int, least_percent: int, most_percent: int) -> tuple[DataFrame | None, list[tuple]]:
    """The negatives of a wave's anchors by window, and the windows: (window, anchor_id, positive_id, positive_score)."""
    bound = np.ceil(np.sqrt((wave.q.astype(np.float64) ** 2).sum(axis=1) * largest) * (1 + 1e-9)).astype(np.int64) + 1  # no score is larger
    near = Windows(np.arange(len(wave.ids)), -bound, bound, same=True, k=positives)
    pairs = sorted((r["window"], r["rank"], r["id"], r["score"]) for r in first_rows(rows, wave, near).collect())  # ``positives`` for each anchor
    if not pairs:
        return None, []
    low, high = [-(-least_percent * p[3] // 100) for p in pairs], [most_percent * p[3] // 100 for p in pairs]
    w = Windows(np.array([p[0] for p in pairs]), np.array(low, np.int64), np.array(high, np.int64), same=False, k=negatives)
    return first_rows(rows, wave, w), [(i, int(wave.ids[p[0]]), p[2], p[3]) for i, p in enumerate(pairs)]


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, least_percent: int = 30, most_percent: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` (id, label, q) are quantised; ``anchor`` says by id which of them are
    anchors. A negative's score is within both percentages of its positive's.
    """
    spark = rows.sparkSession
    rows = materialize(rows, scratch(spark, "hard-rows"))
    squares = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    largest = rows.agg(F.max(squares)).first()[0] or 0.0  # of the squared lengths; no score is larger
    if largest >= 1 << 62:
        raise ValueError("scores of these vectors need more than 62 bits")
    own = rows.filter(anchor & F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("label", "q")).alias("x")).select("id", "x.*", F.size("x.q").alias("parts"))
    own = materialize(own, scratch(spark, "hard-anchors"))
    kinds = own.groupBy("parts").agg(F.ceil(F.count("*") / WAVE).alias("waves"))
    numbered = own.join(kinds, "parts").withColumn("wave", F.pmod(F.xxhash64("id"), F.col("waves")))
    numbered = materialize(numbered.drop("waves"), scratch(spark, "hard-waves"))
    out, schema = [], "window long, anchor_id long, positive_id long, positive_score long"
    for parts, number in sorted((r[0], r[1]) for r in numbered.select("parts", "wave").distinct().collect()):
        chosen = numbered.filter((F.col("parts") == parts) & (F.col("wave") == number)).orderBy("id").collect()  # about WAVE rows
        q = np.array([r["q"] for r in chosen], np.int64).reshape(len(chosen), parts)
        wave = Wave(np.array([r["id"] for r in chosen], np.int64), np.array([r["label"] for r in chosen], np.int64), q, largest < 1 << 53)
        found, windows = negatives_of(rows, wave, largest, positives, negatives, least_percent, most_percent)
        if found is not None:
            found = found.join(F.broadcast(spark.createDataFrame(windows, schema)), "window")  # ``positives`` for each anchor of the wave
            found = found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            out.append(materialize(found, scratch(spark, "hard-found")))
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole
