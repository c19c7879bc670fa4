"""What filters remove together: an audit of all orders of filters by a Walsh-Hadamard transform.

Each document fails a set of filters, its mask. For each part of the table and each kind
of labels, Spark adds up one signed sum for every set of filters: +1 for a document that
fails an even number of the set's filters, -1 for an odd number. These 2^n parity sums
say everything that counts by mask say, and the transform, which is its own inverse but
for a factor, gives the counts back exactly, in whole numbers. All orders of the
filters, and each filter's Shapley value, are then sums over the 2^n masks of a part, so
the documents are read once, whatever the number of orders.

A document that fails c filters is removed by each of them in n!/c of the n! orders;
that is the closed form of the Shapley values, which are kept as sums over all orders.

Defined results: a null text is empty; a null part is the empty string; a document is good
(toxic) where any label row of its doc_id says so; rows without a doc_id have no labels,
and neither are copies of an earlier document nor make later ones copies; rows that repeat
a doc_id count as documents, and not as copies of each other; a very long text is taken
whole, with memory for its words in a task; an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import SPACE, join_counted, materialize, scratch, text_or_empty

LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 100, 80, 10
SYMBOLS = r"[#$%&*|]"
#: Filters by their letters; the mask of a document has a bit for each, in this order.
FILTERS = "ABCDE"


def failed_here(text: Column) -> Column:
    """The bits of the filters that a text's own words and characters fail: too short, repetitive, shouting, full of symbols."""
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    failed = (
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * n,
        100 * capitals > MOST_CAPITALS_PERCENT * F.char_length(text),
        text.rlike(SYMBOLS),
    )
    bits = [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)]
    return (bits[0] + bits[1] + bits[2] + bits[3]).cast("int")


def masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part and mask of each document.

    Copies are found by the SHA-256 of their texts and the smallest doc_id of each.
    """
    spark = docs.sparkSession
    text = text_or_empty()
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), failed_here(text).alias("mask"))
    rows = materialize(rows, scratch(spark, "audit-masks"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    first = materialize(first, scratch(spark, "audit-copies"))
    found = join_counted(rows, first, "digest", "n", rows.count(), "left")
    copy = F.when(F.col("doc_id") > F.col("first_id"), 1 << FILTERS.index("E")).otherwise(0)
    return found.select("doc_id", "part", (F.col("mask") + copy).alias("mask"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Masks with the labels of their documents, and how many rows there are of each: repeated rows meet before the join."""
    known = labels.filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    counted = rows.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    found = counted.join(known, "doc_id", "left")
    return found.select("part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "mask", "n")


def parity_sums(rows: DataFrame, filters: int) -> DataFrame:
    """part, good, toxic and the array of signed sums of each; place s of it is the sum for the set of filters with the bits of s."""

    def sign(s: int) -> Column:
        return 1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(s)) % 2)

    sums = [F.sum(F.col("n") * sign(s)).alias(f"s{s}") for s in range(1 << filters)]
    return rows.groupBy("part", "good", "toxic").agg(*sums).select("part", "good", "toxic", F.array(*[f"s{s}" for s in range(1 << filters)]).alias("sums"))


def inverse(sums: Column, filters: int) -> Column:
    """Counts by mask from parity sums: the transform is its own inverse, but for the number of sets."""

    def cell(mask: Column) -> Column:
        signed = F.transform(sums, lambda x, s: F.when(F.bit_count(mask.bitwiseAND(s)) % 2 == 0, x).otherwise(-x))
        return F.shiftright(F.aggregate(signed, F.lit(0).cast("long"), lambda total, x: total + x), filters)

    return F.transform(F.sequence(F.lit(0), F.lit((1 << filters) - 1)), cell)


def cells(rows: DataFrame, filters: int) -> DataFrame:
    """part, and for each part the counts by mask of all documents, of good ones and of toxic ones."""
    counted = parity_sums(rows, filters).withColumn("cells", inverse(F.col("sums"), filters))
    each = counted.select("part", "good", "toxic", F.posexplode("cells").alias("mask", "n"))
    sums = each.groupBy("part", "mask").agg(
        F.sum("n").alias("all"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )
    own = sums.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "all", "good", "toxic"))).alias("x"))  # 2^filters entries
    return own.select("part", F.col("x.all").alias("all"), F.col("x.good").alias("good"), F.col("x.toxic").alias("toxic"))


def orders(letters: str) -> list[tuple[str, int, int, int]]:
    """All orders with their steps: the order, the step (from 1), its filter's place and the bits of the earlier filters."""
    out = []
    for order in permutations(letters):
        before = 0
        for step, letter in enumerate(order, 1):
            out.append(("".join(order), step, letters.index(letter), before))
            before |= 1 << letters.index(letter)
    return out


def audit(rows: DataFrame, letters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, from ``rows`` (part, good, toxic, mask, n)."""
    n, every = len(letters), range(1 << len(letters))
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(f).alias("place"), F.lit(b).alias("before")) for o, s, f, b in orders(letters)])

    def added(array: str, chosen) -> Column:
        """The sum of an array's cells over masks."""
        return F.aggregate(F.sequence(F.lit(0), F.lit(every[-1])), F.lit(0).cast("long"), lambda total, m: total + F.when(chosen(m), F.get(array, m)).otherwise(0))

    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(n)]), F.col("place") + 1)
    fails = lambda m: m.bitwiseAND(bit) != 0
    earlier = lambda m: m.bitwiseAND(F.col("before")) != 0
    shapley = F.array(*[sum((F.get("all", F.lit(m)) * (factorial(n) // m.bit_count()) for m in every if m >> f & 1), F.lit(0).cast("long")) for f in range(n)])
    each = cells(rows, n).withColumn("values", shapley).select("*", F.explode(steps).alias("x")).select("part", "all", "good", "toxic", "values", "x.*")
    return each.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        added("all", lambda m: ~fails(m) & ~earlier(m)).alias("kept"),
        added("all", lambda m: fails(m) & ~earlier(m)).alias("removed"),
        added("all", lambda m: fails(m) & earlier(m)).alias("redundant"),
        F.get("all", bit).alias("unique_fails"),
        added("good", lambda m: fails(m) & ~earlier(m)).alias("good_lost"),
        added("toxic", lambda m: fails(m) & ~earlier(m)).alias("toxic_lost"),
        F.get("values", F.col("place")).alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The audit of the five filters over documents."""
    return audit(labelled(masks(docs, part), labels))
