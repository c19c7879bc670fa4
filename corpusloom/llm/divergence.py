"""Quality rules by distribution divergence, with DataFrame functions only.

A document's histogram of character classes, and its histogram of its language's most
common words, are compared with the language's own over the whole corpus by the
Jensen-Shannon distance (base 2, 0 to 1). Short documents are not judged by a histogram
that they can't fill. Base rules on length and repetition come first.

Two passes read the texts: one counts every word of each language, one makes a narrow row
of counts for every document; the references and verdicts come from the narrow rows.
Classes are capital letters, other letters of any script, ASCII digits, symbols, other ASCII
punctuation, and all other characters; common words have a letter.

Defined results: a null text has no words and fails the base rules; a null language is a
language of its own, and so is an empty one; a language without common words is judged by
characters only; among equally frequent words the one that sorts first is more common;
repeated rows are judged as rows; a very long text is counted whole, with memory for its
words in a task; an empty table gives an empty result; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import SPACE, join_small, materialize, scratch, text_or_empty

SYMBOLS = r"#*$%&|<>"
#: Character classes: what is deleted to count one. Capitals are letters, too.
NOT_IN_CLASS = {"upper": r"\P{Lu}+", "letter": r"\P{L}+", "digit": r"[^0-9]+", "symbol": r"[^#*$%&|<>]+", "mark": r"[\P{Punct}#*$%&|<>]+"}
CLASSES, COMMON_WORDS = 6, 32
#: Distances from which a document is rejected, and sizes below which a histogram isn't judged.
MOST_CHARS, MOST_WORDS, LEAST_CHARS, LEAST_WORDS = 0.28, 0.29, 200, 100
LEAST_LENGTH, MOST_REPEATED_PERCENT = 50, 50


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_words() -> Column:
    """Words in three-word windows that the text has twice or more.

    Windows are hashed and sorted with their places; places whose neighbour is equal are
    repeated, and each covers up to three words that an earlier one doesn't.
    """
    places = F.transform(
        F.filter(
            F.transform(F.col("sorted"), lambda x, i: F.when((x["h"] == F.get("sorted", i - 1)["h"]) | (x["h"] == F.get("sorted", i + 1)["h"]), x["i"])),
            lambda x: x.isNotNull(),
        ),
        lambda x: x.cast("long"),
    )
    return F.sort_array(places)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts; null where one is empty."""

    def shares(x: Column) -> Column:
        total = F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
        return F.transform(x, lambda v: v / F.nullif(total, F.lit(0.0)))

    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.when(a.isNull(), F.lit(None)).otherwise(F.lit(0.0)))

    terms = F.zip_with(shares(p), shares(q), lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b), F.lit(0.0)))


def common_words(docs: DataFrame) -> DataFrame:
    """Each language's most frequent words that have a letter: language, common array<string>, longest (characters)."""
    counts = docs.select("language", F.explode(split_words(F.col("text"))).alias("word")).groupBy("language", "word").agg(F.count("*").alias("n"))
    counts = counts.filter(F.col("word").rlike(r"\p{L}"))
    top = counts.withColumn("at", F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "word"))).filter(F.col("at") <= COMMON_WORDS)
    return top.groupBy("language").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("common"), F.max(F.char_length("word")).alias("longest"))


def document_counts(docs: DataFrame, common: DataFrame) -> DataFrame:
    """A narrow row of counts for each document."""
    size = common.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.array_join("common", " "))), F.lit(0)).alias("bytes")).first()
    rows = join_small(docs, common, size["n"], "language", "left", size["bytes"])
    rows = rows.select("doc_id", "language", "text", F.coalesce("common", F.array().cast("array<string>")).alias("common"), F.coalesce("longest", F.lit(0)).alias("longest"), split_words(F.col("text")).alias("words"), F.split("text", "\n").alias("lines"))
    window = F.transform(
        F.slice(F.col("words"), 3, F.greatest(F.size("words") - 2, F.lit(0))),
        lambda w, i: F.xxhash64(F.get("words", i), F.get("words", i + 1), w),
    )
    counted = {name: F.char_length(F.regexp_replace("text", pattern, "")).cast("long") for name, pattern in NOT_IN_CLASS.items()}
    rows = rows.select(
        "doc_id",
        "language",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        *[c.alias(name) for name, c in counted.items()],
        F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        window.alias("windows"),
        F.filter(F.transform("words", lambda w: F.when(F.char_length(w) <= F.col("longest"), F.array_position("common", w).cast("int"))), lambda x: x > 0).alias("at"),
        F.size("common").alias("n_common"),
    )
    rows = rows.withColumns({
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "sorted": F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
        "at_counts": F.transform(F.expr("sequence(1, greatest(n_common, 1))"), lambda k: (F.size("at") - F.size(F.array_remove("at", k))).cast("double")),
    })
    rows = rows.withColumn("places", repeated_words()).drop("sorted", "lines", "windows")
    covered = F.aggregate(F.col("places"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")), lambda a, x: F.struct((a["n"] + F.least(x - a["last"], F.lit(3))).alias("n"), x.alias("last")))["n"]
    others = F.col("word_chars") - F.col("letter") - F.col("digit") - F.col("symbol") - F.col("mark")
    classes = [F.col("upper"), F.col("letter") - F.col("upper"), F.col("digit"), F.col("symbol"), F.col("mark"), others]
    return rows.select(
        "doc_id",
        "language",
        "n_words",
        "word_chars",
        F.col("symbol").alias("n_symbols"),
        "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array(*[c.cast("double") for c in classes]).alias("chars"),
        F.when(F.col("n_common") > 0, F.concat("at_counts", F.array((F.col("n_words") - F.size("at")).cast("double")))).alias("commons"),
    )


def add_up(name: str, size: int) -> Column:
    """Element-wise sum of arrays."""
    return F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(size)])


def judge(docs: DataFrame) -> DataFrame:
    """Per document: the base counts, base_failed, both distances and kept."""
    spark = docs.sparkSession
    named = docs.select("doc_id", text_or_empty().alias("text"), F.when(F.col("lang").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("lang").cast("string"))).alias("language"))
    common = materialize(common_words(named), scratch(spark, "divergence-words"))
    counts = materialize(document_counts(named, common), scratch(spark, "divergence-counts"))
    references = counts.groupBy("language").agg(add_up("chars", CLASSES).alias("ref_chars"), add_up("commons", COMMON_WORDS + 1).alias("ref_commons"))
    # a language may have fewer common words than the most: its last bins are null and go
    references = references.withColumn("ref_commons", F.filter("ref_commons", lambda x: x.isNotNull()))
    references = materialize(references, scratch(spark, "divergence-references"))
    rows = join_small(counts, references, references.count(), "language")
    rows = rows.withColumns({
        "js_chars": F.when(F.col("word_chars") >= LEAST_CHARS, js_distance(F.col("chars"), F.col("ref_chars"))),
        "js_words": F.when((F.col("n_words") >= LEAST_WORDS) & F.col("commons").isNotNull(), js_distance(F.col("commons"), F.col("ref_commons"))),
        "base_failed": (F.col("n_words") < LEAST_LENGTH) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")),
    })
    fits = (F.coalesce("js_chars", F.lit(0.0)) < MOST_CHARS) & (F.coalesce("js_words", F.lit(0.0)) < MOST_WORDS)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return rows.select(*columns, (~F.col("base_failed") & fits).alias("kept"), F.round("js_chars", 6).alias("js_chars"), F.round("js_words", 6).alias("js_words"))
