"""Benchmark decontamination by winnowing, with DataFrame functions only.

A window is ``window`` consecutive words of a benchmark item, or a shorter item whole. The
print of a window is the smallest hash of the GRAM-word runs in it. Consecutive windows
mostly share their print, so a text keeps about one print for every four words, and yet
whatever window two texts share, they share its print: no shared window can be missed.

Prints of all documents are stored once, in a narrow table, and joined with the prints of
the benchmark. Only the texts that share one are read again. There each print that was
hit is extended to the windows that it stands for, and these are compared with the
benchmark's windows word for word; neighbouring and overlapping windows make up a span.
Shorter items have prints of their own length, so that the guarantee holds for them, too.

The result of a text depends on nothing but the text, so texts are told apart by their
SHA-256, and copies share one result. Tables of prints and windows of the benchmark, and
of the texts that share one, are sent to all tasks while they are measured to be small,
and else joined by a shuffle, hot keys apart.

Defined results: a null text has no words; a null or empty item has no window; items that
repeat an item_id are one item, and an item without an item_id marks words as hit but isn't
listed; repeated rows of a document are rows of their own; a very long text is taken
whole, with memory for its words in a task; an empty table on either side gives no hits;
other columns, whatever their names, are ignored, and kept by ``keep_clean``.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import free_name, join_counted, join_small, materialize, scratch, text_or_empty

#: What is between words, after A to Z are in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window, and of the runs that are hashed.
WINDOW, GRAM = 10, 4
#: Rows up to which prints and texts that were just counted are sent to all tasks.
MOST_SENT = 200_000


def split_words(text: Column) -> Column:
    """Words in lower case; letters outside ASCII stay as they are."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))
    return F.array_remove(F.split(lowered, BETWEEN), "")


def with_prints(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds, for each length of a window, p<length>: the print of the window that starts at each word.

    ``rows`` has ``words``. Hashes of runs, and minima of them, are made from those of
    half the length, each as a column of its own, so that none is computed twice.
    """
    made = rows.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    have = {"h1"}

    def put(name: str, column: Column) -> str:
        nonlocal made
        if name not in have:
            made = made.withColumn(name, column)
            have.add(name)
        return name

    def runs(k: int) -> str:
        if k == 1:
            return "h1"
        half = 1 << (k - 1).bit_length() - 1
        first, rest = runs(half), runs(k - half)
        return put(f"h{k}", F.transform(first, lambda x, i: F.xxhash64(x, F.get(rest, i + half))))

    def least(k: int, w: int) -> str:
        if w == 1:
            return runs(k)
        half = 1 << w.bit_length() - 1
        half = half // 2 if half == w else half
        below = least(k, half)
        return put(f"m{k}_{w}", F.transform(below, lambda x, i: F.least(x, F.get(below, i + (w - half)))))

    for n in lengths:
        k = min(GRAM, n)
        smallest = least(k, n - k + 1)
        made = made.withColumn(f"p{n}", F.slice(smallest, F.lit(1), F.greatest(F.size("words") - (n - 1), F.lit(0))))
    return made.drop(*have)


def tagged(n: int) -> Column:
    """The distinct prints of windows of n words, told apart from those of another length."""
    return F.transform(F.array_distinct(f"p{n}"), lambda x: F.xxhash64(x, F.lit(n)))


def fingerprints(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """doc_id, digest, n_words and the distinct prints of each document."""
    words = docs.select("doc_id", F.sha2(text_or_empty(), 256).alias("digest"), split_words(text_or_empty()).alias("words"))
    prints = F.concat(*[tagged(n) for n in lengths]) if lengths else F.array().cast("array<bigint>")
    return with_prints(words, lengths).select("doc_id", "digest", F.size("words").cast("long").alias("n_words"), prints.alias("prints"))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """item_id, n (words of a window), text and print of each window of the items."""
    rows = items.select("item_id", split_words(text_or_empty()).alias("words")).filter(F.size("words") > 0)
    rows = rows.withColumn("n", F.least(F.size("words"), F.lit(window)))
    each = with_prints(rows, list(range(1, window + 1)))
    own = F.element_at(F.array(*[F.col(f"p{n}") for n in range(1, window + 1)]), F.col("n"))
    places = each.select("item_id", "n", "words", F.posexplode(own).alias("at", "p"))
    text = F.array_join(F.slice("words", F.col("at") + 1, F.col("n")), " ")
    return places.select("item_id", "n", text.alias("window"), F.xxhash64("p", "n").alias("print")).distinct()


def bytes_of(rows: DataFrame, column: Column) -> tuple[int, int]:
    """How many rows there are, and about how many bytes."""
    found = rows.agg(F.count("*"), F.coalesce(F.sum(column), F.lit(0))).first()
    return found[0], found[1] + 100 * found[0]


def shared_windows(docs: DataFrame, candidates: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """digest, at (the first word's place), n and window of each window that a text shares with an item.

    ``candidates`` has the digests of the texts that share a print, and the prints.
    """
    spark = docs.sparkSession
    count, size = bytes_of(candidates, 8 * F.size("hits"))
    texts = docs.select(F.sha2(text_or_empty(), 256).alias("digest"), text_or_empty().alias("text"))
    if count <= MOST_SENT:
        found = join_small(texts, candidates.drop("n"), count, "digest", "inner", size)
    else:
        found = join_counted(texts, candidates, "digest", "n", docs.count()).drop("n")
    found = with_prints(found.select("digest", "hits", split_words(F.col("text")).alias("words")), lengths)

    def extended(n: int) -> Column:
        """The windows of n words whose print was hit."""
        places = F.filter(F.transform(f"p{n}", lambda x, i: F.when(F.array_contains("hits", F.xxhash64(x, F.lit(n))), i)), lambda i: i.isNotNull())
        return F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice("words", i + 1, F.lit(n)), " ").alias("window")))

    each = found.select("digest", F.explode(F.concat(*[extended(n) for n in lengths])).alias("x")).select("digest", "x.*")
    real = windows.select("window", "n").distinct()
    count, size = bytes_of(real, F.octet_length("window"))
    return materialize(join_small(each, real, count, ["window", "n"], "left_semi", size).distinct(), scratch(spark, "leak-windows"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, digest of the text, n_words, spans (array of first word and words), items (sorted array of item_ids as strings)."""
    spark = docs.sparkSession
    windows = materialize(item_windows(items, window), scratch(spark, "leak-items"))
    lengths = sorted(r[0] for r in windows.select("n").distinct().collect())  # window of them at most
    base = materialize(fingerprints(docs, lengths), scratch(spark, "leak-prints"))
    none = base.select("doc_id", "digest", "n_words", F.array().cast("array<struct<first:int,words:int>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    if not lengths:
        return none
    asked = windows.select("print").distinct()
    n_asked = asked.count()
    each = base.select("digest", F.explode("prints").alias("print"))
    if n_asked <= MOST_SENT:
        found = join_small(each, asked, n_asked, "print", "left_semi")
    else:  # prints that very many documents have are sent, the others shuffled
        frequent = materialize(each.join(asked, "print", "left_semi").groupBy("print").agg(F.count("*").alias("n")), scratch(spark, "leak-frequent"))
        found = join_counted(each, frequent, "print", "n", base.count())
    hits = found.groupBy("digest").agg(F.collect_set("print").alias("hits"), F.count("*").alias("n"))
    candidates = materialize(hits.withColumn("n", F.floor(F.col("n") / F.size("hits"))), scratch(spark, "leak-candidates"))
    shared = shared_windows(docs, candidates, windows, lengths)
    before = Window.partitionBy("digest").orderBy("at", "n").rowsBetween(Window.unboundedPreceding, -1)
    in_order = Window.partitionBy("digest").orderBy("at", "n")
    ends = shared.select("digest", "at", "n", (F.col("at") + F.col("n")).alias("end")).withColumn("reached", F.max("end").over(before))
    ends = ends.withColumn("span", F.sum(F.when(F.col("at") <= F.col("reached"), 0).otherwise(1)).over(in_order))
    spans = ends.groupBy("digest", "span").agg(F.min("at").alias("first"), (F.max("end") - F.min("at")).alias("words"))
    spans = spans.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("spans"))
    count, size = bytes_of(windows, F.octet_length("window"))
    named = windows.select("window", "n", F.col("item_id").cast("string").alias("item_id"))
    listed = join_small(shared.select("digest", "window", "n").distinct(), named, count, ["window", "n"], "inner", size)
    listed = listed.groupBy("digest").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    result = spans.join(listed, "digest").join(candidates.select("digest", "n"), "digest")
    result = materialize(result, scratch(spark, "leak-results"))
    return join_counted(base.select("doc_id", "n_words", "digest"), result, "digest", "n", base.count(), "left").select(
        "doc_id",
        "digest",
        "n_words",
        F.coalesce("spans", F.array().cast("array<struct<first:int,words:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def digests(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return contamination(docs, items, window).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents whose texts share no window with an item, with their columns."""
    own, digest = free_name(docs, "own"), free_name(docs, "digest")
    found = contamination(docs, items, window).filter(F.size("spans") > 0).select(F.col("digest").alias(digest)).distinct()
    found = materialize(found, scratch(docs.sparkSession, "leak-texts"))
    count = found.count()
    keyed = docs.withColumn(own, F.sha2(text_or_empty(), 256))
    return join_small(keyed, found, count, F.col(own) == F.col(digest), "left_anti", 100 * count).drop(own)
