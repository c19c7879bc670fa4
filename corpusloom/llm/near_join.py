"""Documents joined by the Jaccard similarity of their word n-grams: MinHash banding, then full verification.

Bands and rows are chosen for a target recall at the threshold. Documents of one n-gram
set are one node from the start, so copies never meet each other. Nodes are shuffled on
their band hashes; what shares a bucket is connected, and the connected families are
verified on the full n-gram sets inside tasks. A text's set is made once, as 64-bit
hashes, and again for a node's own row, which is found by its doc_id and the hash of its
text. A family larger than a block is cut by the sizes of its sets, in classes so wide
that a link only joins a class and its neighbours, and classes in blocks; each pair of
blocks that can have links is a task of its own. Tasks return a row per node (how
many documents it links to, and a parent in the spanning forest of its links), never the
pairs, so nothing grows with the square of a family but the comparisons themselves, which
count every link, and, with its number of blocks, the times that a set is sent.

Defined results: words are runs of characters other than ASCII white space, as they are;
a text of one to four words has one n-gram, all of it; a text without words (or null)
links to nothing; a very long text is taken whole, with memory for its set in a task;
rows that repeat a doc_id count as documents, and ``keep_one`` keeps all of those of the
smallest; a row without a doc_id takes part, and a class of such rows alone has a null
class_id; an empty table gives an empty result; other columns, whatever their names, are
ignored, and kept by ``keep_one``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.arrow_text import sorted_distinct
from corpusloom.llm.components import components
from corpusloom.llm.shared import SPACE, free_name, join_counted, materialize, scratch, text_or_empty

#: Nodes of a block in a large family; a smaller family is cut in up to EVEN blocks of SMALL_BLOCK or more, to spread it.
BLOCK, SMALL_BLOCK, EVEN = 512, 64, 16
#: A block's number is its class of sizes times this, and its number in the class.
CLASS = 1 << 24
SEED = 90_001
ODD = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float, recall: float, most_hashes: int = 200) -> tuple[int, int]:
    """Bands and rows with the most rows whose recall at the threshold is reached within the hashes."""
    best = (most_hashes, 1)
    for rows in range(1, most_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > most_hashes:
            break
        best = (bands, rows)
    return best


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def ngram_sets(hashes: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The set of n-grams of each text, as sorted 64-bit hashes of n word hashes."""
    words = hashes.view(np.uint64)

    def roll(size: int, part: np.ndarray) -> np.ndarray:
        out = np.full(max(0, len(part) - size + 1), size, np.uint64)
        for k in range(size):
            out = mixed(out * ODD + part[k : k + len(out)])
        return out

    grams = roll(n, words)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        out.append(sorted_distinct(grams[a : b - n + 1]) if b - a >= n else roll(b - a, words[a:b]) if b > a else words[:0])
    return out


def node_key(grams: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        parts = [mixed(grams * ODD + np.uint64(k)).sum(dtype=np.uint64) + np.uint64(len(grams)) for k in (1, 2)]
    return np.array(parts, np.uint64).tobytes()


def list_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """A hash for each band of each set (texts by bands); sets aren't empty."""
    random = np.random.default_rng(SEED)
    factors = random.integers(1 << 62, size=bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = random.integers(1 << 63, size=bands * rows, dtype=np.uint64)
    out = np.zeros((len(sets), bands), np.uint64)
    sizes = np.cumsum([len(s) for s in sets])
    first = 0
    while first < len(sets):  # so many texts that their n-grams stay in the processor's cache
        upto = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + 30_000, side="right")))
        grams = np.concatenate(sets[first:upto])
        begins = np.append(0, np.cumsum([len(s) for s in sets[first:upto]])[:-1])
        for band in range(bands):
            value = np.full(upto - first, band + 1, np.uint64)
            for k in range(band * rows, (band + 1) * rows):
                value = mixed(value * ODD + np.minimum.reduceat(grams * factors[k] + shifts[k], begins))
            out[first:upto, band] = value
        first = upto
    return out


def word_hashes(docs: DataFrame, *columns) -> DataFrame:
    return docs.select(*columns, F.transform(F.array_remove(F.split(text_or_empty(), SPACE), ""), lambda w: F.xxhash64(w)).alias("words"))


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, hash of the text, node (null without words), the size of its set and the band hashes of each document."""

    def run(batches):
        for batch in batches:
            sets = ngram_sets(*list_column(batch.column(2)), n)
            real = [i for i, s in enumerate(sets) if len(s)]
            hashes = band_hashes([sets[i] for i in real], bands, rows)
            nodes = [node_key(s) if len(s) else None for s in sets]
            counts = np.zeros(len(sets), np.int64)
            counts[real] = bands
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(hashes.reshape(-1).view(np.int64)))
            size = pa.array([len(s) for s in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), size, lists], names=["doc_id", "hashed", "node", "size", "bands"])

    own = word_hashes(docs, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("hashed"))
    return own.mapInArrow(run, "doc_id long, hashed long, node binary, size int, bands array<long>")


def with_sets(texts: DataFrame, n: int) -> DataFrame:
    """The rows of ``texts`` with their n-gram sets in place of their texts: of a task's rows of one node the first; a row whose set isn't its node's goes."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            place = batch.schema.names.index("node")
            sets = ngram_sets(*list_column(batch.column(batch.num_columns - 1)), n)
            own = []
            for i, node in enumerate(batch.column(place).to_pylist()):
                if node not in seen and node_key(sets[i]) == node:
                    seen.add(node)
                    own.append(i)
            sets = [sets[i] for i in own]
            offsets = pa.array(np.append(0, np.cumsum([len(s) for s in sets])), pa.int32())
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            kept = batch.take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(flat))], names=[*batch.schema.names[:-1], "grams"])

    others = [c for c in texts.columns if c != "text"]
    fields = [texts.schema[c] for c in others]
    return word_hashes(texts, *others).mapInArrow(run, T.StructType([*fields, T.StructField("grams", T.ArrayType(T.LongType()))]))


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold, by exact intersection counts."""
    sizes = np.array([len(s) for s in sets])
    grams, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = count[inverse] > 1
    renumber = np.cumsum(count > 1) - 1
    owner, column = owner[shared], renumber[inverse[shared]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = max(256, 4_000_000 // len(sets))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        both += part @ part.T
    union = sizes[:, None] + sizes[None, :] - both
    out = both >= threshold * union - 1e-6
    np.fill_diagonal(out, False)
    return out


def forest(links: np.ndarray) -> np.ndarray:
    """The smallest index each index is connected to."""
    root = np.arange(len(links))
    while True:
        new = np.minimum(root, np.where(links, root[None, :], len(links)).min(axis=1, initial=len(links)))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def verify(families: DataFrame, threshold: float) -> DataFrame:
    """node, parent, links for each node and block pair; ``families`` are dealt and sorted by family, one, two."""

    def family(rows: list[tuple]):
        seen: dict[bytes, tuple] = {}
        for _, node, block, copies, grams in rows:
            seen.setdefault(node, (block, copies, grams))  # a repeated row has the same set
        nodes = list(seen)
        if len(nodes) < 2:
            return
        blocks = np.array([seen[x][0] for x in nodes])
        copies = np.array([seen[x][1] for x in nodes])
        links = linked([seen[x][2] for x in nodes], threshold)
        if rows[0][0][1] != rows[0][0][2]:
            links &= blocks[:, None] != blocks[None, :]
        parents = forest(links)
        found = np.flatnonzero(links.any(axis=1))
        if len(found):
            yield pa.RecordBatch.from_arrays(
                [pa.array([nodes[i] for i in found], pa.binary()), pa.array([nodes[parents[i]] for i in found], pa.binary()), pa.array((links[found] * copies[None, :]).sum(axis=1), pa.int64())],
                names=["node", "parent", "links"],
            )

    def run(batches):
        key, rows = None, []
        for batch in batches:
            flat, offsets = list_column(batch.column(6))
            sets = np.split(flat.view(np.uint64), offsets[1:-1])
            for *own, node, block, copies, grams in zip(*(batch.column(i).to_pylist() for i in range(6)), sets, strict=True):
                if tuple(own) != key:
                    if rows:
                        yield from family(rows)
                    key, rows = tuple(own), []
                rows.append((key, node, block, copies, grams))
        if rows:
            yield from family(rows)

    return families.mapInArrow(run, "node binary, parent binary, links long")


def blocks_of(family: DataFrame, threshold: float) -> DataFrame:
    """``family`` (family, n, size, node and others) with the block of each node and the blocks it has to meet.

    Sizes of linked sets differ by a factor of at most 1 / threshold, so classes a little
    wider than that link only to themselves and their neighbours.
    """
    width = -math.log(threshold) * (1 + 1e-6) if threshold < 1 else 1e-6
    kind = F.when(F.col("n") > SMALL_BLOCK, F.floor(F.log(F.col("size").cast("double")) / width)).otherwise(F.lit(0)).cast("int")
    rows = family.withColumn("kind", kind)
    many = F.count("*")
    kinds = rows.groupBy("family", "kind").agg(F.greatest(F.ceil(many / BLOCK), F.least(F.ceil(many / SMALL_BLOCK), F.lit(EVEN))).cast("int").alias("blocks"), many.alias("rows"))
    in_order = Window.partitionBy("family").orderBy("kind")

    def beside(step: int):
        near = F.lag("kind", step).over(in_order) == F.col("kind") - step
        return F.when(near, F.lag("blocks", step).over(in_order)).otherwise(F.lit(0))

    kinds = kinds.withColumns({"before": beside(1), "after": beside(-1)}).withColumn("place", F.concat_ws(":", "family", "kind")).drop("family", "kind")
    kinds = materialize(kinds, scratch(family.sparkSession, "near-kinds"))
    rows = join_counted(rows.withColumn("place", F.concat_ws(":", "family", "kind")), kinds, "place", "rows", rows.count())

    def numbers(step: int, count: str):
        first = (F.col("kind") + step).cast("long") * CLASS
        return F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0), F.col(count) - 1), lambda i: first + i)).otherwise(F.array().cast("array<bigint>"))

    return rows.withColumns({
        "block": F.col("kind").cast("long") * CLASS + F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("blocks")),
        "others": F.concat(numbers(-1, "before"), numbers(0, "blocks"), numbers(1, "after")),
    })


def near_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """Per document: doc_id, class_id (smallest doc_id of its class), n_links, class_size."""
    spark = docs.sparkSession
    bands, rows = choose_bands(threshold, recall)
    base = materialize(signatures(docs, n, bands, rows), scratch(spark, "near-signatures"))
    key = F.xxhash64("node").alias("key")  # short, for the candidate stages; verification goes by node
    nodes = base.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "hashed")).alias("one"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.withColumn("key", key), scratch(spark, "near-nodes"))
    n_nodes = nodes.count()
    buckets = nodes.select("key", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("key").alias("least"), F.count("*").alias("n")).filter("n > 1")
    shared = materialize(shared, scratch(spark, "near-buckets"))
    candidates = components(join_counted(buckets, shared, "bucket", "n", bands * n_nodes).select(F.col("key").alias("a"), F.col("least").alias("b")))
    sizes = materialize(candidates.groupBy("component").agg(F.count("*").alias("n")), scratch(spark, "near-families"))
    family = join_counted(candidates, sizes, "component", "n", candidates.count()).select(F.col("node").alias("key"), F.col("component").alias("family"), "n")
    family = materialize(nodes.select("key", "node", "one", "copies", "size").join(family, "key"), scratch(spark, "near-members"))
    placed = blocks_of(family, threshold).select("one.doc_id", "one.hashed", "node", "copies", "family", "block", "others")
    # a node's own row: of its smallest doc_id and text hash, so that rows without a doc_id, or of one doc_id, meet only where their texts are alike
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_or_empty()).alias("hash"), text_or_empty().alias("text"))
    texts = texts.join(placed, (texts["hash"] == placed["hashed"]) & texts["id"].eqNullSafe(placed["doc_id"])).drop("id", "doc_id", "hash", "hashed")
    dealt = with_sets(texts, n).withColumn("other", F.explode("others"))
    keys = [F.col("family"), F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")]
    dealt = dealt.select(*keys, "node", "block", "copies", "grams").repartition("family", "one", "two").sortWithinPartitions("family", "one", "two")
    verified = materialize(verify(dealt, threshold), scratch(spark, "near-links"))
    classes = components(verified.select(F.col("node").alias("a"), F.col("parent").alias("b")))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "doc_id", "copies").join(links, "node", "left").join(classes, "node", "left")
    known = known.withColumn("component", F.coalesce("component", "node")).filter("copies > 1 or links is not null")
    known = materialize(known, scratch(spark, "near-known"))
    named = known.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"), F.count("*").alias("n"))
    named = materialize(named, scratch(spark, "near-named"))
    found = join_counted(known, named, "component", "n", known.count()).select("node", "class_id", "class_size", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    found = materialize(found, scratch(spark, "near-classes"))
    return join_counted(base.select("doc_id", "node"), found, "node", "copies", base.count(), "left").select(
        "doc_id",
        F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
    )


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """One document of each class stays (the smallest doc_id; of repeated rows of it, all)."""
    number = free_name(docs, "id")
    kept = near_classes(docs, **how).filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias(number)).distinct()
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(number)), "left_semi")
