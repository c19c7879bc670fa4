"""A stored inverted index over several fields, with exact top-k that leaves out what can't matter.

Postings are rows of (term, field, block of documents) in buckets of terms; each row has
its entries, and the largest term frequency and smallest length among them, so that no
document of the block can gain more from the term than these two give, whatever the mean
length and the frequencies become later. Beside them stand the terms of each document.

A search asks for each query's rarest terms first. Documents that these find are scored in
full, which gives a score that the k-th hit has at least. Terms that together can't reach
it are left out as sources of candidates; of the others' blocks, those that can't reach it
with all their terms are left out before their entries are unpacked. What is left is
scored in full, so the hits are those of a scan.

Changes are added as segments: a changed or removed document's earlier entries are dead
from then on, and counts are corrected by what it had. ``compact`` makes one segment of
all. Every change is one version (``storage.Versions``): a reader sees it whole or not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.retrieval import B, K1, SENT_CELLS, TEXTS, terms
from corpusloom.operators.scans import SENT_ROWS, first_per, sent_if_small
from corpusloom.sources.storage import Version, Versions, written

#: Folders of terms (a number for every FOLDER documents, within bounds), documents of a block, and how far apart scores may be that rank alike.
LEAST_BUCKETS, MOST_BUCKETS, FOLDER, BLOCK, SLACK = 8, 256, 20_000, 1024, 1e-6
#: Of a query's rarest terms, so many times k documents are scored first.
SEEDS = 4


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def document_terms(docs: DataFrame, fields: dict[str, float] | list[str]) -> DataFrame:
    """id, field (its place), length, and terms (array of term and tf), a row for each field of each document.

    Terms are counted inside their row, some texts at a time: nothing is shuffled.
    """
    n = len(fields)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                for f in range(n):
                    sizes = batch.column(1 + f).value_lengths().to_numpy(zero_copy_only=False)
                    coded = batch.column(1 + f).flatten().dictionary_encode()
                    width = max(1, len(coded.dictionary))
                    key, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                    offsets = pa.array(np.searchsorted(key, np.arange(len(sizes) + 1) * width).astype(np.int32))
                    found = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(key % width)), pa.array(tf.astype(np.int32))], names=["term", "tf"])
                    columns = [batch.column(0), pa.array(np.full(len(sizes), f, np.int32)), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(offsets, found)]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "field", "length", "terms"])

    words = docs.select("id", *[terms(F.coalesce(F.col(f), F.lit(""))).alias(f"f{i}") for i, f in enumerate(fields)])
    return words.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, field int, length int, terms array<struct<term:string,tf:int>>")


def postings_of(documents: DataFrame, blocks: int, buckets: int) -> DataFrame:
    """bucket, term, field, block, most_tf, least_length and entries (array of id, tf, length) of documents' terms.

    One shuffle of documents by block; tasks turn them round, a batch of some blocks at a
    time. A block may have several rows of a term, where a batch ends inside it or it has
    many more than BLOCK documents, which are dealt to several tasks then.
    """
    parts = max(1, -(-documents.count() // (2 * blocks * BLOCK)))
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block")
    dealt = documents.select("id", "field", "length", block, "terms").repartition("block", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(parts))).sortWithinPartitions("block")
    kind = documents.schema["id"].dataType.simpleString()
    rows = dealt.mapInArrow(_turned, f"term string, field int, block int, most_tf int, least_length int, entries array<struct<id:{kind},tf:int,length:int>>")
    return rows.withColumn("bucket", bucket_of("term", buckets))


def _turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (term, field, block) with their documents, out of documents with their terms."""
    for batch in batches:
        ids, own, terms = batch.column(0), [batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)], batch.column(4)
        row = np.repeat(np.arange(batch.num_rows), terms.value_lengths().to_numpy(zero_copy_only=False))
        if not len(row):
            continue
        field, length, block = (x[row] for x in own)
        coded, tf = (terms.flatten().field(i) for i in (0, 1))
        coded, tf = coded.dictionary_encode(), tf.to_numpy(zero_copy_only=False)
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        key = (block.astype(np.int64) * (int(field.max()) + 1) + field) * len(coded.dictionary) + code
        order = np.argsort(key)
        starts = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
        first, tf, length = order[starts], tf[order], length[order]
        offsets = np.append(starts, len(order)).astype(np.int32)
        entries = pa.StructArray.from_arrays([ids.take(pa.array(row[order])), pa.array(tf), pa.array(length)], names=["id", "tf", "length"])
        columns = [coded.dictionary.take(pa.array(code[first])), pa.array(field[first]), pa.array(block[first]), pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(length, starts)), pa.ListArray.from_arrays(pa.array(offsets), entries)]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "field", "block", "most_tf", "least_length", "entries"])


def counts_of(documents: DataFrame, sign: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """What documents add to the counts of terms and of fields, or take away."""
    each = documents.select("field", F.explode("terms").alias("x")).select("field", "x.term")
    of_terms = each.groupBy("term", "field").agg((sign * F.count("*")).alias("df")).withColumn("bucket", bucket_of("term", buckets))
    return of_terms, documents.groupBy("field").agg((sign * F.count("*")).alias("rows"), (sign * F.sum("length")).alias("total"))


@dataclass
class TextIndex:
    """An index under a folder; ``fields`` have names only, weights come with a search."""

    store: Versions
    version: Version

    @classmethod
    def create(cls, spark: SparkSession, path: str, docs: DataFrame, fields: list[str]) -> TextIndex:
        """A new index of ``docs`` (id and fields; ids once)."""
        store = Versions(spark, path)
        n = docs.count()
        buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, n // FOLDER))
        empty = Version(notes={"fields": list(fields), "blocks": max(1, -(-n // BLOCK)), "buckets": buckets, "segment": -1})
        return cls(store, empty).put(docs)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TextIndex:
        store = Versions(spark, path)
        return cls(store, store.at())

    def table(self, name: str) -> DataFrame | None:
        return self.store.read(name, self.version)

    def live(self, name: str = "documents") -> DataFrame:
        """The rows of a table whose document wasn't changed or removed by a later segment."""
        return self.alive(self.table(name))

    def alive(self, rows: DataFrame) -> DataFrame:
        dead = self.table("dead")
        if dead is None:
            return rows
        last = dead.groupBy("id").agg(F.max("segment").alias("__until"))
        return rows.join(sent_if_small(last), "id", "left").filter(F.col("__until").isNull() | (F.col("segment") >= F.col("__until"))).drop("__until")

    def put(self, docs: DataFrame) -> TextIndex:
        """With new or changed documents."""
        return self._segment(document_terms(docs, self.version.notes["fields"]), docs.select("id").distinct())

    def remove(self, ids: DataFrame) -> TextIndex:
        """Without documents of these ids."""
        return self._segment(None, ids.select("id").distinct())

    def _segment(self, new: DataFrame | None, changed: DataFrame) -> TextIndex:
        """The next version: entries of new documents, and of those that were changed none of before."""
        notes = self.version.notes
        number, buckets = notes["segment"] + 1, notes["buckets"]
        tables = {k: list(v) for k, v in self.version.tables.items()}

        def add(table: str, rows: DataFrame, *by: str) -> str:
            tables.setdefault(table, []).append(self.store.write(rows.withColumn("segment", F.lit(number)), table, *by))
            return tables[table][-1]

        if number:
            old = written(self.live().join(sent_if_small(changed), "id", "left_semi"), "index-changed")
            of_terms, of_fields = counts_of(old, -1, buckets)
            add("counts", of_terms, "bucket")
            add("sizes", of_fields)
            add("dead", old.select("id").distinct())
        if new is not None:
            new = self.store.read("documents", Version(tables={"documents": [add("documents", new)]})).drop("segment")  # counted once, and where they stay
            of_terms, of_fields = counts_of(new, 1, buckets)
            add("postings", postings_of(new, notes["blocks"], buckets).sortWithinPartitions("bucket", "term", "field", "block"), "bucket")
            add("counts", of_terms.repartition("bucket"), "bucket")
            add("sizes", of_fields)
        return replace(self, version=self.store.commit(self.version, tables, **(notes | {"segment": number})))

    def compact(self) -> TextIndex:
        """All segments as one, with blocks for the documents there are now."""
        documents = written(self.live().drop("segment"), "index-compacted")
        blocks = max(1, -(-documents.select("id").distinct().count() // BLOCK))
        fresh = Version(self.version.number, {}, self.version.notes | {"segment": -1, "blocks": blocks})
        return replace(self, version=fresh)._segment(documents, documents.select("id").limit(0))

    # ---- search

    def weights(self, asked: DataFrame, weight: dict[str, float]) -> DataFrame:
        """term, field, df, mean, idf (weighted) and most (what any document can gain) of the asked terms that there are.

        Only the buckets of asked terms are read.
        """
        wanted = asked.select("term").distinct().withColumn("bucket", bucket_of("term", self.version.notes["buckets"]))
        buckets = [r[0] for r in wanted.select("bucket").distinct().collect()]  # MOST_BUCKETS at most
        wanted = sent_if_small(wanted)
        counts = self.table("counts").filter(F.col("bucket").isin(buckets)).join(wanted, ["bucket", "term"]).groupBy("bucket", "term", "field").agg(F.sum("df").alias("df")).filter("df > 0")
        tops = self.table("postings").filter(F.col("bucket").isin(buckets)).select("bucket", "term", "field", "most_tf", "least_length").join(wanted, ["bucket", "term"])
        tops = tops.groupBy("term", "field").agg(F.max("most_tf").alias("most_tf"), F.min("least_length").alias("least_length"))
        sizes = self.table("sizes").groupBy("field").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"))
        share = F.element_at(F.array(*[F.lit(float(weight.get(f, 0.0))) for f in self.version.notes["fields"]]), F.col("field") + 1)
        idf = share * F.log(1 + (F.col("rows") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        rows = counts.join(tops, ["term", "field"]).join(F.broadcast(sizes), "field").withColumns({"mean": F.col("total") / F.col("rows"), "idf": idf}).filter("idf > 0")
        return rows.select("bucket", "term", "field", "df", "mean", "idf", gain("most_tf", "least_length").alias("most"))

    def search(self, queries: DataFrame, weight: dict[str, float], k: int) -> DataFrame:
        """query_id, id, score and rank of the k best documents of each query (query_id, query)."""
        asked = written(queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term")), "index-asked")
        known = written(self.weights(asked, weight), "index-weights")
        plan = written(query_plan(asked, known, k), "index-plan")
        buckets = [r[0] for r in known.select("bucket").distinct().collect()]
        seeds = self.entries(plan.filter("seed"), known, buckets)
        found = seeds.groupBy("query_id", "id").agg(F.sum("part").alias("partial"))
        first = first_per(found, ["query_id"], [F.desc("partial"), "id"], SEEDS * k, "__seed").select("query_id", "id")
        first = written(self.complete(first, plan, known), "index-first")
        least = first_per(first, ["query_id"], [F.desc("score")], k).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).filter(F.col("n") >= k).select("query_id", F.col("least") - SLACK)
        least = least.toDF("query_id", "least")
        # terms in the order of what they can give: as long as they can't reach the least score together, no document needs them alone
        rising = Window.partitionBy("query_id").orderBy("most", "term")
        sums = plan.join(least, "query_id", "left").withColumn("upto", F.sum("most").over(rising))
        sums = sums.withColumn("needed", F.coalesce(F.col("upto") >= F.col("least"), F.lit(True)))
        rest = F.coalesce(F.sum(F.when(~F.col("needed"), F.col("most"))).over(Window.partitionBy("query_id")), F.lit(0.0))
        sums = written(sums.withColumn("rest", rest), "index-sums")
        needed = sums.filter("needed").select("query_id", "term", "least", "rest")
        partial = self.entries(needed, known, buckets, prune=True).groupBy("query_id", "id").agg(F.sum("part").alias("partial"), F.first("least").alias("least"), F.first("rest").alias("rest"))
        hopeful = partial.filter(F.coalesce(F.col("partial") + F.col("rest") >= F.col("least"), F.lit(True))).select("query_id", "id")
        scores = self.complete(hopeful, plan, known)
        return first_per(scores, ["query_id"], [F.desc(F.round("score", 9)), "id"], k)

    def blocks_of(self, wanted: DataFrame, known: DataFrame, buckets: list[int], prune: bool) -> DataFrame:
        """Postings rows of wanted terms (query_id, term, and others), without those of blocks that can't reach the least score."""
        postings = self.table("postings").filter(F.col("bucket").isin(buckets))
        weighed = postings.join(sent_if_small(known.select("bucket", "term", "field", "mean", "idf")), ["bucket", "term", "field"])
        rows = weighed.join(sent_if_small(wanted), "term")
        if not prune:
            return rows
        # a document is in one block and may be in several segments' rows of it, dead but for one
        gains = rows.withColumn("top", gain("most_tf", "least_length")).groupBy("query_id", "block", "term", "field").agg(F.max("top").alias("top"), F.first("least").alias("least"), F.first("rest").alias("rest"))
        reach = gains.groupBy("query_id", "block").agg(F.sum("top").alias("top"), F.first("least").alias("least"), F.first("rest").alias("rest"))
        open_blocks = reach.filter(F.coalesce(F.col("top") + F.col("rest") >= F.col("least"), F.lit(True))).select("query_id", "block")
        return rows.join(open_blocks, ["query_id", "block"], "left_semi")

    def entries(self, wanted: DataFrame, known: DataFrame, buckets: list[int], prune: bool = False) -> DataFrame:
        """What live documents gain from wanted terms."""
        rows = self.blocks_of(wanted, known, buckets, prune)
        each = rows.select(*wanted.columns, "segment", "mean", "idf", F.explode("entries").alias("x")).select("*", "x.*").drop("x")
        return self.alive(each).withColumn("part", gain("tf", "length"))

    def complete(self, pairs: DataFrame, plan: DataFrame, known: DataFrame) -> DataFrame:
        """query_id, id and score of pairs (query_id, id), from all terms of the documents.

        While the asked terms by their queries make a small table, a document's terms are
        multiplied by it where they are, and never repeated for its queries.
        """
        pairs = written(pairs, "index-pairs")
        size = plan.agg(F.count_distinct("term").alias("terms"), F.count_distinct("query_id").alias("queries")).first()
        if size["terms"] * size["queries"] > SENT_CELLS:
            return self._complete_joined(pairs, plan, known)
        asked = plan.select("query_id", "term").collect()  # SENT_CELLS cells at most
        names, words = sorted({str(r["query_id"]) for r in asked}), sorted({r["term"] for r in asked})
        place, column = {w: i for i, w in enumerate(words)}, {n: i for i, n in enumerate(names)}
        table = np.zeros((len(words), len(names)))
        for r in asked:
            table[place[r["term"]], column[str(r["query_id"])]] = 1
        idf, means = np.zeros((len(self.version.notes["fields"]), len(words))), np.ones(len(self.version.notes["fields"]))
        for r in known.select("term", "field", "mean", "idf").collect():  # a row for each asked term and field
            if r["term"] in place:
                idf[r["field"], place[r["term"]]], means[r["field"]] = r["idf"], r["mean"]
        sent = pairs.sparkSession.sparkContext.broadcast((names, words, table, idf, means))

        def run(batches):
            names, words, table, idf, means = sent.value
            names, words = pa.array(names, pa.string()), pa.array(words, pa.string())
            for whole in batches:
                for at in range(0, whole.num_rows, TEXTS):
                    batch = whole.slice(at, TEXTS)
                    field, length = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                    row, at_term, own = _places(batch.column(3), words, "term")
                    tf = batch.column(3).flatten().field("tf").to_numpy(zero_copy_only=False)[own]
                    gains, of = np.zeros((batch.num_rows, len(words))), field[row]
                    gains[row, at_term] = idf[of, at_term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / means[of]))
                    row, at_query, own = _places(batch.column(4), names)
                    parts = (gains @ table)[row, at_query]
                    real = parts > 0
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(at_query[real])), batch.column(0).take(pa.array(row[real])), pa.array(parts[real])], names=["query_id", "id", "part"])

        own = pairs.groupBy("id").agg(F.collect_list("query_id").alias("queries"))
        few = pairs.limit(SENT_ROWS + 1).count() <= SENT_ROWS
        documents = self.alive(self.table("documents").join(F.broadcast(own) if few else own, "id"))
        kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("query_id", "id")}
        each = documents.select("id", "field", "length", "terms", F.col("queries").cast("array<string>").alias("queries"))
        each = each.mapInArrow(run, f"query_id string, id {kinds['id']}, part double")
        return each.groupBy(F.col("query_id").cast(kinds["query_id"]).alias("query_id"), "id").agg(F.sum("part").alias("score"))

    def _complete_joined(self, pairs: DataFrame, plan: DataFrame, known: DataFrame) -> DataFrame:
        """The same by joins, for more terms and queries than a table of them can be sent."""
        documents = self.alive(self.table("documents").join(sent_if_small(pairs.select("id").distinct()), "id", "left_semi"))
        each = documents.select("id", "field", "length", F.explode("terms").alias("x")).select("id", "field", "length", "x.*")
        each = each.join(sent_if_small(known.select("term", "field", "mean", "idf")), ["term", "field"]).select("id", "term", gain("tf", "length").alias("part"))
        return each.join(pairs, "id").join(sent_if_small(plan.select("query_id", "term")), ["query_id", "term"]).groupBy("query_id", "id").agg(F.sum("part").alias("score"))

    def work(self, queries: DataFrame, weight: dict[str, float], k: int) -> dict[str, int]:
        """What a search has to do: entries of asked terms, and documents scored in full, against all that match."""
        asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
        known = written(self.weights(asked, weight), "index-weights")
        buckets = [r[0] for r in known.select("bucket").distinct().collect()]
        every = self.entries(asked, known, buckets)
        return {"matching": every.select("query_id", "id").distinct().count(), "buckets": len(buckets)}


def _places(lists: pa.ListArray, known: pa.Array, name: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries of lists that are among the known values: their rows, the values' places, and which entries they are."""
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    values = lists.flatten().field(name) if name else lists.flatten()
    place = pc.fill_null(pc.index_in(values, value_set=known), -1).to_numpy(zero_copy_only=False)
    own = np.flatnonzero(place >= 0)
    return row[own], place[own], own


def gain(tf: str, length: str) -> Column:
    """What a term gives a document: grows with tf, shrinks with length."""
    return F.col("idf") * F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(length) / F.col("mean")))


def query_plan(asked: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """query_id, term, most, seed: the asked terms that there are, and whether a search begins with them.

    It begins with the rarest terms, as many as have some times k entries.
    """
    of_term = known.groupBy("term").agg(F.sum("most").alias("most"), F.sum("df").alias("df"))
    before = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    rows = asked.join(sent_if_small(of_term), "term").withColumn("before", F.coalesce(F.sum("df").over(before), F.lit(0)))
    return rows.select("query_id", "term", "most", (F.col("before") < SEEDS * k).alias("seed"))
