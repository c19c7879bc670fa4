"""Imports as one commit: files become the notes of their sources, and all that hangs on replaced notes follows.

A batch of files is compared with the sources that there are; those that are new or have
changed are cut in chunks, which are aligned with the notes that they replace. Mentions
and vectors go over to notes of the same content, edges to every successor; what has none
goes. Then one version (``storage.Versions``) holds the new sources, notes, mentions,
vectors and edges, so a reader never sees a half of an import, and a run that stops has
changed nothing. The version also holds how far each stream has come: a batch that is
given again changes nothing.

Each table is in BUCKETS by a hash, and only buckets with a change are written anew.

Defined results: of files that repeat a uri in a batch the one of the largest hash counts;
a null content is empty; a source without text has no notes; equal content is left alone,
unless it is forced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import content_hash
from corpusloom.operators.chunking import Sizes, aligned_chunks, markdown_chunks
from corpusloom.operators.lifecycle import begin_imports, copied_mentions, remapped_edges
from corpusloom.operators.scans import first_per, sent_if_small
from corpusloom.sources.storage import Version, Versions, written

BUCKETS = 16
#: Columns of each table, and the one that says a row's bucket.
TABLES = {
    "sources": ("uri string, content_hash string, generation long, successful_generation long, status string", "uri"),
    "notes": ("id string, uri string, generation long, ordinal int, heading_path array<string>, content string, content_hash string", "uri"),
    "mentions": ("note_id string, entity_id string", "note_id"),
    "vectors": ("id string, embedding array<float>", "id"),
    "edges": ("id string, edge_type string, from_id string, to_id string, confidence double", "from_id"),
}


@dataclass
class Library:
    """The tables under a folder, as of one version."""

    store: Versions
    version: Version

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Library:
        """The newest version; an empty library where there is none."""
        store = Versions(spark, path)
        return cls(store, store.at())

    def rows(self, table: str) -> DataFrame:
        """A table: of each folder the buckets that are still live."""
        columns, _ = TABLES[table]
        live: dict[str, list[int]] = {}
        for bucket, folder in self.version.notes.get("live", {}).get(table, {}).items():
            live.setdefault(folder, []).append(int(bucket))
        out = self.store.spark.createDataFrame([], columns)
        for folder, buckets in live.items():
            part = self.store.read(table, Version(tables={table: [folder]})).filter(F.col("bucket").isin(buckets))
            out = out.unionByName(part.select(*out.columns))
        return out

    def seen(self, stream: str, epoch: int) -> bool:
        return self.version.notes.get("streams", {}).get(stream, -1) >= epoch

    def changed(self, changes: dict[str, tuple[DataFrame | None, DataFrame | None]], **notes) -> Library:
        """The next version. ``changes``: for a table the rows that go (with all their columns) and those that come."""
        live = {k: dict(v) for k, v in self.version.notes.get("live", {}).items()}
        for table, (gone, new) in changes.items():
            columns, key = TABLES[table]
            own = [c.split()[0] for c in columns.split(", ")]
            bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
            new = written(new.select(*own), f"library-{table}") if new is not None else None
            gone = written(gone.select(*own).withColumn("__gone", F.lit(True)), f"library-{table}") if gone is not None else None
            parts = [x.select(bucket.alias("bucket")) for x in (gone, new) if x is not None]
            touched = sorted({r[0] for x in parts for r in x.distinct().collect()})  # BUCKETS at most
            if not touched:
                continue
            kept = self.rows(table).withColumn("bucket", bucket).filter(F.col("bucket").isin(touched))
            if gone is not None:
                by = {"notes": "id", "sources": "uri", "vectors": "id", "edges": "id"}.get(table)
                names = [by] if by else own
                kept = kept.join(sent_if_small(gone.select(*names).distinct()), names, "left_anti")
            after = kept if new is None else kept.unionByName(new.withColumn("bucket", bucket))
            folder = self.store.write(after.repartition("bucket"), table, "bucket")
            live.setdefault(table, {}).update({str(b): folder for b in touched})
        tables = {t: sorted(set(f.values())) for t, f in live.items()}
        return Library(self.store, self.store.commit(self.version, tables, **(self.version.notes | {"live": live} | notes)))

    def put(self, files: DataFrame, stream: str | None = None, epoch: int = 0, sizes: Sizes = Sizes(), force: bool = False) -> Library:
        """Import a batch of files (uri, content); with a stream's name, a batch of an epoch that it has had is left out."""
        if stream is not None and self.seen(stream, epoch):
            return self
        text = F.coalesce("content", F.lit(""))
        each = files.select("uri", text.alias("content"), content_hash(text).alias("content_hash")).filter("uri is not null")
        each = written(each.groupBy("uri").agg(F.max(F.struct("content_hash", "content")).alias("x")).select("uri", "x.*"), "import-files")
        sources = self.rows("sources")
        actions = written(begin_imports(sources, each, force), "import-actions")
        changed = actions.filter("action <> 'unchanged'").select("uri", "generation")
        new_notes = written(self.cut(each, changed, sizes), "import-notes")
        old = written(self.rows("notes").join(sent_if_small(changed.select("uri")), "uri", "left_semi"), "import-replaced")
        successors = written(succession(old, new_notes), "import-successors")
        retired = old.select("id")
        new_sources = changed.join(each.select("uri", "content_hash"), "uri").select("uri", "content_hash", "generation", F.col("generation").alias("successful_generation"), F.lit("ready").alias("status"))
        changes: dict[str, tuple[DataFrame | None, DataFrame | None]] = {
            "sources": (sources.join(sent_if_small(changed.select("uri")), "uri", "left_semi"), new_sources),
            "notes": (old, new_notes),
        }
        if self.has("mentions"):
            lost = self.rows("mentions").join(sent_if_small(retired.withColumnRenamed("id", "note_id")), "note_id", "left_semi")
            changes["mentions"] = lost, written(copied_mentions(lost, successors).distinct(), "import-mentions")
        if self.has("vectors"):
            lost = self.rows("vectors").join(sent_if_small(retired), "id", "left_semi")
            exact = successors.filter("exact_content").select(F.col("old_id").alias("id"), "new_id")
            changes["vectors"] = lost, written(lost.join(exact, "id").select(F.col("new_id").alias("id"), "embedding"), "import-vectors")
        if self.has("edges"):
            lost, moved = self.moved_edges(self.rows("edges"), retired, successors)
            changes["edges"] = written(lost, "import-lost"), written(moved, "import-moved")
        outcome = counted(actions, new_notes, old, successors, changes)
        streams = self.version.notes.get("streams", {}) | ({stream: epoch} if stream is not None else {})
        return self.changed(changes, streams=streams, outcome=outcome)

    def has(self, table: str) -> bool:
        return bool(self.version.notes.get("live", {}).get(table))

    def cut(self, files: DataFrame, changed: DataFrame, sizes: Sizes) -> DataFrame:
        """The notes of changed files."""
        rows = files.join(sent_if_small(changed), "uri")
        chunks = markdown_chunks(rows.select(F.col("uri").alias("source_identity"), F.col("content").alias("markdown")), sizes)
        named = chunks.join(sent_if_small(changed), F.col("source_identity") == F.col("uri"))
        key = F.sha2(F.concat_ws("\0", "uri", F.col("generation").cast("string"), F.col("ordinal").cast("string")), 256)
        return named.select(F.concat(F.lit("note:"), key).alias("id"), "uri", "generation", "ordinal", "heading_path", "content", "content_hash")

    def moved_edges(self, edges: DataFrame, retired: DataFrame, successors: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Edges that touch replaced notes, and what they become: both ends are notes that stay or successors, and each is there once."""
        ends = sent_if_small(retired.select(F.col("id").alias("__end")))
        marked = edges.join(ends.withColumnRenamed("__end", "__f"), F.col("from_id") == F.col("__f"), "left").join(ends.withColumnRenamed("__end", "__t"), F.col("to_id") == F.col("__t"), "left")
        lost = marked.filter("__f is not null or __t is not null").select(*edges.columns)
        moved = remapped_edges(lost, successors.select("old_id", "new_id"))
        for end in ("from_id", "to_id"):
            moved = moved.join(ends.withColumnRenamed("__end", end), end, "left_anti")
        moved = first_per(moved, ["edge_type", "from_id", "to_id"], ["id"], 1, "__first").drop("__first")
        stay = edges.join(lost.select("id"), "id", "left_anti").select("edge_type", "from_id", "to_id")
        moved = moved.join(stay, ["edge_type", "from_id", "to_id"], "left_anti")
        return lost, moved.withColumn("id", F.concat_ws(":", "edge_type", F.sha2(F.concat_ws("\0", "from_id", "to_id"), 256)))

    def failed(self, uri: str) -> Library:
        """A source whose import failed: it is marked, and its notes stay as they were promoted."""
        one = self.rows("sources").filter(F.col("uri") == uri)
        return self.changed({"sources": (one, one.withColumn("status", F.lit("failed")))})


def succession(old: DataFrame, new: DataFrame) -> DataFrame:
    """old_id, new_id, exact_content of notes that follow one another."""

    def side(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("uri").alias("source_id"), "ordinal", "heading_path", "content")

    pairs = aligned_chunks(side(old), side(new))
    a = old.select(F.col("uri").alias("source_id"), F.col("ordinal").alias("old_ordinal"), F.col("id").alias("old_id"))
    b = new.select(F.col("uri").alias("source_id"), F.col("ordinal").alias("new_ordinal"), F.col("id").alias("new_id"))
    return pairs.join(a, ["source_id", "old_ordinal"]).join(b, ["source_id", "new_ordinal"]).select("old_id", "new_id", "exact_content")


def counted(actions: DataFrame, new_notes: DataFrame, old: DataFrame, successors: DataFrame, changes: dict) -> dict[str, int]:
    """What an import did, as sums."""
    of = actions.agg(*[F.count_if(F.col("action") == a).alias(f"{a}_sources") for a in ("created", "updated", "unchanged")]).first().asDict()
    kept = successors.agg(F.count_if("exact_content").alias("exact"), F.count_if(~F.col("exact_content")).alias("changed")).first()
    rows = lambda table, side: changes[table][side].count() if table in changes else 0
    created, retired, reused = new_notes.count(), old.count(), rows("vectors", 1)
    return of | {
        "created_notes": created, "retired_notes": retired, "exact_successors": kept["exact"], "changed_successors": kept["changed"], "notes_without_successor": retired - kept["exact"] - kept["changed"],
        "copied_mentions": rows("mentions", 1), "reused_vectors": reused, "to_embed": created - reused, "lost_edges": rows("edges", 0), "moved_edges": rows("edges", 1),
    }
