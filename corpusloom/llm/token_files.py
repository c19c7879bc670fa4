"""Token ids as Arrow files of fixed-size-list batches, and back.

Documents are range-partitioned and sorted by doc_id; each partition becomes one shard:
an Arrow file whose rows are sequences of exactly ``length`` ids with a mask (false on the
padding of the last sequence) in batches of ``ROWS_PER_BATCH``, only the last of which may be
shorter, so any sequence is read in place by its number, and a small
index file with the place of each document. Ids are uint16 where the vocabulary allows,
else uint32. A shard counts only when its name is in the manifest, which Spark commits;
files of lost or repeated task attempts are never read.

Tokenising: pre-tokens of the byte-level pattern surely begin at some places (see
``sure_cuts``), so texts are cut there and each distinct chunk is encoded once by the
tokenizers library.

Defined results: a null text is empty and has the end id alone; documents come in
ascending doc_id order, a null doc_id first, equal ids by text; repeated rows are documents
of their own; a very long text is encoded whole, a text being in memory at a time, and runs
over as many sequences as it needs; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.arrow_text import Remembered, encode_distinct, flat_bytes, merged_places, open_folder, small_batches, text_starts
from corpusloom.llm.shared import materialize, scratch, text_or_empty

MANIFEST_SCHEMA = "shard int, path string, docs long, tokens long"
ROWS_PER_BATCH = 256


@functools.lru_cache(2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    return found


def sure_cuts(data: np.ndarray) -> np.ndarray:
    """Places where the byte-level pattern surely starts a new pre-token.

    These are a single space or line end between characters that aren't white space (after
    a line end, too), and a mark of punctuation after a letter. Characters beyond ASCII
    count as white space when their lead byte is one that a Unicode space can have, and as
    letters only when they are Latin-1 letters; both are more careful than needed.
    """
    if len(data) < 3:
        return np.zeros(0, np.int64)
    table = np.zeros((5, 256), bool)
    blank, lead, letter, mark, single = table
    blank[[*range(9, 14), *range(28, 33)]] = True
    lead[[0xC2, 0xE1, 0xE2, 0xE3]] = True
    letter[[*range(65, 91), *range(97, 123)]] = True
    mark[[ord(c) for c in ".,;:!?"]] = True
    single[[10, 32]] = True
    at = np.flatnonzero(single[data[1:-1]]) + 1
    before, after = data[at - 1], data[at + 1]
    wide = (before >= 0x80) & ((at < 3) | lead[data[at - 2]] | lead[data[np.maximum(at - 3, 0)]])
    at = at[~blank[before] & ~blank[after] & ~lead[after] & ~wide]
    ends = np.flatnonzero(mark[data[2:]]) + 2
    last, second = data[ends - 1], data[ends - 2]
    latin = (second == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
    return np.concatenate([at, at[data[at] == 10] + 1, ends[letter[last] | latin]])


@functools.lru_cache(2)
def encoder(path: str) -> Remembered:
    library = tokenizer(path)
    spaced = np.array([(library.id_to_token(i) or "").startswith("\u0120") for i in range(library.get_vocab_size())])

    def ids_of(texts: list[str]) -> list[np.ndarray]:
        return [np.array(found.ids, np.int64) for found in library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks whose only space is their first character go through the library many at a time: each begins at an id with a space."""
        plain = [i for i, c in enumerate(chunks) if c[0] == " " and c.find(" ", 1) < 0]
        counts, out = np.zeros(len(chunks), np.int64), [None] * len(chunks)
        left = np.ones(len(chunks), bool)
        for at in range(0, len(plain), 200_000):
            groups = [plain[k : k + 400] for k in range(at, min(at + 200_000, len(plain)), 400)]
            for group, ids in zip(groups, ids_of(["".join([chunks[i] for i in g]) for g in groups]), strict=True):
                begins = np.flatnonzero(spaced[ids])
                if len(begins) == len(group):
                    for i, part in zip(group, np.split(ids, begins[1:]), strict=True):
                        out[i] = part
                    left[group] = False
        rest = np.flatnonzero(left)
        for at in range(0, len(rest), 20_000):
            some = rest[at : at + 20_000]
            for i, ids in zip(some, ids_of([chunks[i] for i in some]), strict=True):
                out[i] = ids
        counts = np.array([len(x) for x in out], np.int64)
        return np.concatenate([np.zeros(0, np.int64), *out]), counts

    return Remembered(encode)


def encode_batch(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and how many each has."""
    data, offsets = flat_bytes(column)
    return encode_distinct(data, merged_places(len(data), text_starts(offsets), sure_cuts(data)), offsets, encoder(path))


class Shard:
    """Writes one partition's ids in sequences of equal length, and the index of its documents."""

    def __init__(self, folder: str, length: int, kind: pa.DataType) -> None:
        system, root = open_folder(folder)
        system.create_dir(root, recursive=True)
        self.name = uuid.uuid4().hex
        self.length, self.kind, self.rest, self.tokens, self.docs = length, kind, np.zeros(0, np.uint32), 0, 0
        schema = pa.schema({"input_ids": pa.list_(kind, length), "mask": pa.list_(pa.bool_(), length)})
        places = pa.schema({"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64()})
        self.files = [system.open_output_stream(f"{root}/{self.name}{end}") for end in (".arrow", ".index.arrow")]
        self.sequences, self.index = (pa.ipc.new_file(f, s) for f, s in zip(self.files, (schema, places), strict=True))

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        starts = self.tokens + np.cumsum(counts) - counts
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64()), pa.array(starts), pa.array(counts)], schema=self.index_schema()))
        self.tokens += len(ids)
        self.docs += len(counts)
        ids = np.concatenate([self.rest, ids.astype(np.uint32)])
        step = self.length * ROWS_PER_BATCH
        whole = len(ids) // step * step
        for at in range(0, whole, step):
            self.write(ids[at : at + step], None)
        self.rest = ids[whole:]

    def index_schema(self) -> pa.Schema:
        return pa.schema({"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64()})

    def write(self, ids: np.ndarray, real: int | None) -> None:
        mask = np.ones(len(ids), bool)
        if real is not None:
            mask[real:] = False
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x, type=t), self.length) for x, t in ((ids, self.kind), (mask, pa.bool_()))]
        self.sequences.write_batch(pa.RecordBatch.from_arrays(lists, schema=pa.schema({"input_ids": lists[0].type, "mask": lists[1].type})))

    def close(self) -> None:
        if len(self.rest):
            self.write(np.pad(self.rest, (0, -len(self.rest) % self.length)), len(self.rest))
        for x in (self.sequences, self.index, *self.files):
            x.close()


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, length: int = 2048, end_id: int = 2) -> DataFrame:
    """Encode and write the documents; returns the manifest: shard, path, docs, tokens."""

    def write(batches):
        kind = pa.uint16() if tokenizer(tokenizer_path).get_vocab_size() <= 1 << 16 else pa.uint32()
        shard = None
        for batch in small_batches(batches, 1):
            shard = shard or Shard(folder, length, kind)
            ids, counts = encode_batch(batch.column(1), tokenizer_path)
            ids = np.insert(ids.astype(np.uint32), np.cumsum(counts), end_id)
            shard.add(batch.column(0), ids, counts + 1)
        if shard:
            shard.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [f"{folder}/{shard.name}"], "docs": [shard.docs], "tokens": [shard.tokens]}
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return materialize(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, MANIFEST_SCHEMA), f"{folder}/manifest")


class Sequences:
    """Random access to a shard's sequences by number.

    A file of a local or mounted folder is mapped: ids are numpy views and masks Arrow
    views of the mapping, nothing is copied. In another store the batches asked for are read.
    """

    def __init__(self, path: str) -> None:
        system, root = open_folder(f"{path}.arrow")
        self.source = pa.memory_map(root) if system.type_name == "local" else system.open_input_file(root)
        self.file = pa.ipc.open_file(self.source)
        batches = self.file.num_record_batches
        self.length = self.file.schema.field("input_ids").type.list_size
        self.count = (batches - 1) * ROWS_PER_BATCH + self.file.get_batch(batches - 1).num_rows if batches else 0

    def __len__(self) -> int:
        return self.count

    def views(self, first: int = 0, count: int | None = None) -> Iterator[tuple[np.ndarray, pa.FixedSizeListArray]]:
        """Ids (sequences by length) and masks of ``count`` sequences from ``first`` on, for each batch that has some."""
        end = self.count if count is None else min(self.count, first + count)
        while first < end:
            batch = self.file.get_batch(first // ROWS_PER_BATCH)
            at = first % ROWS_PER_BATCH
            some = batch.slice(at, min(batch.num_rows - at, end - first))
            yield some.column(0).flatten().to_numpy().reshape(-1, self.length), some.column(1)
            first += some.num_rows


def read_sequences(path: str, first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """``count`` sequences of a shard from ``first`` on, and their masks, as arrays of their own."""
    sequences = Sequences(path)
    parts = [(ids, masks.flatten().to_numpy(zero_copy_only=False).reshape(ids.shape)) for ids, masks in sequences.views(first, count)]
    if not parts:
        return np.zeros((0, sequences.length), np.uint16), np.zeros((0, sequences.length), bool)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def shard_documents(path: str) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
    """Each document of a shard, in order, as (doc_id, start in the shard, views of its ids)."""
    sequences = Sequences(path)
    system, root = open_folder(f"{path}.index.arrow")
    places = pa.ipc.open_file(system.open_input_file(root))
    batches = (ids.reshape(-1) for ids, _ in sequences.views())
    held = np.zeros(0, np.uint16)
    for k in range(places.num_record_batches):
        for doc_id, start, n in zip(*(c.to_pylist() for c in places.get_batch(k).columns), strict=True):
            parts = []
            while n:
                held = held if len(held) else next(batches)
                parts.append(held[:n])
                held = held[n:]
                n -= len(parts[-1])
            yield doc_id, start, parts


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def read(batches):
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for doc_id, start, parts in shard_documents(path):
                    crc = 0
                    for part in parts:
                        crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                    rows.append((doc_id, before + start, sum(map(len, parts)), crc))
                    if len(rows) == 10_000:
                        yield as_batch(rows)
                        rows = []
                if rows:
                    yield as_batch(rows)

    def as_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("path", before.alias("before"))
    return shards.repartition(max(1, manifest.count()), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_through_files(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return read_tokens(write_tokens(docs, tokenizer_path, scratch(docs.sparkSession, "tokens")))
