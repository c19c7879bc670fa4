"""Whole Arrow batches of texts as flat numpy arrays, and files in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and their offsets; a null text is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buffer = column.buffers()[2] if len(column) else None
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def small_batches(batches, place: int, most: int = 4_000_000):
    """The same rows in batches whose texts (column ``place``) have about ``most`` bytes, one text at least."""
    for batch in batches:
        column = batch.column(place)
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else []
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def gather(values: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices values[begin : begin + length], end to end."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return values[np.arange(total) + np.repeat(begins - before, lengths)]


#: New chunks that are encoded at a time.
STEP = 50_000


class Remembered:
    """Encodes distinct chunks and remembers the first ``room`` of them for later batches.

    ``encode`` takes a list of chunks to their ids end to end and how many each has.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], room: int = 400_000) -> None:
        self.encode, self.room, self.slots = encode, room, {}
        self.values, self.begins, self.lengths = (np.zeros(0, np.int64) for _ in range(3))

    def __call__(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All values, and where each chunk's begin and how many they are."""
        words = chunks.to_pylist()
        slot = np.fromiter((self.slots.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(slot < 0)
        parts = [self.encode([words[i] for i in new[at : at + STEP]]) for at in range(0, len(new), STEP)]
        counts = np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])
        values = np.concatenate([self.values, *(ids for ids, _ in parts)])
        begins, lengths = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        old = slot >= 0
        begins[old], lengths[old] = self.begins[slot[old]], self.lengths[slot[old]]
        begins[new], lengths[new] = len(self.values) + np.cumsum(counts) - counts, counts
        some = new[: self.room - len(self.slots)]
        if len(some):
            for i in some:
                self.slots[words[i]] = len(self.slots)
            self.begins, self.lengths = np.append(self.begins, begins[some]), np.append(self.lengths, lengths[some])
            self.values = values[: begins[some[-1]] + lengths[some[-1]]].copy()
        return values, begins, lengths


def encode_distinct(data: np.ndarray, starts: np.ndarray, offsets: np.ndarray, encode: Remembered) -> tuple[np.ndarray, np.ndarray]:
    """Encode each distinct chunk of a batch once: ids of all texts end to end, and how many each text has.

    ``starts`` are where chunks begin; a text's start is always one.
    """
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    bounds = np.append(starts, len(data)).astype(np.int64)
    chunks = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    coded = chunks.dictionary_encode()
    codes = coded.indices.to_numpy()
    values, begins, lengths = encode(coded.dictionary)
    upto = np.append(0, np.cumsum(lengths[codes]))
    return gather(values, begins[codes], lengths[codes]), np.diff(upto[np.searchsorted(starts, offsets)])


def merged_places(size: int, *places: np.ndarray) -> np.ndarray:
    """The distinct places, all below ``size``, in order."""
    marked = np.zeros(size, bool)
    for x in places:
        marked[x] = True
    return np.flatnonzero(marked)


def sorted_distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order; sorting is quicker here than hashing them."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def text_starts(offsets: np.ndarray) -> np.ndarray:
    """Where texts that aren't empty begin."""
    return offsets[:-1][np.diff(offsets) > 0]


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with new columns last; an old column of the same name goes."""
    kept = [i for i, name in enumerate(batch.schema.names) if name not in new]
    arrays, names = [batch.column(i) for i in kept], [batch.schema.names[i] for i in kept]
    return pa.RecordBatch.from_arrays(arrays + list(new.values()), names=names + list(new))


def open_folder(uri: str):
    """The file system of a folder that all executors share, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
