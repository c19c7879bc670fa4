"""SentencePiece encoding and decoding with an Aho-Corasick automaton and one Viterbi pass.

The automaton is built over the model's pieces. All distinct words of an Arrow batch step
through it side by side, one character at a time; at each position the output links list
every piece that ends there, from the longest to the shortest, and relax the best score.
A word is a run of word-start marks and what follows up to the next one; no piece crosses
from a letter into a mark (checked when the model is loaded, else the text is one word),
so words are independent and each distinct one is solved once. A character that no piece
covers falls back to the bytes of its UTF-8 form.

Scores are the model's own: for a BPE model a piece's score is minus its merge rank, and
the result is the segmentation of the largest sum; among equal sums the longer last piece.

Defined results: a null text counts as empty and has no ids; repeated rows are encoded as
rows; a very long text is encoded whole, a text being in memory at a time; an empty table
gives an empty result; columns called piece_ids, piece_score, round_trip or decoded are
replaced by what makes them, others are kept.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.arrow_text import Remembered, encode_distinct, flat_bytes, gather, merged_places, small_batches, text_starts, with_columns

MARK = "▁"
UNKNOWN_PENALTY = 10.0


class PieceModel:
    """Pieces, scores and the automaton, as flat arrays."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = library.get_piece_size()
        self.pieces = [library.id_to_piece(i) for i in range(n)]
        special = [library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i) for i in range(n)]
        usable = [i for i in range(n) if not special[i] and self.pieces[i]]
        self.split = not any(MARK in self.pieces[i].lstrip(MARK) for i in usable)
        scores = {i: library.get_score(i) for i in usable}
        self.unknown_score = min((s for s in scores.values() if s > -1e8), default=0.0) - UNKNOWN_PENALTY
        self.byte_ids = np.array([library.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.letters = np.array(sorted({ord(c) for i in usable for c in self.pieces[i]}), dtype=np.int64)
        self._automaton({self.pieces[i]: i for i in usable}, scores)
        self.piece_scores = np.zeros(n)
        self.piece_scores[usable] = [scores[i] for i in usable]
        self.piece_scores[self.byte_ids] = self.unknown_score
        self.remembered = Remembered(lambda words: self.solve([w.replace(" ", MARK) for w in words]))
        texts = [b"" if library.is_control(i) else bytes([i - self.byte_ids[0]]) if library.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.text_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.text_lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.text_begins = np.cumsum(self.text_lengths) - self.text_lengths

    def _automaton(self, pieces: dict[str, int], scores: dict[int, float]) -> None:
        self.width = len(self.letters) + 1
        column = {int(c): i for i, c in enumerate(self.letters)}
        edges: dict[int, int] = {}
        depth, ends = [0], [-1]
        levels: list[list[tuple[int, int, int]]] = []
        for piece, number in pieces.items():
            node = 0
            for c in piece:
                key = node * self.width + column[ord(c)]
                if key not in edges:
                    edges[key] = len(depth)
                    depth.append(depth[node] + 1)
                    ends.append(-1)
                    while len(levels) < depth[-1]:
                        levels.append([])
                    levels[depth[-1] - 1].append((node, column[ord(c)], len(depth) - 1))
                node = edges[key]
            ends[node] = number
        fail, link = [0] * len(depth), [0] * len(depth)
        for level in levels:
            for parent, c, node in level:
                back = fail[parent]
                while parent and back and back * self.width + c not in edges:
                    back = fail[back]
                fail[node] = edges.get(back * self.width + c, 0) if parent else 0
                link[node] = fail[node] if ends[fail[node]] >= 0 else link[fail[node]]
        self.keys = np.array(sorted(edges), dtype=np.int64)
        self.targets = np.array([edges[k] for k in self.keys.tolist()], dtype=np.int64)
        self.fail, self.link, self.depth, self.ends = (np.array(x, dtype=np.int64) for x in (fail, link, depth, ends))
        self.scores = np.array([scores.get(e, 0.0) for e in ends])

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The next states; failure links are followed by those that lack the edge."""
        out = np.zeros(len(states), np.int64)
        open_ = np.arange(len(states))
        now = states.copy()
        while len(open_):
            keys = now[open_] * self.width + symbols[open_]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            found = self.keys[at] == keys
            out[open_[found]] = self.targets[at[found]]
            stuck = open_[~found]
            open_ = stuck[now[stuck] != 0]
            now[open_] = self.fail[now[open_]]
        return out

    def solve(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Best ids of all words end to end, and how many each has."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        place = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        symbols = np.where(self.letters[place] == points, place, len(self.letters))
        begins = np.cumsum(lengths) - lengths
        by_length = np.argsort(-lengths, kind="stable")
        shorter = -lengths[by_length]
        best = np.full(len(points) + len(words), -np.inf)  # word w has its length + 1 places from begins[w] + w on
        last = np.full(len(best), -1)
        base = begins + np.arange(len(words))
        best[base] = 0.0
        states = np.zeros(len(words), np.int64)
        for j in range(int(lengths.max(initial=0))):
            live = by_length[: np.searchsorted(shorter, -j, side="left")]
            states[live] = self.step(states[live], symbols[begins[live] + j])
            here = base[live] + j + 1
            single = np.zeros(len(live), bool)
            node = np.where(self.ends[states[live]] >= 0, states[live], self.link[states[live]])
            some = np.flatnonzero(node)
            while len(some):
                at = node[some]
                score = best[here[some] - self.depth[at]] + self.scores[at]
                better = score > best[here[some]]
                best[here[some[better]]] = score[better]
                last[here[some[better]]] = at[better]
                single[some[self.depth[at] == 1]] = True
                node[some] = self.link[at]
                some = some[node[some] != 0]
            alone = np.flatnonzero(~single)
            score = best[here[alone] - 1] + self.unknown_score
            better = score > best[here[alone]]
            best[here[alone[better]]] = score[better]
            last[here[alone[better]]] = -1
        return self._walk_back(words, points, lengths, begins, base, last)

    def _walk_back(self, words, points, lengths, begins, base, last):
        """Follow the last pieces from each word's end, all words side by side."""
        place, rank = lengths.copy(), np.zeros(len(words), np.int64)
        owners, orders, ids = [], [], []
        live = np.flatnonzero(place)
        while len(live):
            at = last[base[live] + place[live]]
            known = at >= 0
            owners.append(live[known])
            orders.append(rank[live[known]])
            ids.append(self.ends[at[known]])
            rank[live[known]] += 1
            for w in live[~known]:  # rare: a character without a piece
                for b in reversed(chr(points[begins[w] + place[w] - 1]).encode("utf-8", "surrogatepass")):
                    owners.append(np.array([w]))
                    orders.append(rank[w : w + 1].copy())
                    ids.append(self.byte_ids[b : b + 1])
                    rank[w] += 1
            place[live] -= np.where(known, self.depth[np.maximum(at, 0)], 1)
            live = live[place[live] > 0]
        if not owners:
            return np.zeros(0, np.int64), rank
        owner, order, found = np.concatenate(owners), np.concatenate(orders), np.concatenate(ids)
        out = np.zeros(len(found), np.int64)
        out[np.cumsum(rank)[owner] - 1 - order] = found
        return out, rank

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts end to end, how many each has, and each text's score."""
        data, offsets = flat_bytes(column)
        marked, bounds = mark(data, offsets)
        starts = text_starts(bounds)
        if self.split:
            space = marked == 0x20
            starts = merged_places(len(marked), starts, np.flatnonzero(space[1:] & ~space[:-1]) + 1)
        ids, counts = encode_distinct(marked, starts, bounds, self.remembered)
        pieces = np.append(0.0, np.cumsum(self.piece_scores[ids]))
        upto = np.append(0, np.cumsum(counts))
        return ids, counts, pieces[upto[1:]] - pieces[upto[:-1]]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of the ids: marks become spaces, the first one goes, bytes are joined."""
        lengths = self.text_lengths[ids]
        data = gather(self.text_bytes, self.text_begins[ids], lengths)
        upto = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts))]
        raw = data.tobytes()
        return pa.array([raw[a + (raw[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(upto[:-1], upto[1:], strict=True)], pa.large_string())


def mark(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A space before each text that isn't empty (the model's first word mark)."""
    begins = text_starts(offsets)
    bounds = offsets + np.append(0, np.cumsum(np.diff(offsets) > 0))
    return np.insert(data, begins, 0x20), bounds


@functools.lru_cache(2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def int_lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts))), pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32()))


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids end to end, and how many each list has; a null list is empty."""
    counts = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return column.flatten().to_numpy(), counts


def encode(docs: DataFrame, model_path: str, text: str = "text", check: bool = False) -> DataFrame:
    """Adds piece_ids array<int> and piece_score double, and round_trip (decoding gives the text back) where ``check``."""
    place = docs.columns.index(text)
    new = {"piece_ids": T.ArrayType(T.IntegerType()), "piece_score": T.DoubleType()} | ({"round_trip": T.BooleanType()} if check else {})

    def run(batches):
        for batch in small_batches(batches, place):
            coder, column = model(model_path), batch.column(place)
            ids, counts, scores = coder.encode(column)
            found = {"piece_ids": int_lists(ids, counts), "piece_score": pa.array(scores)}
            if check:
                found["round_trip"] = pc.equal(coder.decode(ids, counts), pc.fill_null(column.cast(pa.large_string()), ""))
            yield with_columns(batch, found)

    kept = [f for f in docs.schema.fields if f.name not in new]
    return docs.mapInArrow(run, T.StructType([*kept, *(T.StructField(k, t) for k, t in new.items())]))


def decode(docs: DataFrame, model_path: str, ids: str = "piece_ids", into: str = "decoded") -> DataFrame:
    """Adds the text of the ids."""

    place = docs.columns.index(ids)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield with_columns(part, {into: model(model_path).decode(*flat_lists(part.column(place))).cast(pa.string())})

    kept = [f for f in docs.schema.fields if f.name != into]
    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(into, T.StringType())]))


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document doc_id, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit), piece_score, and whether decoding gives the text back.

    Ids stay in the task that makes them, so only a narrow row leaves it.
    """

    def run(batches):
        for batch in small_batches(batches, 1):
            coder = model(model_path)
            ids, counts, scores = coder.encode(batch.column(1))
            same = pc.equal(coder.decode(ids, counts), pc.fill_null(batch.column(1).cast(pa.large_string()), ""))
            raw, ends = ids.astype("<u4").tobytes(), 4 * np.append(0, np.cumsum(counts))
            crcs = [zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(crcs, pa.int64()), pa.array(scores), same], names=["doc_id", "n_pieces", "ids_crc32", "piece_score", "round_trip"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, piece_score double, round_trip boolean")
