"""Structure-aware Markdown chunks, paragraph chunks, and the alignment of two generations."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.storage import written

CHUNK_SCHEMA = (
    "source_identity string, key string, location_key string, ordinal int, heading_path array<string>, start_line int, end_line int, "
    "start_byte int, end_byte int, overlap_from string, overlap_chars int, content_hash string, content string, search_text string, split_fenced_code boolean"
)
ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t\r\f]+(.*?))?(?:(?<=[ \t])#+)?\s*$")
SETEXT = re.compile(r"^ {0,3}(?:(=+)|-+)\s*$")
RULE = re.compile(r"^ {0,3}([-_*])(?:\s*\1){2,}\s*$")
FENCE = re.compile(r"^ {0,3}(?:(`{3,})[^`]*|(~{3,}).*)$")
QUOTE = re.compile(r"^\s*>")
ITEM = re.compile(r"^\s*(?:[-*+]|[0-9]+\.)[ \t\r\f]")
INDENT = re.compile(r"^(?:  |\t)")


@dataclass(frozen=True)
class Sizes:
    """Sizes in characters."""

    least: int = 50
    target: int = 700
    most: int = 1000
    overlap: int = 100


@dataclass
class Piece:
    """A stretch of the source with its headings; ``gap`` is the source between it and the last one."""

    start: int
    end: int
    headings: list[str] = field(default_factory=list)
    gap: str = ""
    fresh: bool = False
    kind: str = "prose"
    cut_fence: bool = False


def kind_of(line: str) -> str:
    """What a line starts."""
    if not line.strip():
        return "blank"
    for name, pattern in (("heading", ATX), ("rule", RULE), ("fence", FENCE), ("quote", QUOTE), ("list", ITEM)):
        if pattern.match(line):
            return name
    return "prose"


def blocks(text: str) -> tuple[list[Piece], list[str]]:
    """Content blocks in order, and the headings that hold at the end."""
    ends = [m.end() for m in re.finditer(r"[^\n]*\n|[^\n]+$", text)]
    starts = [0, *ends[:-1]][: len(ends)]
    lines = [text[a:b].rstrip("\n").rstrip("\r") for a, b in zip(starts, ends, strict=True)]
    kinds = [kind_of(x) for x in lines]
    out: list[Piece] = []
    headings: list[str] = []
    fresh, i = False, 0

    def under(level: int, title: str) -> None:
        headings[:] = (headings + [""] * level)[: level - 1] + [title]

    while i < len(lines):
        kind, first = kinds[i], i
        if kind == "blank":
            i += 1
            continue
        if kind == "heading":
            m = ATX.match(lines[i])
            under(len(m[1]), (m[2] or "").strip())
            fresh, i = True, i + 1
            continue
        if kind == "prose" and not lines[i].startswith(("\t", "    ")):
            j = i + 1
            while j < len(lines) and kinds[j] == "prose" and not SETEXT.match(lines[j]) and not lines[j].startswith(("\t", "    ")):
                j += 1
            if j < len(lines) and (m := SETEXT.match(lines[j])):
                under(1 if m[1] else 2, "\n".join(x.strip() for x in lines[i:j]))
                fresh, i = True, j + 1
                continue
        if kind == "rule":
            fresh, i = True, i + 1
            continue
        i += 1
        if kind == "fence":
            m = FENCE.match(lines[first])
            mark = m[1] or m[2]
            close = re.compile(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}\s*$")
            while i < len(lines) and not close.match(lines[i]):
                i += 1
            i = min(i + 1, len(lines))
        elif kind == "quote":
            while i < len(lines) and kinds[i] in ("quote", "blank"):
                i += 1
        elif kind == "list":
            while i < len(lines):
                more = ITEM.match(lines[i]) or INDENT.match(lines[i]) and lines[i].strip()
                if not more and kinds[i] == "blank":
                    more = i + 1 < len(lines) and (ITEM.match(lines[i + 1]) or INDENT.match(lines[i + 1]))
                if not more:
                    break
                i += 1
        else:
            while i < len(lines) and kinds[i] == "prose":
                i += 1
        raw = text[starts[first] : ends[i - 1]]
        if raw.strip():
            start = starts[first] + len(raw) - len(raw.lstrip())
            end = starts[first] + len(raw.rstrip())
            out.append(Piece(start, end, headings.copy(), text[out[-1].end : start] if out else "", fresh, kind))
            fresh = False
    return out, headings


def parts(text: str, block: Piece, most: int) -> Iterator[Piece]:
    """A block within the size, or cut: prose after a sentence, then after white space; fences anywhere."""
    at = block.start
    while at < block.end:
        end = min(block.end, at + most)
        if end < block.end and block.kind != "fence":
            body = text[at:end]
            after = text[end : end + 1]
            stops = [m.end() for m in re.finditer(r"[.!?](?=\s|$)", body) if m.end() < len(body) or not after or after.isspace()] if block.kind == "prose" else []
            spaces = [m.end() for m in re.finditer(r"\s", body)] if not stops else []
            end = at + (stops or spaces or [len(body)])[-1]
        whole = at == block.start and end == block.end
        yield Piece(at, end, block.headings, block.gap if at == block.start else "", block.fresh and at == block.start, block.kind, block.kind == "fence" and not whole)
        at = end


def chunk(identity: str, text: str, sizes: Sizes = Sizes()) -> Iterator[dict]:
    """Chunks of one text: blocks under one heading joined up to the target, with the last chunk's tail before each."""
    found, headings = blocks(text)
    if not found and text.strip():
        start = len(text) - len(text.lstrip())
        found = [Piece(start, len(text.rstrip()), headings)]
    drafts: list[Piece] = []
    open_: Piece | None = None
    for block in found:
        for part in parts(text, block, sizes.most):
            if open_ and (part.fresh or part.headings != open_.headings):
                drafts.append(open_)
                open_ = None
            size = len(part.gap) + part.end - part.start + (open_.end - open_.start if open_ else 0)
            if open_ and size > sizes.target and (open_.end - open_.start >= sizes.least or size > sizes.most):
                drafts.append(open_)
                open_ = None
            if open_:
                open_ = Piece(open_.start, part.end, open_.headings, open_.gap, open_.fresh, open_.kind, open_.cut_fence or part.cut_fence)
            else:
                open_ = part
            if open_.end - open_.start >= sizes.target:
                drafts.append(open_)
                open_ = None
    if open_:
        drafts.append(open_)
    last_key, last = None, ""
    for n, d in enumerate(x for x in drafts if text[x.start : x.end].strip()):
        content, over, tail = text[d.start : d.end], None, last[-sizes.overlap :] if sizes.overlap else ""
        if tail and len(tail) + 2 + len(content) <= sizes.most:
            content, over = f"{tail}\n\n{content}", last_key
        path = " > ".join(h for h in d.headings if h)
        location = digest(identity, "\x1f".join(d.headings), str(n))
        content_hash = digest(content.replace("\r\n", "\n").strip())
        last_key, last = digest(identity, location, content_hash), content
        before = text[: d.start]
        yield {
            "source_identity": identity, "key": last_key, "location_key": location, "ordinal": n, "heading_path": d.headings,
            "start_line": 1 + before.count("\n"), "end_line": 1 + text[: d.end].count("\n"), "start_byte": len(before.encode()), "end_byte": len(text[: d.end].encode()),
            "overlap_from": over, "overlap_chars": len(tail) if over else 0, "content_hash": content_hash, "content": content,
            "search_text": f"{path}\n\n{content}" if path else content, "split_fenced_code": d.cut_fence,
        }


def digest(*fields: str) -> str:
    return hashlib.sha256("\0".join(fields).encode()).hexdigest()


def markdown_chunks(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """``docs``: source_identity, markdown. A row per chunk; each text is one small Python step."""

    def run(batches):
        for pdf in batches:
            rows = [c for identity, text in zip(pdf["source_identity"], pdf["markdown"], strict=True) for c in chunk(identity, text or "", sizes)]
            yield pd.DataFrame(rows, columns=[x.split(" ")[0] for x in CHUNK_SCHEMA.split(", ")])

    return docs.select("source_identity", "markdown").mapInPandas(run, CHUNK_SCHEMA)


def paragraph_chunks(text: Column, least: int, most: int) -> Column:
    """Paragraphs of at least ``least`` characters, long ones cut so that no tail is shorter than that."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: (p != "") & (F.char_length(p) >= least))

    def cuts(p: Column) -> Column:
        n = F.char_length(p)
        whole = F.ceil(n / most).cast("int")
        rest = n - (whole - 1) * most
        short = (whole > 1) & (rest < least) & F.lit(least <= most)
        begin = lambda i: F.when(short & (i == whole - 1), n - least).otherwise(i * most)
        return F.transform(F.sequence(F.lit(0), whole - 1), lambda i: F.substring(p, begin(i) + 1, F.when(i == whole - 1, n).otherwise(begin(i + 1)) - begin(i)))

    return F.flatten(F.transform(paragraphs, cuts))


#: Ordinals of a bucket: places and running values of a source are put together from those of its buckets.
BUCKET = 4096


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Adds the place (from 0) of each row in its source by ordinal; no task sees more than a bucket of a source."""
    rows = rows.withColumn("__b", F.floor(F.col("ordinal") / BUCKET))
    counts = rows.groupBy("source_id", "__b").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("source_id").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("source_id", "__b", before.alias("__before"))
    own = F.row_number().over(Window.partitionBy("source_id", "__b").orderBy("ordinal")) - 1
    return rows.withColumn("__own", own).join(counts, ["source_id", "__b"]).withColumn(name, (F.col("__before") + F.col("__own")).cast("int")).drop("__b", "__own", "__before")


def rising(pairs: DataFrame) -> DataFrame:
    """The pairs (source_id, i, j) whose j is above those of all smaller i of the source."""
    rows = pairs.withColumn("__b", F.floor(F.col("i") / BUCKET))
    most = rows.groupBy("source_id", "__b").agg(F.max("j").alias("__m"))
    earlier = Window.orderBy("__b").partitionBy("source_id").rowsBetween(Window.unboundedPreceding, -1)
    most = most.select("source_id", "__b", F.coalesce(F.max("__m").over(earlier), F.lit(-1)).alias("__before"))
    own = F.coalesce(F.max("j").over(Window.partitionBy("source_id", "__b").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    return rows.withColumn("__own", own).join(most, ["source_id", "__b"]).filter(F.col("j") > F.greatest("__own", "__before")).select("source_id", "i", "j")


def aligned_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """source_id, old_ordinal, new_ordinal, exact_content of chunks that follow one another.

    ``old`` and ``new``: source_id, ordinal (once in a source), heading_path, content.
    Anchors (headings and content, as hashes) that are as frequent on both sides pair off
    in order if their order is the same; else only single ones that keep rising do. A lone
    changed chunk between two pairs under the same headings is the successor of the one it
    replaced.
    """

    def side(rows: DataFrame, place: str) -> DataFrame:
        heading = F.sha2(F.to_json(F.struct(F.coalesce("heading_path", F.array().cast("array<string>")).alias("h"))), 256)
        hashed = rows.select("source_id", "ordinal", heading.alias("heading"), F.sha2(F.concat_ws("\0", heading, F.sha2("content", 256)), 256).alias("anchor"))
        return numbered(hashed, place)

    a, b = written(side(old, "i"), "chunks-old"), written(side(new, "j"), "chunks-new")  # narrow rows, read several times
    marked = a.select("source_id", "anchor", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select("source_id", "anchor", F.lit(0).alias("x"), F.lit(1).alias("y")))
    alike = marked.groupBy("source_id", "anchor").agg(F.sum("x").alias("n"), F.sum("y").alias("m")).filter("n = m").drop("m")
    left, right = (written(numbered(x.join(alike, ["source_id", "anchor"]), "k"), "chunks-alike") for x in (a, b))
    lined = left.select("source_id", "k", "i", F.col("anchor").alias("one"), F.col("heading")).join(right.select("source_id", "k", "j", F.col("anchor").alias("two")), ["source_id", "k"])
    ordered = lined.groupBy("source_id").agg(F.every(F.col("one") == F.col("two")).alias("ordered"))
    in_line = lined.join(ordered.filter("ordered"), "source_id", "left_semi").select("source_id", "i", "j")
    single = left.filter("n = 1").select("source_id", "anchor", "i").join(right.filter("n = 1").select("source_id", "anchor", "j"), ["source_id", "anchor"])
    exact = written(in_line.unionByName(rising(single.join(ordered.filter("not ordered"), "source_id", "left_semi"))), "chunks-exact")
    first = exact.select("source_id", F.col("i").alias("i1"), F.col("j").alias("j1"))
    third = exact.select("source_id", (F.col("i") - 2).alias("i1"), (F.col("j") - 2).alias("j1"))
    between = exact.select("source_id", (F.col("i") - 1).alias("i1"))
    gaps = first.join(third, ["source_id", "i1", "j1"]).join(between, ["source_id", "i1"], "left_anti")
    headings = [(x.select("source_id", (F.col(place) - step).alias(f"{place}1"), F.col("heading").alias(f"h{n}")), f"{place}1") for n, (x, place, step) in enumerate(((a, "i", 0), (a, "i", 1), (a, "i", 2), (b, "j", 1)))]
    for rows, place in headings:
        gaps = gaps.join(rows, ["source_id", place])
    changed = gaps.filter("h0 = h1 and h1 = h2 and h2 = h3").select("source_id", (F.col("i1") + 1).alias("i"), (F.col("j1") + 1).alias("j"), F.lit(False).alias("exact_content"))
    both = exact.withColumn("exact_content", F.lit(True)).unionByName(changed)
    both = both.join(a.select("source_id", "i", F.col("ordinal").alias("old_ordinal")), ["source_id", "i"]).join(b.select("source_id", "j", F.col("ordinal").alias("new_ordinal")), ["source_id", "j"])
    return both.select("source_id", "old_ordinal", "new_ordinal", "exact_content")


def recovered_headings(old: DataFrame, staged: DataFrame) -> DataFrame:
    """``old`` with the heading paths of chunks that were stored without any (no chunk_key, no headings).

    Such a chunk takes the headings of the only staged chunk of its source with its
    content; one that finds none takes those that its two neighbours share.
    """
    legacy = F.col("chunk_key").isNull() & (F.coalesce(F.size("heading_path"), F.lit(0)) <= 0)
    content = staged.select("source_id", F.sha2("content", 256).alias("__c"), F.col("heading_path").alias("__h"))
    only = content.groupBy("source_id", "__c").agg(F.count("*").alias("__n"), F.first("__h").alias("__h")).filter("__n = 1").drop("__n")
    rows = old.withColumn("__c", F.sha2("content", 256)).join(only, ["source_id", "__c"], "left").drop("__c")
    rows = numbered(rows.withColumn("__found", F.when(legacy, F.coalesce("__h", F.array().cast("array<string>"))).otherwise(F.col("heading_path"))).withColumn("__legacy", legacy).drop("__h"), "__at")
    beside = [rows.select("source_id", (F.col("__at") - step).alias("__at"), F.col("__found").alias(f"__n{n}")) for n, step in enumerate((-1, 1))]
    rows = rows.join(beside[0], ["source_id", "__at"], "left").join(beside[1], ["source_id", "__at"], "left")
    shared = F.col("__legacy") & (F.size("__found") <= 0) & (F.size("__n0") > 0) & (F.col("__n0") == F.col("__n1"))
    return rows.withColumn("heading_path", F.when(shared, F.col("__n0")).otherwise(F.col("__found"))).select(*old.columns)


def reused_vectors(alignment: DataFrame, old_vectors: DataFrame, new: DataFrame) -> DataFrame:
    """New chunks with the vectors of their exact matches; a null vector is still to be embedded.

    ``old_vectors``: source_id, ordinal, embedding; ``new``: source_id, ordinal and more.
    """
    exact = alignment.filter("exact_content").select("source_id", F.col("old_ordinal").alias("__old"), F.col("new_ordinal").alias("ordinal"))
    held = old_vectors.select("source_id", F.col("ordinal").alias("__old"), "embedding")
    return new.join(exact.join(held, ["source_id", "__old"]).drop("__old"), ["source_id", "ordinal"], "left")


def duplicated_anchors(chunks: DataFrame) -> DataFrame:
    """Adds how often a chunk's anchor comes in its source, and which occurrence it is."""
    same = Window.partitionBy("source_id", "heading_path", "content")
    return chunks.withColumns({"times": F.count("*").over(same), "occurrence": F.row_number().over(same.orderBy("ordinal"))})
