"""Context packing: diverse, budgeted snippets of a query's ranked hits.

A query has at most a few hundred hits, so each query is one small group; the greedy
choice inside it is sequential by nature. Budgets count UTF-8 bytes unless another counter
is given.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.lexical import UNSPACED, multiset_jaccard, phrase_span, token_counts, token_set

PACK_SCHEMA = (
    "query_id string, id string, citation int, reason string, snippet string, truncated boolean, relevance double, novelty double, "
    "selection double, tokens long, rendered_tokens long"
)
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")


def utf8_bytes(text: str) -> int:
    return len(text.encode())


@dataclass(frozen=True)
class Packing:
    chunks: int = 8
    total: int = 1200
    per_chunk: int = 180
    novelty: float = 0.25
    least_relevance: float = 0.0
    near_duplicate: float = 0.85
    count: Callable[[str], int] = utf8_bytes


def render(chunks: list[dict]) -> str:
    """The prompt block of the chosen chunks."""
    if not chunks:
        return ""
    body = "".join(f"[C{i}] [{c['hit_type']}] {c['title'] or '(untitled)'}\n{c['snippet']}\n\n" for i, c in enumerate(chunks, 1))
    return f"<context>\n{body}</context>"


def fence_of(line: str) -> tuple[str, int] | None:
    m = FENCE.match(line.rstrip("\r\n"))
    return None if not m or m[1][0] == "`" and "`" in m[2] else (m[1][0], len(m[1]))


def closes(line: str, fence: tuple[str, int]) -> bool:
    m = FENCE.match(line.rstrip("\r\n"))
    return bool(m) and m[1][0] == fence[0] and len(m[1]) >= fence[1] and not m[2].strip()


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences and lines; a fenced block is one span."""
    out, at, open_at, fence = [], 0, 0, None
    for line in re.findall(r"[^\n]*\n|[^\n]+$", text):
        if fence:
            if closes(line, fence):
                out.append((open_at, at + len(line)))
                fence = None
        elif found := fence_of(line):
            fence, open_at = found, at
        else:
            out += [(at + m.start(), at + m.end()) for m in re.finditer(r"[^.!?]*[.!?]|[^.!?]+$", line) if m[0].strip()]
        at += len(line)
    if fence:
        out.append((open_at, len(text)))
    return out or [(0, len(text))]


def without_lone_fences(text: str) -> str:
    """Fence lines that have no partner go."""
    lines = text.split("\n")
    lone, fence = set(), None
    for i, line in enumerate(lines):
        if fence is None:
            if found := fence_of(line):
                fence = (i, found)
                lone.add(i)
        elif closes(line, fence[1]):
            lone.discard(fence[0])
            fence = None
    return "\n".join(x for i, x in enumerate(lines) if i not in lone)


def window(segment: str, a: int, b: int) -> str:
    body = without_lone_fences(segment[a:b].strip())
    return ("… " if a > 0 else "") + body + (" …" if b < len(segment) else "")


def term_span(segment: str, terms: set[str]) -> tuple[int, int] | None:
    """The first word or pair of characters of the segment that is a query term."""
    for m in re.finditer(r"\w+", segment):
        if UNSPACED.search(m[0]):
            for i in range(m.start(), m.end() - 1):
                if f"{segment[i]}\x1f{segment[i + 1]}".casefold() in terms:
                    return i, i + 2
        elif m[0].casefold() in terms:
            return m.span()
    return None


def clip_characters(segment: str, a: int, b: int, most: int, count: Callable[[str], int]) -> str:
    """Grow a range character by character, to both sides, while it fits."""
    while b > a + 1 and count(window(segment, a, b)) > most:
        middle = (a + b) // 2
        a, b = middle, middle + 1
    if count(window(segment, a, b)) > most:
        return ""
    while True:
        wider = [r for r in ((a - 1, b), (a, b + 1)) if r[0] >= 0 and r[1] <= len(segment) and count(window(segment, *r)) <= most]
        if not wider:
            return window(segment, a, b)
        a, b = max(wider, key=lambda r: r[1] - r[0])


def clip_around(segment: str, query: str, terms: set[str], most: int, count: Callable[[str], int]) -> str:
    """A window on the best match of a span that is too long, grown by words where it has any."""
    phrase = phrase_span(segment, query)
    spot = phrase or term_span(segment, terms)
    middle = len(segment) // 2
    if not re.search(r"\s", segment) or phrase and (UNSPACED.search(segment[slice(*phrase)]) or count(window(segment, *phrase)) > most):
        return clip_characters(segment, *(spot or (middle, middle + 1)), most, count)
    words = [m.span() for m in re.finditer(r"\S+", segment)]
    a, b = phrase or (spot[0] if spot else middle,) * 2
    first = max((i for i, w in enumerate(words) if w[0] <= a), default=0)
    last = min((i for i, w in enumerate(words) if w[1] >= max(b, a + 1)), default=len(words) - 1)
    best = ""
    while count(text := window(segment, words[first][0], words[last][1])) <= most:
        best = text
        if first == 0 and last == len(words) - 1:
            break
        first, last = max(0, first - 1), min(len(words) - 1, last + 1)
    return best or clip_characters(segment, *(spot or (middle, middle + 1)), most, count)


def clip(text: str, query: str, most: int, count: Callable[[str], int]) -> tuple[str, bool]:
    """The snippet of a text within a budget, and whether it was cut.

    The sentence that shares most terms with the query (a whole phrase counts above all)
    grows by its neighbours, the smaller result first.
    """
    text = text.strip()
    if not text or most <= 0:
        return "", False
    if count(text) <= most:
        return text, False
    spans, terms = sentences(text), token_set(query)
    worth = [max(1, len(query)) if phrase_span(text[a:b], query) else len(terms & token_set(text[a:b])) for a, b in spans]
    lo = hi = max(range(len(spans)), key=lambda i: (worth[i], -i))

    def body(i: int, j: int) -> str:
        return text[spans[i][0] : spans[j][1]].strip()

    if count(body(lo, hi)) > most:
        return clip_around(text[slice(*spans[lo])], query, terms, most, count), True
    while True:
        sides = [(count(body(*r)), side, r) for side, r in enumerate([(lo - 1, hi), (lo, hi + 1)]) if r[0] >= 0 and r[1] < len(spans)]
        sides = [s for s in sides if s[0] <= most]
        if not sides:
            return without_lone_fences(body(lo, hi)), True
        lo, hi = min(sides)[2]


class Waiting:
    """Hits that may still be chosen, the one of the highest worth first.

    A hit's worth only falls as more hits are chosen, so the worth known from earlier
    comparisons is an upper bound: only the hit on top is compared with what was chosen
    since, and hits that never get there are neither compared nor split into tokens.
    """

    def __init__(self, hits: list[dict], weight: float) -> None:
        self.weight = weight
        self.hits = [h | {"closest": 0.0, "compared": 0} for h in hits]
        self.heap = [(-self.worth(h), h["rank"], i) for i, h in enumerate(self.hits)]
        heapq.heapify(self.heap)
        self.counts: dict[str, Counter] = {}

    def worth(self, hit: dict) -> float:
        return (1 - self.weight) * hit["relevance"] + self.weight * (1 - hit["closest"])

    def tokens(self, hit: dict) -> Counter:
        if hit["id"] not in self.counts:
            self.counts[hit["id"]] = token_counts(hit["content"])
        return self.counts[hit["id"]]

    def best(self, chosen: list[dict]) -> dict | None:
        """Take the hit of the highest worth, ties by rank, given all that was chosen."""
        while self.heap:
            _, rank, i = heapq.heappop(self.heap)
            hit = self.hits[i]
            if hit["compared"] == len(chosen):
                return hit
            new = [multiset_jaccard(self.tokens(hit), self.tokens(c)) for c in chosen[hit["compared"] :]]
            hit.update(closest=max(hit["closest"], *new), compared=len(chosen))
            heapq.heappush(self.heap, (-self.worth(hit), rank, i))
        return None

    def rest(self) -> list[dict]:
        return [self.hits[i] for _, _, i in sorted(self.heap, key=lambda x: x[1])]


def pack_query(hits: list[dict], query: str, how: Packing) -> list[dict]:
    """Choices and exclusions of one query's hits, which come in rank order."""
    out: list[dict] = []

    def leave(hit: dict, reason: str, **more) -> None:
        out.append({"id": hit["id"], "reason": reason, "relevance": hit.get("relevance"), **more})

    if not (how.chunks and how.total and how.per_chunk):
        for hit in hits:
            leave(hit, "token_budget" if how.chunks else "diagnostic_limit")
        return out
    waiting, seen = [], set()
    for rank, hit in enumerate(hits):
        if not hit["content"].strip():
            leave(hit, "empty_content")
        elif hit["id"] in seen:
            leave(hit, "duplicate")
        else:
            seen.add(hit["id"])
            waiting.append(hit | {"rank": rank})
    low, high = min((h["score"] for h in waiting), default=0), max((h["score"] for h in waiting), default=0)
    for h in waiting:
        h["relevance"] = (h["score"] - low) / (high - low) if high - low > 1.2e-7 else 1.0
    for h in [h for h in waiting if h["relevance"] < how.least_relevance]:
        leave(h, "relevance_threshold")
    waiting = [h for h in waiting if h["relevance"] >= how.least_relevance]
    chosen: list[dict] = []
    pool = Waiting(waiting, min(max(how.novelty, 0.0), 1.0))
    while len(chosen) < how.chunks and (best := pool.best(chosen)):
        novelty = 1 - best["closest"]
        if chosen and best["closest"] >= how.near_duplicate:
            leave(best, "near_duplicate", novelty=novelty)
            continue
        snippet, cut = fit(best, query, chosen, how)
        if not snippet:
            leave(best, "token_budget", novelty=novelty)
            continue
        before = how.count(render(chosen))
        chosen.append(best | {"snippet": snippet})
        out.append({"id": best["id"], "citation": len(chosen), "reason": "selected", "snippet": snippet, "truncated": cut, "relevance": best["relevance"], "novelty": novelty,
                    "selection": pool.worth(best), "tokens": how.count(snippet), "rendered_tokens": how.count(render(chosen)) - before})
    for h in pool.rest():
        leave(h, "diagnostic_limit")
    return out


def fit(hit: dict, query: str, chosen: list[dict], how: Packing) -> tuple[str, bool]:
    """The longest snippet within both budgets, headers counted."""
    fixed = how.count(render([*chosen, hit | {"snippet": ""}]))
    cap = min(how.per_chunk, how.total - fixed)
    while cap > 0:
        snippet, cut = clip(hit["content"], query, cap, how.count)
        if not snippet:
            break
        whole = how.count(render([*chosen, hit | {"snippet": snippet}]))
        if whole <= how.total:
            return snippet, cut
        smaller = min(cap, how.total - (whole - how.count(snippet)))
        if smaller >= cap:
            break
        cap = smaller
    return "", False


def pack(hits: DataFrame, how: Packing = Packing()) -> DataFrame:
    """``hits``: query_id, query, rank, id, hit_type, title, content, score."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "id"])
        rows = pack_query(pdf[["id", "hit_type", "title", "content", "score"]].to_dict("records"), pdf["query"].iloc[0], how)
        names = [x.split(" ")[0] for x in PACK_SCHEMA.split(", ")]
        out = pd.DataFrame(rows, columns=names, dtype=object)  # a column may have no value at all
        out["query_id"] = pdf["query_id"].iloc[0]
        return out.astype({"citation": "Int32", "tokens": "Int64", "rendered_tokens": "Int64", "truncated": "boolean"})

    return hits.groupBy("query_id").applyInPandas(run, PACK_SCHEMA)


def prompts(packed: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id and the prompt block of its chosen chunks."""
    heads = hits.select("query_id", "id", "hit_type", F.coalesce("title", F.lit("(untitled)")).alias("title"))
    chosen = packed.filter("reason = 'selected'").join(heads, ["query_id", "id"])
    part = F.concat(F.lit("[C"), F.col("citation").cast("string"), F.lit("] ["), "hit_type", F.lit("] "), "title", F.lit("\n"), "snippet", F.lit("\n\n"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("citation", part.alias("part")))), lambda x: x["part"]), "")
    return chosen.groupBy("query_id").agg(F.concat(F.lit("<context>\n"), body, F.lit("</context>")).alias("prompt"))


def diagnostics(packed: DataFrame) -> DataFrame:
    """Counts of reasons, and tokens of snippets and headers, per query."""
    reasons = ("selected", "duplicate", "near_duplicate", "relevance_threshold", "token_budget", "empty_content", "diagnostic_limit")
    return packed.groupBy("query_id").agg(
        *[F.count_if(F.col("reason") == r).alias(r) for r in reasons], F.sum("tokens").alias("snippet_tokens"), (F.sum("rendered_tokens") - F.sum("tokens")).alias("header_tokens")
    )
