"""Token sets and multisets of a text for comparing and clipping; plain Python inside tasks."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

#: Scripts that are written without spaces.
UNSPACED = re.compile("[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿\U00020000-\U0002ebef฀-๿຀-໿က-႟ក-៿]")
JOIN = "\x1f"


def pieces(text: str) -> list[tuple[str, str]]:
    """(kind, token): words case-folded, pairs of neighbours for scripts without spaces, symbols."""
    text = unicodedata.normalize("NFC", text)
    out: list[tuple[str, str]] = []
    run: list[str] = []

    def end() -> None:
        if run:
            token = unicodedata.normalize("NFC", "".join(run)).casefold()
            if UNSPACED.search("".join(run)):
                out.extend(("cjk", x) for x in ([token] if len(token) < 2 else [a + JOIN + b for a, b in zip(token, token[1:], strict=False)]))
            else:
                out.append(("word", token))
            run.clear()

    for c in text:
        if c.isalnum() or UNSPACED.match(c):
            run.append(c)
        else:
            end()
        if not c.isalnum() and not c.isspace():
            out.append(("symbol", c.casefold()))
    end()
    if not out and text:
        out.append(("symbol", text.casefold()))
    return out


def token_set(text: str) -> set[str]:
    return {t for kind, t in pieces(text) if kind != "symbol" or not UNSPACED.match(t)}


def token_counts(text: str) -> Counter:
    return Counter(f"{kind}:{t}" for kind, t in pieces(text))


def multiset_jaccard(a: Counter, b: Counter) -> float:
    shared = sum((a & b).values())
    whole = sum(a.values()) + sum(b.values()) - shared
    return shared / whole if a and b else 0.0


def phrase_span(text: str, phrase: str) -> tuple[int, int] | None:
    """Where a phrase stands in a text, case-folded, at word boundaries unless its script has no spaces."""
    wanted = unicodedata.normalize("NFC", phrase).casefold()
    if not wanted.strip():
        return None
    folded, place = [], []
    for i, c in enumerate(text):
        for f in unicodedata.normalize("NFC", c).casefold():
            folded.append(f)
            place.append(i)
    whole = "".join(folded)
    at = whole.find(wanted)
    ends = [c for c in phrase if not c.isspace()]
    while at >= 0:
        a, b = place[at], place[at + len(wanted) - 1] + 1
        left = ends[0].isalnum() and not UNSPACED.match(ends[0]) and a > 0 and text[a - 1].isalnum()
        right = ends[-1].isalnum() and not UNSPACED.match(ends[-1]) and b < len(text) and text[b].isalnum()
        if not left and not right:
            return a, b
        at = whole.find(wanted, at + 1)
    return None
