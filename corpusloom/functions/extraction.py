"""Entities and relationships from the text that an extractor model returns; plain Python inside tasks."""

from __future__ import annotations

import json
import re

NAMES, KINDS = ("name", "entity", "text", "label"), ("type", "entity_type", "category")
FENCED = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL | re.IGNORECASE)


def payload(text: str) -> str:
    """What a model said without fences and talk around the JSON."""
    m = FENCED.search(text)
    body = m[1] if m else text
    starts = [i for i in (body.find("{"), body.find("[")) if i >= 0]
    return body[min(starts) :].strip() if starts else body.strip()


def balanced(text: str) -> str:
    """The first whole JSON value of a text; one that breaks off is closed after its last whole item."""
    stack, quoted, escaped, kept = [], False, False, text
    for i, c in enumerate(text):
        if quoted:
            escaped, quoted = c == "\\" and not escaped, c != '"' or escaped
            continue
        if c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
            kept = text[: i + 1] + "".join(reversed(stack))
            if not stack:
                break
    return kept


def first_of(item: dict, keys: tuple[str, ...]) -> str | None:
    return next((str(item[k]).strip() for k in keys if isinstance(item.get(k), str | int | float) and str(item[k]).strip()), None)


def parse(text: str) -> tuple[list[tuple[str, str | None]], list[tuple[str, str, str]]]:
    """(name, type) of entities and (source, target, type) of relationships; what can't be read is left out."""
    try:
        found = json.loads(balanced(payload(text)))
    except ValueError:
        return [], []
    if isinstance(found, dict) and not isinstance(found.get("entities"), list | dict):
        found = {"entities": found.get("entities") or [found]}
    items = found.get("entities", []) if isinstance(found, dict) else found
    if isinstance(items, dict):
        items = [{"name": k, "type": v} if isinstance(v, str) else {"name": k} for k, v in items.items()]
    entities: dict[str, tuple[str, str | None]] = {}
    for item in items:
        name, kind = (item.strip(), None) if isinstance(item, str) else (first_of(item, NAMES), first_of(item, KINDS)) if isinstance(item, dict) else (None, None)
        if name:
            entities.setdefault(name.lower(), (name, kind))
    links = found.get("relationships", []) if isinstance(found, dict) else []
    triples = [(first_of(x, ("source", "from")), first_of(x, ("target", "to")), first_of(x, ("relationship_type", "type", "relation")) or "related_to") for x in links if isinstance(x, dict)]
    return list(entities.values()), [t for t in triples if t[0] and t[1]]
