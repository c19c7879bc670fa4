"""Scalar text rules of the note and entity model, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that never start an entity prefix search.
PREFIX_STOP_WORDS = (
    "a an and are as at be by can changed change could did does for from had has have how in is it of on or recent "
    "show tell that the this to was what when where which who why will with would you"
).split()
TRUNCATION_MARK = "\n\n[truncated]"


def canonicalize(text: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def lexical(text: Column) -> Column:
    """Canonical form with everything but letters and numbers as spaces."""
    return F.trim(F.regexp_replace(canonicalize(text), r"[^\p{L}\p{N}]+", " "))


def prefix_terms(text: Column) -> Column:
    """Terms of four characters or more that aren't stop words."""
    stop = F.array(*[F.lit(w) for w in PREFIX_STOP_WORDS])
    return F.filter(F.split(lexical(text), " "), lambda w: (F.char_length(w) >= 4) & ~F.array_contains(stop, w))


def unified_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n|\r", "\n")


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(unified_lines(text), 256))


def slugify(text: Column) -> Column:
    """ASCII letters and digits in lower case, other runs as one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def heuristic_title(text: Column, words: int = 5, characters: int = 48) -> Column:
    """The first words of the first line that isn't blank."""
    line = F.get(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), F.lit(0))
    return F.substring(F.array_join(F.slice(F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " "), 1, words), " "), 1, characters)


def truncate_for_extraction(text: Column, most: int) -> Column:
    """The first characters and a mark; 0 turns it off."""
    if not most:
        return text
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit(TRUNCATION_MARK))).otherwise(text)


def truncate_at_word(text: Column, most: int) -> Column:
    """Cut at the last white space among the first characters (else after them), with dots."""
    cut = F.substring(text, 1, most)
    whole = F.regexp_extract(cut, r"(?s)^(.*)\s\S*$", 1)
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.when(whole != "", whole).otherwise(cut), F.lit("...")))


def search_content(content: Column, headings: Column) -> Column:
    """Heading path and content: what full-text search reads by default."""
    path = F.array_join(F.filter(F.coalesce(headings, F.array().cast("array<string>")), lambda h: h != ""), " > ")
    return F.when(path == "", content).otherwise(F.concat(path, F.lit("\n\n"), content))


def updated_search_content(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """Search text after an edit: custom text stays, derived text follows content and headings.

    ``old`` and ``new`` have content, headings and search.
    """
    derived = search_content(old["content"], old["headings"])
    existing = F.coalesce(old["search"], derived)
    changed = ~old["content"].eqNullSafe(new["content"]) | ~old["headings"].eqNullSafe(new["headings"])
    return (
        F.when(new["search"].isNotNull() & (new["search"] != existing), new["search"])
        .when(changed & (existing == derived), search_content(new["content"], new["headings"]))
        .otherwise(existing)
    )


def record_table(record: Column) -> Column:
    return F.split_part(record, F.lit(":"), F.lit(1))


def record_key(record: Column) -> Column:
    return F.regexp_replace(record, "^[^:]*:", "")


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def edge_ends(kind: Column, from_id: Column, to_id: Column) -> tuple[Column, Column]:
    """Ends of an edge as stored: those of related_to are in order."""
    swap = (kind == "related_to") & (from_id > to_id)
    return F.when(swap, to_id).otherwise(from_id), F.when(swap, from_id).otherwise(to_id)


def dedupe_key(kind: Column, from_id: Column, to_id: Column) -> Column:
    return F.concat_ws(":", kind, *edge_ends(kind, from_id, to_id))


def entity_type(label: Column) -> Column:
    """Extractor labels as entity types; an unknown label, or none, is a concept."""
    name = F.lower(label)
    return (
        F.when(name.isin("person", "per"), "person")
        .when(name.isin("organization", "org"), "organization")
        .when(name.isin("location", "loc", "gpe"), "location")
        .when(name.isin("date", "time"), "date")
        .otherwise("concept")
    )


def message_key(uuid: Column, conversation: Column, index: Column) -> Column:
    return F.coalesce(F.nullif(uuid, F.lit("")), F.concat_ws(":", conversation, index.cast("string")))


def file_uri_path(uri: Column) -> Column:
    return F.url_decode(F.regexp_replace(F.regexp_replace(uri, "^file://", ""), r"\+", "%2B"))


def is_local_path(text: Column) -> Column:
    """Absolute paths of this machine: what an export leaves out."""
    return text.rlike(r"^(file://|/|~/|[A-Za-z]:[\\/]|\\\\)")


def redacted_endpoint(url: Column) -> Column:
    """Scheme, host and port; user data, path and query go."""
    return F.concat(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/?#]+)", 1))
