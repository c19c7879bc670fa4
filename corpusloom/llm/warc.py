"""WARC archives: writing captures and assembling them again.

Every page becomes three records: a response (or a revisit of an equal payload), the
request and a metadata record, which name the first as their WARC-Concurrent-To. Records
are gzip members of their own, so a reader can start at any of them. After reading, records
are brought together by that identifier and each capture is one nested row. Other
writers' archives may chain the identifiers (metadata to request to response), name several
of them in a record, leave records out or repeat them: a capture is what is connected.

An archive counts only when its name is in the manifest, which Spark commits; files of
lost or repeated task attempts are never read.

Defined results: a null html is an empty payload; a null url gives no target URI; pages of
one page_id and payload are captures of their own; of records with equal payloads of at
least ``least_bytes`` bytes, the one with the smallest page_id is the response (a null
page_id comes last, and all rows of that page_id are responses); a very long payload is
written and read whole, a record being in memory at a time; other columns, whatever their
names, are ignored; an empty table gives an empty result. In assembly a missing record
leaves a null in its place, and of several of a kind (repeated ones, too) that of the
smallest record id counts, a response before a resource before a revisit.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow_text import open_folder
from corpusloom.llm.components import components
from corpusloom.llm.shared import join_counted, materialize, scratch, text_or_empty

MANIFEST_SCHEMA = "path string, captures long, bytes long"
RECORD_SCHEMA = (
    "record_id string, concurrent array<string>, record_type string, target_uri string, payload_digest string, "
    "payload_bytes long, payload binary, fields map<string,string>"
)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def with_references(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, and for revisits the page_id and url of the response.

    Groups are found on narrow rows (digests), and only repeated payloads are joined back.
    """
    payload = text_or_empty("html")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("sha"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    groups = keyed.filter(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    groups = groups.filter("n > 1").select("sha", "n", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    groups = materialize(groups, scratch(pages.sparkSession, "warc-groups"))
    narrow = join_counted(keyed.select("page_id", "sha"), groups, "sha", "n", pages.count()).filter(~F.col("page_id").eqNullSafe(F.col("first_id")))
    revisits = narrow.select(F.col("page_id").alias("of_id"), F.col("sha").alias("of_sha"), "first_id", "first_url").distinct()
    joined = keyed.join(revisits, F.col("page_id").eqNullSafe(F.col("of_id")) & (F.col("sha") == F.col("of_sha")), "left")
    return joined.select("page_id", "url", "payload", F.col("of_sha").isNotNull().alias("revisit"), "first_id", "first_url")


def header_safe(text: str) -> str:
    """A header value: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


class ArchiveWriter:
    """One archive file of gzip members."""

    def __init__(self, folder: str) -> None:
        system, root = open_folder(folder)
        system.create_dir(root, recursive=True)
        self.space = uuid.uuid4()
        self.path = f"{folder}/{self.space.hex}.warc.gz"
        self.out = system.open_output_stream(f"{root}/{self.space.hex}.warc.gz", compression=None)
        self.captures = self.bytes = self.records = 0
        self.record("warcinfo", {"Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")

    def record(self, kind: str, headers: dict[str, str], block: bytes) -> str:
        number = f"<urn:uuid:{uuid.uuid5(self.space, str(self.records))}>"
        self.records += 1
        lines = {"WARC-Type": kind, "WARC-Record-ID": number, "WARC-Date": DATE} | headers | {"Content-Length": str(len(block))}
        head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n"
        member = gzip.compress(head.encode() + block + b"\r\n\r\n", 4, mtime=0)
        self.out.write(member)
        self.bytes += len(member)
        return number

    def capture(self, page_id: int | None, url: str | None, payload: bytes, revisit: bool, first_id: int | None, first_url: str | None) -> None:
        uri = {} if url is None else {"WARC-Target-URI": header_safe(url)}
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        headers = uri | {"WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}", "Content-Type": "application/http; msgtype=response"}
        fields = {"page-id": page_id}
        if revisit:
            headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To-Date": DATE} | ({} if first_url is None else {"WARC-Refers-To-Target-URI": header_safe(first_url)})
            fields["refers-to-page-id"] = first_id
        number = self.record("revisit" if revisit else "response", headers, http if revisit else http + payload)
        of = uri | {"WARC-Concurrent-To": number}
        self.record("request", of | {"Content-Type": "application/http; msgtype=request"}, b"GET / HTTP/1.1\r\n\r\n")
        body = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
        self.record("metadata", of | {"Content-Type": "application/warc-fields"}, body.encode())
        self.captures += 1


def write_archives(captures: DataFrame, folder: str) -> DataFrame:
    """One archive a partition; returns the manifest: path, captures, bytes."""

    def write(batches):
        archive = None
        for batch in batches:
            columns = [batch.column(i) for i in range(6)]
            for row in range(batch.num_rows):  # one payload at a time is a Python object
                archive = archive or ArchiveWriter(folder)
                page_id, url, payload, revisit, first_id, first_url = (c[row].as_py() for c in columns)
                archive.capture(page_id, url, payload.encode(), revisit, first_id, first_url)
        if archive:
            archive.out.close()
            yield pa.RecordBatch.from_pydict({"path": [archive.path], "captures": [archive.captures], "bytes": [archive.bytes]})

    return materialize(captures.mapInArrow(write, MANIFEST_SCHEMA), f"{folder}/manifest")


def fields_of(lines: bytes) -> list[tuple[str, str]]:
    """Names in lower case and values of header lines, in order; a line that begins with white space goes on with the last value."""
    out: list[tuple[str, str]] = []
    for line in lines.decode("utf-8", "replace").splitlines():
        name, sign, value = line.partition(":")
        if line[:1] in {" ", "\t"} and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif sign:
            out.append((name.strip().lower(), value.strip()))
    return out


def archive_records(stream: io.BufferedIOBase) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of each record; one record is held at a time."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not re.fullmatch(rb"WARC/\d+\.\d+", line.strip()):
            raise ValueError(f"not the start of a WARC record: {line[:40]!r}")
        head = []
        while (line := stream.readline()).strip():
            head.append(line)
        headers = fields_of(b"".join(head))
        named = dict(headers)
        length = int(named["content-length"])
        block = stream.read(length)
        if len(block) < length or stream.read(4).strip(b"\r\n"):
            raise ValueError(f"record {named.get('warc-record-id')} doesn't end where its length says")
        yield headers, block


def plain_or_gzip(path: str) -> io.BufferedIOBase:
    system, root = open_folder(path)
    with system.open_input_stream(root, compression=None) as start:
        packed = start.read(2) == b"\x1f\x8b"
    stream = system.open_input_stream(root, compression=None)
    return gzip.open(stream) if packed else io.BufferedReader(stream)


def record_row(headers: list[tuple[str, str]], block: bytes, payloads: bool) -> tuple:
    """A record as a row; digests and lengths are taken from the payload where the record has one."""
    named = dict(headers)
    kind = named["warc-type"].lower()
    http, _, body = block.partition(b"\r\n\r\n")
    if kind == "resource":
        body = block
    real = kind in {"response", "resource"}
    claimed = dict(fields_of(http)).get("content-length", "") if kind == "revisit" else ""
    length = len(body) if real else int(claimed) if claimed.isdigit() else None
    digest = sha1_base32(body) if real else named.get("warc-payload-digest", "").removeprefix("sha1:") or None
    fields: dict[str, str] = {}
    for name, value in fields_of(block) if kind == "metadata" else []:
        fields[name] = f"{fields[name]}\n{value}" if name in fields else value
    concurrent = [value for name, value in headers if name == "warc-concurrent-to"]
    return named["warc-record-id"], concurrent, kind, named.get("warc-target-uri"), digest, length, body if real and payloads else None, list(fields.items())


def read_records(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """All records but warcinfo of the archives, plain or gzip, that column ``path`` names."""
    kinds = [pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.map_(pa.string(), pa.string())]
    names = ["record_id", "concurrent", "record_type", "target_uri", "payload_digest", "payload_bytes", "payload", "fields"]

    def as_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with plain_or_gzip(path) as stream:
                    for headers, block in archive_records(stream):
                        if ("warc-type", "warcinfo") in headers:
                            continue
                        rows.append(record_row(headers, block, payloads))
                        held += len(block)
                        if held > 16_000_000 or len(rows) == 10_000:
                            yield as_batch(rows)
                            rows, held = [], 0
                if rows:
                    yield as_batch(rows)

    return archives.select("path").repartition(max(1, archives.count()), "path").mapInArrow(read, RECORD_SCHEMA)


def with_captures(records: DataFrame) -> DataFrame:
    """The records, written to the shared folder, with the identifier of what each is connected to as ``capture``.

    Where no record that names others is named itself, and none names several, the named
    record is the capture; else the captures are the connected components of the
    identifiers.
    """
    records = materialize(records, scratch(records.sparkSession, "warc-records"))
    edges = records.select(F.col("record_id").alias("a"), F.explode("concurrent").alias("b")).filter("a <> b")
    roles = edges.select(F.col("a").alias("id"), F.lit(1).alias("names"), F.lit(0).alias("named")).unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("names"), F.lit(1).alias("named")))
    several = records.filter(F.size(F.array_distinct("concurrent")) > 1)
    repeated = edges.distinct().groupBy("a").count().filter("count > 1")  # by records that share an id
    mixed = roles.groupBy("id").agg(F.max("names").alias("names"), F.max("named").alias("named")).filter("names = 1 and named = 1")
    if several.isEmpty() and mixed.isEmpty() and repeated.isEmpty():
        return records.withColumn("capture", F.coalesce(F.get("concurrent", F.lit(0)), "record_id"))
    found = components(edges).select(F.col("node").alias("record_id"), F.col("component").alias("capture"))
    return records.join(found, "record_id", "left").withColumn("capture", F.coalesce("capture", "record_id"))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: response (or resource or revisit), request and metadata, joined by WARC-Concurrent-To."""
    kind = F.col("record_type")
    order = F.struct(F.array_position(F.array(*map(F.lit, ("response", "resource", "revisit"))), kind).alias("at"), F.col("record_id"))

    def first(of: Column, *kinds: str) -> Column:
        return F.min_by(of, F.when(kind.isin(*kinds), order))

    return with_captures(records).groupBy("capture").agg(
        first(F.struct("record_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "payload"), "response", "resource", "revisit").alias("response"),
        first(F.struct("record_id", "target_uri"), "request").alias("request"),
        first(F.struct("record_id", "fields"), "metadata").alias("metadata"),
        F.count("*").alias("n_records"),
    )


def through_archives(pages: DataFrame, least_bytes: int = 0, payloads: bool = False) -> DataFrame:
    """Write the pages, read the archives, assemble: nested captures."""
    manifest = write_archives(with_references(pages, least_bytes), scratch(pages.sparkSession, "warc"))
    return assemble(read_records(manifest, payloads))
