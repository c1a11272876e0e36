"""WARC archives as a table of chunks.

Pages are written as WARC 1.1 records by Spark's text writer, whose line separator is the
blank line that ends a record. A payload of at least LEAST_REVISIT bytes that other pages
have too is written once, by the page with the smallest id; the others are revisits of it.
Who refers to whom is decided on ids and digests alone. A batch of pages keeps equal
payloads once, so one that a third of all pages have moves once per batch.

A payload of more than CHUNK_BYTES is written as a segmented record: one response and
continuations, cut in one pass from the page's bytes between two characters, so no row
that is written or read has more than a chunk of it.

Archives are read back as a stream: pieces between blank lines arrive in file order, a
small parser tells headers from content by Content-Length, and content leaves in pieces
as it came, as rows of record identifier and chunk number. The records' digests are carried
along these rows from chunk to chunk. Neither side holds a record. Files are compressed as
a whole, so a file is read by one task from its beginning; there are as many as there were
partitions.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tripmill.llm import common

CHUNK_BYTES = 128 * 1024
LEAST_REVISIT = 100
# Bytes of content that leave together.
TOGETHER = 1 << 20
# The format's line ends and the time given to records without one.
LINE, BLANK = "\r\n", "\r\n\r\n"
NO_DATE = "1970-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK" + LINE + "Content-Type: text/html; charset=utf-8"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_LEAN = "page_id long, url string, payload binary, payload_bytes long, digest string, refers_to long, is_page boolean"


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5('/'.join(map(str, parts)).encode()).digest())}>"


def _lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages of a batch, without the payloads of those that are revisits of another
    page of it."""
    for batch in batches:
        ids = batch.column("page_id").to_pylist()
        contents = [value.as_buffer() if value.is_valid else b"" for value in batch.column("html")]
        digests = [hashlib.sha256(content).hexdigest() for content in contents]
        first: dict[str, int] = {}
        for page_id, digest in zip(ids, digests):
            if page_id is not None:
                first[digest] = min(first.get(digest, page_id), page_id)
        needed = [
            len(content) < LEAST_REVISIT or first.get(digest, page_id) == page_id
            for page_id, digest, content in zip(ids, digests, contents)
        ]
        whole = batch.column("html").cast(pa.binary()).fill_null(b"")
        n = len(ids)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"), batch.column("url"), pc.if_else(pa.array(needed, pa.bool_()), whole, pa.scalar(None, pa.binary())),
                pa.array([len(content) for content in contents], pa.int64()), pa.array(digests, pa.string()), pa.nulls(n, pa.int64()), pa.array([True] * n),
            ],
            ["page_id", "url", "payload", "payload_bytes", "digest", "refers_to", "is_page"],
        )


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that are revisits. Digests are summed up
    before they meet, and only those that several pages have are joined back."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.octet_length("html").alias("size"),
        F.sha2(F.col("html").cast("binary"), 256).alias("digest"),
    ).where(F.col("size") >= LEAST_REVISIT)
    rows = common.cut(rows.select("page_id", "digest"))
    first = rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    several = rows.distinct().join(first.drop("n"), "digest")
    return several.where(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull()).select(
        "page_id", "digest", "refers_to"
    )


def segments(payload: pa.Buffer, size: int) -> Iterator[pa.Buffer]:
    """The payload in slices of at most size bytes (4 at least), cut between characters."""
    view, begin = memoryview(payload), 0
    while True:
        end = min(begin + size, len(view))
        while end < len(view) and view[end] & 0xC0 == 0x80:
            end -= 1
        yield payload[begin:end]
        begin = end
        if begin == len(view):
            return


def _header(fields: dict[str, object]) -> bytes:
    lines = ["WARC/1.1", *(f"{name}: {value}" for name, value in fields.items() if value is not None)]
    return (LINE.join(lines) + BLANK).encode()


def _records(
    page_id: int | None, copy: int, url: str | None, payload: pa.Buffer, whole: int, digest: str, refers_to: int | None, size: int
) -> Iterator[bytes]:
    """The records of a page with a payload of `whole` bytes, without the blank line that
    ends each. A revisit needs no payload."""
    origin = record_id("page", page_id, digest, copy)
    common_fields = {"WARC-Date": NO_DATE, "WARC-Target-URI": url}
    of_page = {"WARC-Payload-Digest": f"sha256:{digest}", "X-Page-ID": page_id}
    if refers_to is not None:
        yield _header({
            "WARC-Type": "revisit", "WARC-Record-ID": origin, **common_fields, **of_page,
            "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id("page", refers_to, digest, 0),
            "X-Refers-To-Page-ID": refers_to, "X-Payload-Bytes": whole, "Content-Length": 0,
        })
        return
    head = (HTTP + BLANK).encode()
    segmented = len(payload) > size
    for number, part in enumerate(segments(payload, size)):
        content = head + part.to_pybytes() if number == 0 else part.to_pybytes()
        done = (number == 0 and not segmented) or part.address + part.size == payload.address + payload.size
        if number == 0:
            fields = {"WARC-Type": "response", "WARC-Record-ID": origin, **common_fields, **of_page}
            fields |= {"Content-Type": "application/http; msgtype=response", "X-Payload-Bytes": whole}
        else:
            fields = {"WARC-Type": "continuation", "WARC-Record-ID": record_id(origin, number), **common_fields}
            fields["WARC-Segment-Origin-ID"] = origin
        if segmented:
            fields["WARC-Segment-Number"] = number + 1
            fields["WARC-Segment-Total-Length"] = len(payload) + len(head) if done else None
        yield _header(fields | {"Content-Length": len(content)}) + content


def _write(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of pages that come sorted by id and digest, each kind of page after the row
    that tells whom it refers to, if any."""
    key, refers_to, copy = None, None, 0
    held: list[bytes] = []
    waiting = 0
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("page_id", "digest", "refers_to", "is_page", "url", "payload_bytes")]
        payload = batch.column("payload")
        for at, (page_id, digest, other, is_page, url, whole) in enumerate(zip(*columns)):
            if (page_id, digest) != key:
                key, refers_to, copy = (page_id, digest), None, 0
            if not is_page:
                refers_to = other
                continue
            if refers_to is None and not payload[at].is_valid:
                raise ValueError(f"the payload of page {page_id} is missing")
            content = payload[at].as_buffer() if payload[at].is_valid else pa.py_buffer(b"")
            for record in _records(page_id, copy, url, content, whole, digest, refers_to, size):
                held.append(record)
                waiting += len(record)
                if waiting >= TOGETHER:
                    yield _values(held)
                    held, waiting = [], 0
            copy += 1
    yield _values(held)


def _values(records_: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(records_, pa.binary()).cast(pa.string())], ["value"])


def write(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Writes a record per row of pages (page_id, url, html) to new archives at path.

    A null html is an empty payload, a null url leaves the target out, a null page_id is
    written as none. Rows that repeat a page_id with the same payload are records of their
    own, all responses if it is the smallest. Other columns are not read; no rows give no
    record."""
    lean = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.col("url").cast("string"), r"\s", "%20").alias("url"),
        "html",
    ).mapInArrow(_lean, _LEAN)
    decided = revisits(pages).select(
        "page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"),
        F.lit(None).cast("long").alias("payload_bytes"), "digest", "refers_to", F.lit(False).alias("is_page"),
    )
    (
        lean.unionByName(decided)
        .repartition("page_id", "digest")
        .sortWithinPartitions("page_id", "digest", "is_page")
        .mapInArrow(partial(_write, max(4, chunk_bytes)), "value string")
        .write.option("lineSep", BLANK)
        .option("compression", "gzip")
        .text(path)
    )


class Piece(NamedTuple):
    """A stretch of a record's content; `last` of the record's last segment only."""

    fields: dict[str, str]
    content: bytes
    first: bool
    last: bool


def parse(blocks: Iterator[bytes]) -> Iterator[Piece]:
    """Pieces of the records in what stands between blank lines. The fields are those of
    the record that a continuation continues. A block may end inside a line end that
    belongs to the content, so bytes are counted and not blocks."""
    blank = BLANK.encode()
    fields: dict[str, str] = {}
    own: dict[str, str] = {}
    buffer = b""
    left = -1  # bytes of content to come; -1: a header is next
    first = True
    for block in blocks:
        buffer += block + blank
        while buffer:
            if left < 0:
                buffer = buffer.lstrip(b"\r\n")
                header, found, rest = buffer.partition(blank)
                if not found:
                    break
                lines = header.decode("utf-8").split(LINE)
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no WARC record begins with {lines[0][:40]!r}")
                own = dict(line.split(": ", 1) for line in lines[1:])
                first = own["WARC-Type"] != "continuation"
                fields = own if first else fields
                left, buffer = int(own["Content-Length"]), rest
                if not first and own["WARC-Segment-Origin-ID"] != fields.get("WARC-Record-ID"):
                    raise ValueError("a continuation without the record before it")
            else:
                content, buffer = buffer[:left], buffer[left:]
                left -= len(content)
                ends = left == 0 and ("WARC-Segment-Number" not in own or "WARC-Segment-Total-Length" in own)
                yield Piece(fields, content, first, ends)
                first = False
            if left == 0:
                if not own["Content-Length"].strip("0"):
                    yield Piece(fields, b"", first, True)
                left = -1
    if left > 0:
        raise ValueError("an archive ends within a record")


def payloads(pieces: Iterator[Piece]) -> Iterator[Piece]:
    """The same without the HTTP header of responses, which may come in pieces itself."""
    blank, head, inside = BLANK.encode(), b"", False
    for piece in pieces:
        if piece.first:
            head, inside = b"", piece.fields["WARC-Type"] != "response"
        content = piece.content
        if not inside:
            head, found, content = (head + content).partition(blank)
            inside = bool(found)
        if content or piece.first or piece.last:
            yield piece._replace(content=content)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        for value in batch.column("value").cast(pa.binary()):
            yield value.as_py()


def _page(fields: dict[str, str], name: str) -> int | None:
    return int(fields[name]) if name in fields else None


_CHUNKS = (
    "record_id string, page_id long, chunk long, content binary, is_last boolean, record_type string, "
    "payload_digest string, payload_bytes long, refers_to long"
)
_CHUNK_KINDS = (
    pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64()
)


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, waiting = 0, 0
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        columns = list(zip(*held)) or [()] * len(_CHUNK_KINDS)
        names = [field.split()[0] for field in _CHUNKS.split(", ")]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _CHUNK_KINDS)], names)

    for piece in payloads(parse(_blocks(batches))):
        number = 0 if piece.first else number + 1
        fields = piece.fields
        held.append((
            fields["WARC-Record-ID"], _page(fields, "X-Page-ID"), number, piece.content, piece.last, fields["WARC-Type"],
            fields["WARC-Payload-Digest"].removeprefix("sha256:"), _page(fields, "X-Payload-Bytes"),
            _page(fields, "X-Refers-To-Page-ID"),
        ))
        waiting += len(piece.content) + 200
        if waiting >= TOGETHER:
            yield out()
            waiting = 0
    yield out()


def _record_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per record of chunk rows in the order of the archive, digests carried along."""
    digest, size = hashlib.sha256(), 0
    for batch in batches:
        rows = []
        names = ("record_id", "page_id", "chunk", "is_last", "record_type", "payload_digest", "payload_bytes", "refers_to")
        columns = (batch.column(name).to_pylist() for name in names)
        for (record, page_id, chunk, is_last, kind, stored, full, refers_to), content in zip(zip(*columns), batch.column("content")):
            if chunk == 0:
                digest, size = hashlib.sha256(), 0
            digest.update(content.as_buffer())
            size += len(content.as_buffer())
            if is_last:
                if kind == "response" and (digest.hexdigest(), size) != (stored, full):
                    raise ValueError(f"the payload of {record} is damaged")
                rows.append((page_id, full, stored, kind, refers_to, chunk + 1))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
        columns = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "chunks"],
        )


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, page_id, chunk, content, is_last, record_type, payload_digest,
    payload_bytes, refers_to) of all records' payloads, in pieces: the pieces of a record
    in the order of their chunk numbers are its payload, and (record_id, chunk) is a key."""
    return spark.read.option("lineSep", BLANK).text(path).mapInArrow(_chunk_rows, _CHUNKS)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, chunks) of every
    record, from its chunks. Digest and size of a response are those of the bytes read,
    compared with what the record says; a revisit has those of the payload it refers to."""
    # Chunks come from a task in the order of its archive.
    return read_chunks(spark, path).mapInArrow(
        _record_rows,
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, chunks long",
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages to archives in the shared folder, reads the records back and removes
    the archives."""
    spark = pages.sparkSession
    path = f"{common.shared_folder(spark)}/warc-{uuid.uuid4()}"
    try:
        write(pages, path)
        # Ids, digests and sizes.
        return common.cut(read_records(spark, path))
    finally:
        common.remove_folder(spark, path)
