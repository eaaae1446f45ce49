"""Web archives in Zstandard: one frame for each record, the dictionary in a leading skippable frame.

Writing: a payload's first page (the smallest page_id) is a response with the payload,
other pages with an equal payload are revisits of it. Archives are whole .warc.zst files
of bounded size, kept as binary rows of a Parquet table in the shared folder, so they
reach any store that Spark writes to. Reading takes any table with a binary column
`content`, such as that one or what Spark's binaryFile source gives for real files (a
file is one cell, so at most 2 GB); it loads the dictionary, decodes frame by frame, and
checks headers, lengths and digests.

Records of every type are read. Pages are known by fields that only this writer puts in;
records without them have no page_id, a revisit's size and reference may be unknown, and
`fields` holds what the headers say. Digests are checked where they are given in SHA-1.

Defined results: a null payload is an empty one; rows that repeat the smallest page_id of
a payload are all responses; pages without an id are revisits if the payload has a page
with one, else responses; an empty table gives no rows; other columns are ignored,
whatever their names. Payloads under MIN_BYTES are always responses. What breaks the
format raises BadArchive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from kithgraph.llm import shared

MIN_BYTES = 0
#: Bytes of payload after which an archive is closed.
ARCHIVE_BYTES = 4 << 20
#: Pages on which the dictionary is trained, and its size.
DICTIONARY_SAMPLE, DICTIONARY_BYTES = 300, 16 << 10
#: Of the skippable frame with the dictionary, and of frames. Fixed values.
_SKIPPABLE, _FRAME = 0x184D2A5D, 0xFD2FB528
#: Bytes of a frame that are read first.
_CHUNK = 1 << 12


COLUMNS = ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "fields")


class BadArchive(ValueError):
    """An archive that breaks the format."""


def digest_of(payload: bytes) -> str:
    """Base32 SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page: str | None, url: str, digest: str, size: int, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC/1.1 record. Revisits have no payload but name the digest and size of theirs."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {kind} {digest}')}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
        ("X-Payload-Length", str(size)),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page is not None:
        fields.insert(6, ("X-Page-ID", page))
    if refers_to is not None:
        fields[4:4] = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To",
            f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to} response {digest}')}>"), ("X-Refers-To-Page-ID", refers_to)]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    """One record: its type, headers (names in lower case) and payload.

    The payload is the entity body of an HTTP message, else the block; a revisit has none.
    """

    kind: str
    fields: dict[str, str]
    payload: bytes | None

    def number(self, name: str) -> int | None:
        return _number(self.fields, name)


def _number(fields: dict[str, str], name: str) -> int | None:
    value = fields.get(name)
    if value is None:
        return None
    if not (value.isascii() and value.isdigit()):
        raise BadArchive(f"{name} is no number: {value[:60]}")
    return int(value)


def _check_digest(fields: dict[str, str], name: str, body: bytes) -> None:
    algorithm, _, digest = fields.get(name, "").partition(":")
    if algorithm.lower() not in ("sha1", "sha-1"):
        return  # optional, and other algorithms may be used
    if len(digest) == 40:  # hexadecimal digits are in use too
        found = hashlib.sha1(body).hexdigest()
        digest = digest.lower()
    else:
        found, digest = digest_of(body), digest.upper()
    if digest != found:
        raise BadArchive(f"{name} isn't that of the record")


def parsed(body: bytes) -> Record:
    """A record from its bytes; raises BadArchive."""
    head, found, rest = body.partition(b"\r\n\r\n")
    try:
        lines = head.decode("utf-8").split("\r\n")
    except UnicodeDecodeError as e:
        raise BadArchive("the header is not UTF-8") from e
    if not found or not lines[0].startswith(("WARC/0.", "WARC/1.")):
        raise BadArchive("no WARC header")
    fields: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:  # a field may go on in the next line
            fields[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise BadArchive(f"no field: {line[:60]}")
        if name in fields and name != "warc-concurrent-to":
            raise BadArchive(f"{name} stands twice")
        fields[name] = value.strip()
    for k in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if k not in fields:
            raise BadArchive(f"no {k}")
    size = _number(fields, "content-length")
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise BadArchive("the block's length isn't the header's")
    block, kind = rest[:size], fields["warc-type"].lower()
    _check_digest(fields, "warc-block-digest", block)
    if kind == "revisit":
        return Record(kind, fields, None)
    payload = block
    if fields.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
        http, found, payload = block.partition(b"\r\n\r\n")
        if not found:
            raise BadArchive("no HTTP header")
        if kind == "response" and not http.startswith(b"HTTP/"):
            raise BadArchive("no HTTP status")
    _check_digest(fields, "warc-payload-digest", payload)
    if _number(fields, "x-payload-length") not in (None, len(payload)):
        raise BadArchive("the payload's length isn't the header's")
    return Record(kind, fields, payload)


def archive(records: list[bytes], dictionary: bytes) -> bytes:
    """A whole .warc.zst file."""
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    pack = zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=True, write_checksum=True)
    stored = zstandard.ZstdCompressor(level=9).compress(dictionary) if dictionary else b""
    return (struct.pack("<II", _SKIPPABLE, len(stored)) + stored if dictionary else b"") + b"".join(map(pack.compress, records))


def frames(content: bytes) -> Iterator[bytes]:
    """The records of a .warc.zst file, one decoded frame each."""
    view, at = memoryview(content), 0
    plain = zstandard.ZstdDecompressor()
    reader = plain
    while at < len(view):
        if len(view) - at < 8:
            raise BadArchive("the file ends inside a frame")
        magic, size = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 + size > len(view):
                raise BadArchive("the file ends inside a skippable frame")
            if magic == _SKIPPABLE and at == 0:
                reader = _with_dictionary(plain, bytes(view[8 : 8 + size]))
            at += 8 + size
        elif magic == _FRAME:
            # Chunks that grow with the frame: what is read beyond its end stays in proportion.
            one, found, chunk = reader.decompressobj(), [], _CHUNK
            while not one.eof:
                if at >= len(view):
                    raise BadArchive("the file ends inside a frame")
                try:
                    found.append(one.decompress(view[at : at + chunk]))
                except zstandard.ZstdError as e:
                    raise BadArchive(str(e)) from e
                at = min(len(view), at + chunk)
                chunk = min(2 * chunk, 1 << 20)
            at -= len(one.unused_data)
            yield b"".join(found)
        else:
            raise BadArchive("neither a frame nor a skippable frame")


def _with_dictionary(plain: zstandard.ZstdDecompressor, body: bytes) -> zstandard.ZstdDecompressor:
    """A decompressor with a dictionary, which may itself be a frame."""
    try:
        if body[:4] == struct.pack("<I", _FRAME):
            one = plain.decompressobj()
            body = one.decompress(body)
            if not one.eof:
                raise BadArchive("the dictionary's frame has no end")
        return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body)) if body else plain
    except zstandard.ZstdError as e:
        raise BadArchive(f"the dictionary can't be read: {e}") from e


def dictionary_of(pages: DataFrame, sample: int = DICTIONARY_SAMPLE, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary trained on the pages with the smallest hashes; empty if they are too few or too much alike."""
    stretch = F.substring("html", 1, 20_000)  # what the dictionary is trained on, not what is stored
    some = shared.thinned(pages.where("html <> ''"), "page_id", sample)
    found = [r[0].encode() for r in some.orderBy(F.xxhash64("page_id"), "page_id").limit(sample).select(stretch).collect()]
    try:
        return zstandard.train_dictionary(size, found).as_bytes() if len(found) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) and return the staged table of archives (content)."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    digest = F.sha1(body)
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), body.alias("payload"), digest.alias("digest"), F.length(body)
        .alias("n"))
    first = rows.where(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.min("page_id").alias("first_id"), F.count("*").alias("pages"))
    # Only payloads of several pages are joined; all other rows pass by.
    shared_by = shared.staged(first.where("pages > 1").drop("pages"), "warc-shared")
    told = rows.join(shared_by, ["digest", "n"], "left")
    known = dictionary_of(pages)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[bytes] = []
        held = 0
        for batch in batches:
            for page, url, payload, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                payload = payload.as_py()
                page, first = page.as_py(), refers_to.as_py()
                records.append(record("response" if first is None else "revisit", page, url.as_py(), digest_of(payload), len(payload),
                    payload, first))
                held += len(records[-1])
                if held >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([archive(records, known)], pa.binary())], names=["content"])
                    records, held = [], 0
        if records:
            yield pa.RecordBatch.from_arrays([pa.array([archive(records, known)], pa.binary())], names=["content"])

    other = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    flagged = told.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", F.when(other, F.col("first_id"))
        .cast("string").alias("refers_to"))
    return shared.staged(flagged.mapInArrow(write, "content binary"), "warc")


def read_archives(archives: DataFrame, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """page_id, url, record_type, refers_to (as text), payload_bytes, payload_digest, payload and fields of every record, or some of them.

    refers_to is the page of a revisit's response, else the record that it names. Size
    and digest of a revisit's payload are what its headers say.
    """

    def row(r: Record) -> dict[str, object]:
        f = r.fields
        if r.payload is None:
            size, digest = r.number("x-payload-length"), f.get("warc-payload-digest", "").partition(":")[2] or None
        else:
            size, digest = len(r.payload), digest_of(r.payload)
        refers_to = f.get("x-refers-to-page-id", f.get("warc-refers-to"))
        return {"page_id": f.get("x-page-id"), "url": f.get("warc-target-uri"), "record_type": r.kind, "refers_to": refers_to,
            "payload_bytes": size, "payload_digest": digest, "payload": r.payload, "fields": list(f.items())}

    def batch_of(rows: list[dict[str, object]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in columns], names=list(columns))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for body in frames(content.as_buffer() if content.is_valid else b""):
                    rows.append(row(parsed(body)))
                    held += len(body)
                    if held >= ARCHIVE_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary(), "fields": pa.map_(pa.string(), pa.string())}
    kinds = {c: kinds.get(c, pa.string()) for c in COLUMNS}
    return archives.select("content").mapInArrow(read, StructType([StructField(c, from_arrow_type(kinds[c])) for c in columns]))
