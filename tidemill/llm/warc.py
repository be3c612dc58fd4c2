"""WARC derivatives: metadata and plain-text conversion records of response records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, payload_digest string, content_length long, block binary"
NAMES = [x.split()[0] for x in RECORD.split(", ")]
DATE = "2024-01-01T00:00:00Z"
#: A payload may unpack to so many bytes: half of what one value of a row can hold.
MOST_BYTES = 1 << 30
#: Packed bytes that are fed at once; they unpack to some thousand times as many at most.
_WINDOW = 1 << 14
_BLOCKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "article", "section", "header", "footer", "nav", "aside", "title", "blockquote", "pre", "form", "body", "head", "html"}
_DROPPED = {"script", "style", "noscript", "template"}
#: A comment, or a tag with its name; quoted attribute values may hold ">". Possessive, so that nothing is tried twice.
_MARKUP = re.compile(r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*+)(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+>?|<[!/?][^>]*+>?""", re.S)
_CLOSE = {t: re.compile(rf"</{t}\s*>", re.I) for t in _DROPPED}
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """The same parts give the same identifier, so that a task run again writes the same records."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def plain_text(html: str) -> str:
    """All text of a page, one line per block; one pass, in time in proportion to the page."""
    out, at, last = [], 0, {}  # last: from where on a dropped element has no end tag
    while m := _MARKUP.search(html, at):
        out.append(html[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        out.append("\n" if tag in _BLOCKS else " ")
        if tag in _DROPPED and not m[1] and last.get(tag, at + 1) > at:
            if end := _CLOSE[tag].search(html, at):
                at = end.end()
            elif tag in ("script", "style"):
                at = len(html)
            else:
                last[tag] = at
    out.append(html[at:])
    text = entities.unescape("".join(out))
    return "\n".join(x for x in (" ".join(line.split()) for line in text.split("\n")) if x)


def decoded(payload: bytes, headers: list[tuple[str, str]]) -> str:
    """Text of a payload by its headers: transfer and content coding undone as far as they are whole, then the charset
    of the Content-Type header or of a meta element near the start, UTF-8 if neither names a known one."""
    said = {k.lower(): v for k, v in headers}
    if "chunked" in said.get("transfer-encoding", "").lower():
        payload = unchunked(payload)
    for coding in reversed([c.strip() for c in said.get("content-encoding", "").lower().split(",")]):
        if coding in ("gzip", "x-gzip", "deflate"):
            payload = inflated(payload)
    named = _CHARSET.search(said.get("content-type", "").encode("latin-1", "replace")) or _CHARSET.search(payload[:2048])
    try:
        return payload.decode(named[1].decode() if named else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def unchunked(data: bytes) -> bytes:
    """Body of a chunked message; from the first malformed chunk on it is left out, a body without chunks stays."""
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        try:
            size = int(data[at:end].split(b";")[0], 16)
        except ValueError:
            break
        if size <= 0:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out) if out else data


class TooLong(ValueError):
    """Packed data that unpack to more than a record may hold."""


def _unpacked(data: bytes, wbits: int, most: int) -> bytes:
    """All members of packed data, one after another, up to where they break off; an error if nothing can be unpacked."""
    out, at, size, member = [], 0, 0, zlib.decompressobj(wbits)
    while at < len(data):
        window = data[at : at + _WINDOW]
        try:
            out.append(member.decompress(window))
        except zlib.error:
            if not size:
                raise
            break
        size += len(out[-1])
        if size > most:
            raise TooLong
        at += len(window) - len(member.unused_data)
        if member.eof:
            if data[at : at + 2] != b"\x1f\x8b":
                break
            member = zlib.decompressobj(wbits)
    return b"".join(out)


def inflated(data: bytes, most: int = MOST_BYTES) -> bytes:
    """gzip data of any number of members, zlib or raw deflate data, as far as they are whole; other data as they are.

    What unpacks to more than `most` bytes raises TooLong before more than a window's worth beyond it is held.
    """
    for wbits in (47, -15):
        try:
            return _unpacked(data, wbits, most)
        except zlib.error:
            continue
    return data


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.string()] * 8, pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 11, kinds, strict=True)], names=NAMES)


def _respond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        rows = []
        for page, url, html in zip(*(x.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
            payload = (html or "").encode("utf-8", "surrogatepass")
            block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
            own = digest(block)
            rows.append((page, "response", record_id("response", str(page), url or "", own), None, url, DATE, "application/http; msgtype=response", own, digest(payload), len(block), block))
        yield _batch(rows)


def responses(pages: DataFrame) -> DataFrame:
    """A response record of every row of pages (page_id, url, html); null html is an empty payload.

    The table has no time of capture, so every record has the fixed DATE, and records follow from the row alone.
    """
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_respond, RECORD)


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        rows = []
        for page, kind, source, _, url, date, _, block_digest, payload_digest, length, block in zip(*(x.column(c).to_pylist() for c in NAMES), strict=True):
            if kind != "response":
                continue
            block = block or b""
            head, _, payload = block.partition(b"\r\n\r\n")
            status, _, rest = head.partition(b"\r\n")
            headers = [(k.decode("latin-1"), v.decode("latin-1")) for k, v in _HEADER.findall(rest + b"\r\n")]
            try:
                text, fault = plain_text(decoded(payload, headers)).encode("utf-8", "replace"), None
            except TooLong:
                text, fault = b"", f"payload unpacks to more than {MOST_BYTES} bytes"
            said = "".join(f"{k}: {v}\r\n" for k, v in [("source-record-id", source), ("source-status", status.decode("latin-1")), *((f"source-header-{k.lower()}", v) for k, v in headers), ("source-block-digest", block_digest), ("source-payload-digest", payload_digest), ("source-content-length", str(length)), ("conversion-fault", fault)] if v is not None).encode("utf-8", "surrogatepass")
            for kind_, media, data in (("metadata", "application/warc-fields", said), ("conversion", "text/plain; charset=utf-8", text)):
                rows.append((page, kind_, record_id(kind_, source or ""), source, url, date, media, digest(data), payload_digest, len(data), data))
        yield _batch(rows)


def derivatives(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for every response record.

    Both refer to the response (refers_to), carry its URI, date and payload digest, and have a digest of
    their own block. The metadata block keeps the source's identifier, status, headers and digests; the
    conversion block is the payload's text. Other kinds of records give none. Identifiers follow from the
    content, so repeated rows have equal records. Null and empty payloads give empty conversions, malformed ones
    what can be decoded; null URIs and ids stay null. Long payloads are handled whole, one at a time; one that
    unpacks to more than MOST_BYTES has an empty conversion and a metadata field that says so. Columns
    other than a record's are ignored; an empty table gives no rows.
    """
    return records.select(*NAMES).mapInArrow(_derive, RECORD)


def warc_derivatives(pages: DataFrame) -> DataFrame:
    return derivatives(responses(pages))


def serialise(r) -> bytes:
    """One WARC/1.1 record."""
    fields = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-Refers-To", r["refers_to"]), ("WARC-Block-Digest", r["block_digest"]), ("WARC-Payload-Digest", r["payload_digest"]), ("Content-Type", r["content_type"]), ("Content-Length", len(r["block"]))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode("utf-8", "surrogatepass") + b"\r\n" + bytes(r["block"]) + b"\r\n\r\n"


def to_warc(records: DataFrame) -> DataFrame:
    """(record_id, warc): each record as a gzip member; members in any order make up a .warc.gz file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            data = [gzip.compress(serialise(r), mtime=0) for r in x.to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column("record_id"), pa.array(data, pa.binary())], names=["record_id", "warc"])

    return records.select(*NAMES).mapInArrow(run, "record_id string, warc binary")


def parse(data: bytes) -> Iterator[dict]:
    """Records of WARC bytes, gzipped by member or plain, read as a stream; a record without a valid length has an empty block."""
    raw = io.BytesIO(data)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if data[:2] == b"\x1f\x8b" else raw
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8", "surrogatepass").partition(":")
            fields[k.strip().lower()] = v.strip()
        said = fields.get("content-length", "")
        block = stream.read(int(said)) if said.isascii() and said.isdigit() else b""  # without a length, up to the next record's line
        yield {"record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "refers_to": fields.get("warc-refers-to"), "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "content_type": fields.get("content-type"), "block_digest": fields.get("warc-block-digest"), "payload_digest": fields.get("warc-payload-digest"), "content_length": len(block), "block": block}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under a path, one file a task at a time; page_id is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for data in x.column("content"):
                rows = []
                for r in parse(data.as_py()):
                    rows.append(tuple(r.get(n) for n in NAMES))
                    if len(rows) == 500:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)
