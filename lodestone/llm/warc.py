"""Operator 7: WARC derivatives. Response records become linked metadata and plain-text conversion records.

``responses`` writes pages as WARC/1.1 response records; ``derive`` reads records of any origin, checks their digests and gives
for each response two records that point back to it by WARC-Refers-To: one of metadata (title, language, outlinks) and one
of type conversion with the page's text. They keep the target URI, date and source digests of the response and carry
block digests of their own; the metadata record also holds every WARC and HTTP header of the response. Chunked, gzip and
deflate bodies are decoded. Record ids are UUIDs named by what the record is made from, so a repeated run, or a task run
twice, gives the same ids. Nothing is shuffled: each record is derived by itself, and ``write_files`` lets tasks commit whole files.

Results for odd input: null url counts as empty, null html as an empty page; a record that can't be read, or is no response,
gives no derivative and an ``error``, as do bodies that are damaged, in another encoding or larger than LARGEST when
unpacked; a response without an id is named by its content; a digest that doesn't fit is reported in ``digest_ok``; repeated rows give equal records;
an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:lodestone:warc")

#: Where content that is no text may begin: comments and elements.
_SPECIAL = re.compile(r"<!--|<(script|style|noscript|template|svg)\b[^>]*>", re.I)
_CLOSE = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in ("script", "style", "noscript", "template", "svg", "title")}
_BREAK = re.compile(r"<\s*+(?:/\s*+)?(?:p|br|div|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|aside|blockquote|pre|title|hr|dd|dt|dl|form|main)\b[^>]*>", re.I)
_TAG = re.compile(r"<[^>]*>")
_TITLE = re.compile(r"<title\b[^>]*>", re.I)
_HTML = re.compile(r"<html\b[^>]*>", re.I)
_A = re.compile(r"<a\b[^>]*>", re.I)
_BLANK = re.compile(r"[ \t\r\f\v\u00a0]+")
_LINES = re.compile(r" ?\n[ \n]*")
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
#: Bytes that a compressed body may grow to; a longer one is an error of its record.
LARGEST = 1 << 28


def digest(data: bytes) -> str:
    """A labelled digest as WARC writes it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """A record id named by its parts."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(31).join(parts))}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record of the given headers, with its length, and the block."""
    clean = lambda v: v.replace("\r", " ").replace("\n", " ")  # noqa: E731  a header is one line
    head = "".join(f"{k}: {clean(v)}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


class Headers(dict):
    """Headers by their lower-case names, those that are repeated joined by commas; ``all`` lists every one as it stands."""

    def __init__(self, lines: list[str]):
        super().__init__()
        self.all: list[tuple[str, str]] = []
        for line in lines:
            if line[:1] in (" ", "\t") and self.all:  # a folded line goes on with the one before
                self.all[-1] = (self.all[-1][0], f"{self.all[-1][1]} {line.strip()}".strip())
            elif ":" in line:
                name, _, value = line.partition(":")
                self.all.append((name.strip().lower(), value.strip()))
        for name, value in self.all:
            self[name] = f"{self[name]}, {value}" if name in self else value

    def first(self, name: str, default: str = "") -> str:
        """The first of a repeated header."""
        return next((v for k, v in self.all if k == name), default)


def unpacked(data: bytes, bits: int) -> bytes:
    """All members of compressed data, at most ``LARGEST`` bytes. Zeros may stand behind the last one, nothing else."""
    out, size = [], 0
    while True:
        unpack = zlib.decompressobj(bits)
        out.append(unpack.decompress(data, LARGEST - size + 1))
        size += len(out[-1])
        if not unpack.eof or size > LARGEST:
            raise ValueError("a compressed body is cut off or too long")
        data = unpack.unused_data.lstrip(b"\0")
        if not data:
            return b"".join(out)
        if data[:2] != b"\x1f\x8b":
            raise ValueError("something follows a compressed body")


def parse(data: bytes) -> tuple[Headers, bytes]:
    """Headers and block of a record, gzipped or not."""
    if data[:2] == b"\x1f\x8b":
        data = unpacked(data, zlib.MAX_WBITS | 16)
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.\d+", lines[0]):
        raise ValueError("not a WARC record")
    headers = Headers(lines[1:])
    size = int(headers.first("content-length"))
    if size < 0 or len(rest) < size:
        raise ValueError("the record is cut off")
    return headers, rest[:size]


def response(url: str | None, page: str | None, date: str = DATE) -> bytes:
    """A response record of a page."""
    body = (page or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body
    found = digest(body)
    return record(
        [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", url or "", date, found)), ("WARC-Date", date), ("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", found), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")],
        block,
    )


def unchunked(body: bytes) -> bytes:
    """A body without its chunk sizes."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        if size < 0 or end + 2 + size > len(body):
            raise ValueError("a chunk is cut off")
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def payload(http: dict[str, str], body: bytes) -> tuple[bytes, bytes]:
    """The body without transfer encoding, and that without content encoding."""
    entity = unchunked(body) if "chunked" in http.get("transfer-encoding", "").lower() else body
    page = entity
    for kind in reversed([x.strip().lower() for x in http.get("content-encoding", "").split(",") if x.strip()]):
        if kind in ("gzip", "x-gzip", "deflate"):
            page = unpacked(page, zlib.MAX_WBITS | 32 if kind != "deflate" or page[:1] == b"\x78" else -zlib.MAX_WBITS)
        elif kind != "identity":
            raise ValueError(f"content encoding {kind}")
    return entity, page


def without_specials(page: str, end: int) -> str:
    """The page up to ``end`` without comments, scripts and the like. What is never closed stays, and its end is looked for once."""
    out, at, missing = [], 0, set()
    for m in _SPECIAL.finditer(page, 0, end):
        kind = (m[1] or "").lower()
        if m.start() < at or kind in missing:
            continue
        if kind:
            close = _CLOSE[kind].search(page, m.end(), end)
            stop = close.end() if close else -1
        else:
            stop = page.find("-->", m.end(), end) + 3
        if stop < m.end():
            missing.add(kind)
            continue
        out += [page[at : m.start()], " "]
        at = stop
    return "".join([*out, page[at:end]])


def without_tags(text: str) -> str:
    """The text without tags; a "<" behind the last ">" begins none, and is not tried."""
    end = text.rfind(">") + 1
    return _TAG.sub("", text[:end]) + text[end:]


def scanned(page: str) -> tuple[str, str, str, list[str]]:
    """Text with line ends where blocks end (not unescaped), title, language and links of a page, in time linear in its length: behind
    its last ">" there is no markup, and before it every "<" finds an end."""
    end = page.rfind(">") + 1
    rest = page[end:]
    page = without_specials(page, end)
    end = page.rfind(">") + 1
    page, rest = page[:end], page[end:] + rest
    title = ""
    if (m := _TITLE.search(page)) and (close := _CLOSE["title"].search(page, m.end())):
        title = without_tags(page[m.end() : close.start()])
    html = _HTML.search(page)
    lang = m[1].lower() if html and (m := _LANG.search(html[0])) else ""
    links = ["".join(x or "" for x in m.groups()) for tag in _A.findall(page) if (m := _HREF.search(tag))]
    return without_tags(_BREAK.sub("\n", page)) + rest, title, lang, links


def plain_text(page: str) -> str:
    """The text of a page: lines as its blocks make them, without markup, scripts and repeated white space."""
    return tidied(scanned(page)[0])


def tidied(text: str) -> str:
    """Entities resolved, white space joined."""
    return _LINES.sub("\n", _BLANK.sub(" ", entities.unescape(text))).strip()


#: Codecs of Python that stand for no encoding of text.
_NO_CHARSET = {"idna", "punycode", "undefined", "unicode_escape", "raw_unicode_escape", "unicode-escape", "raw-unicode-escape", "mbcs", "oem"}


def charset_of(kind: str) -> str:
    """The encoding that a content type names; UTF-8 where it names none that text can have."""
    found = re.search(r"charset=[\"']?([\w.:-]+)", kind, re.I)
    try:
        codec = codecs.lookup(found[1]) if found else None
    except (LookupError, ValueError):
        codec = None
    return codec.name if codec is not None and codec._is_text_encoding and codec.name not in _NO_CHARSET else "utf-8"


def derivatives(data: bytes) -> dict:
    """The linked records of one response, and what they hold."""
    headers, block = parse(data)
    if headers.first("warc-type") != "response":
        raise ValueError(f"a {headers.first('warc-type')} record has no derivative")
    head, _, body = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    http = Headers(lines)
    entity, decoded = payload(http, body)
    page = decoded.decode(charset_of(http.get("content-type", "")), "replace")
    uri, date = headers.first("warc-target-uri"), headers.first("warc-date", DATE)
    # A response without an id is named by its content.
    source = headers.first("warc-record-id") or record_id("response", uri, date, digest(block))
    raw, title, lang, hrefs = scanned(page)
    title = " ".join(entities.unescape(title).split())
    links = []
    for href in hrefs:
        try:
            links.append(urljoin(uri, entities.unescape(href).strip()))
        except ValueError:
            continue
    links = list(dict.fromkeys(links))
    fields = [("title", title), ("language", lang), *(("outlink", x) for x in links), *((f"source-{k}", v) for k, v in headers.all), ("source-http-status", status), *((f"source-http-{k}", v) for k, v in http.all)]
    fields = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields if v).encode("utf-8", "replace")
    text = tidied(raw)
    common = [("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Date", date), ("WARC-Target-URI", uri)]
    carried = [(f"WARC-Source-{name}", headers.first(key)) for name, key in (("Payload-Digest", "warc-payload-digest"), ("Block-Digest", "warc-block-digest"), ("Content-Type", "content-type")) if key in headers]
    meta_id, text_id = record_id("metadata", source), record_id("conversion", source)
    encoded = text.encode("utf-8", "replace")
    metadata = record([("WARC-Type", "metadata"), ("WARC-Record-ID", meta_id), *common, *carried, ("WARC-Concurrent-To", text_id), ("WARC-Block-Digest", digest(fields)), ("Content-Type", "application/warc-fields")], fields)
    conversion = record([("WARC-Type", "conversion"), ("WARC-Record-ID", text_id), *common, *carried, ("WARC-Concurrent-To", meta_id), ("WARC-Block-Digest", digest(encoded)), ("Content-Type", "text/plain; charset=utf-8")], encoded)
    ok = headers.first("warc-block-digest", digest(block)) == digest(block) and headers.first("warc-payload-digest", digest(body)) in (digest(body), digest(entity))
    return {"response_id": source, "target_uri": uri, "payload_digest": headers.first("warc-payload-digest") or None, "digest_ok": ok, "metadata_id": meta_id, "conversion_id": text_id, "title": title, "language": lang, "outlinks": links, "text": encoded.decode(), "text_digest": digest(encoded), "metadata": metadata, "conversion": conversion, "error": None}


_TYPES = {"response_id": "string", "target_uri": "string", "payload_digest": "string", "digest_ok": "boolean", "metadata_id": "string", "conversion_id": "string", "title": "string", "language": "string", "outlinks": "array<string>", "text": "string", "text_digest": "string", "metadata": "binary", "conversion": "binary", "error": "string"}
_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "binary": pa.binary()}


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = DATE) -> DataFrame:
    """(key, record): each page as a response record."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                made = [response(u, h, date) for u, h in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True)]
                yield pa.record_batch([part.column(key), pa.array(made, pa.binary())], [key, "record"])

    return pages.select(key, F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")).mapInArrow(run, f"{key} {kind}, record binary")


def derive(records: DataFrame, key: str = "page_id", column: str = "record") -> DataFrame:
    """key and, for each record, its derivatives; see ``derivatives``."""
    kind = records.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part, out = batch.slice(k, 512), []
                for data in part.column("record").to_pylist():
                    try:
                        out.append(derivatives(data or b""))
                    except (ValueError, OSError, EOFError, zlib.error) as why:
                        out.append(dict.fromkeys(_TYPES) | {"error": str(why)})
                yield pa.record_batch([part.column(key), *(pa.array([x[c] for x in out], _ARROW[t]) for c, t in _TYPES.items())], [key, *_TYPES])

    return records.select(key, F.col(column).alias("record")).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{c} {t}" for c, t in _TYPES.items()))


def write_files(derived: DataFrame, path: str) -> None:
    """The metadata and conversion records as Parquet of gzip members (a WARC file is their concatenation), by kind."""
    both = derived.filter("error is null").select(F.explode(F.array(F.struct(F.lit("metadata").alias("kind"), F.col("metadata_id").alias("record_id"), F.col("metadata").alias("record")), F.struct(F.lit("conversion").alias("kind"), F.col("conversion_id").alias("record_id"), F.col("conversion").alias("record")))).alias("x"))
    both = both.select("x.kind", "x.record_id", "x.record")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [gzip.compress(x, mtime=0) for x in batch.column("record").to_pylist()]
            yield pa.record_batch([batch.column("kind"), batch.column("record_id"), pa.array(packed, pa.binary())], ["kind", "record_id", "record"])

    both.mapInArrow(run, "kind string, record_id string, record binary").write.partitionBy("kind").parquet(path)
