"""WARC derivatives: a metadata and a plain-text conversion record for every response record.

responses() makes response records of fetched pages; derivatives() turns response records, from there or
read from WARC files by read_records(), into their two derived records. Both name the response in
WARC-Refers-To, with WARC-Refers-To-Target-URI and -Date, and take over its target URI. The metadata record
(application/warc-fields) carries the title, the links, the HTTP status and the source's HTTP headers, and the
digests of source and text; the conversion record (text/plain) is the visible text, a line for each block.
Digests are sha1 in base32: of the block for every record, of the payload for the response. Record ids are
UUIDs made from what the record is derived from, so a run repeated after a failure gives the same ids.

serialized() gives a record's bytes as in a WARC/1.1 file, optionally as a gzip member of its own, so that
files are plain concatenations of records; as_files() makes such files of a table of records, from_files() the table
of the files.

A page is read once from left to right, so that the time grows with its length whatever it holds: a tag goes from
a < before a letter, / ! or ? to the next >, and where no > follows all the rest is text.

Defined cases: a null page is an empty payload with an empty text; a null url gives records without a
target URI. Headers with line breaks are unfolded. Broken markup is read as far as it goes: an unclosed comment, script
or style hides what follows it. A payload is decoded by the charset of its HTTP header, as UTF-8 without a known one;
bytes that don't decode become U+FFFD. Repeated pages give repeated records with the same ids. An empty table gives no
rows. Only the columns named are read, so further columns can't clash.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html as markup
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
_NAMES = uuid.UUID("6f0b7f0e-2a53-5b1b-9a0c-6d1f5d0c8a11")

_BLOCKS = frozenset(
    "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split()
)
_RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "noscript", "template", "title", "textarea")}  # their content is no markup
_UNSEEN = frozenset(("script", "style", "noscript", "template"))
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)")
_HREF = re.compile(r"(?<![\w-])href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_BLANKS = re.compile(r"[ \t\r\f\v]+")
_FAR = re.compile(r"&#0*\d{8,};?")  # above all code points; Python's own unescaping refuses numbers of thousands of digits


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, *parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, chr(0).join((kind, *parts)))}>"


def _unescaped(text: str) -> str:
    return markup.unescape(_FAR.sub("\ufffd", text))


def scanned(page: str) -> tuple[str, str, list[str]]:
    """(visible text, title, link targets) of a page.

    The text is what a reader sees: a line for each block, without blank lines and with single blanks. The title is that of the
    first title element. Targets stand in the order of their first occurrence.
    """
    out: list[str] = []
    title, links, in_head, at, n = None, {}, False, 0, len(page)
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            begin = n
        if begin > at and not in_head:
            out.append(page[at:begin].replace("\n", " "))
        if begin == n:
            break
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            out.append(" ")
            at = n if end < 0 else end + 3
            continue
        if not (begin + 1 < n and (page[begin + 1] in "!/?" or page[begin + 1].isascii() and page[begin + 1].isalpha())):
            if not in_head:
                out.append("<")
            at = begin + 1
            continue
        end = page.find(">", begin)
        if end < 0:  # no tag can end any more
            if not in_head:
                out.append(page[begin:].replace("\n", " "))
            break
        at = end + 1
        found = _NAME.match(page, begin, end)
        if not found:
            continue
        closes, name = found[1] == "/", found[2].lower()
        if name == "head":
            in_head = not closes
            out.append(" ")
        elif name == "body":
            in_head = False
        elif name == "a" and not closes:
            href = _HREF.search(page, found.end(), end + 1)
            if href:
                links.setdefault(" ".join(_unescaped(href[1] or href[2] or href[3] or "").split()))
        elif name in _RAW and not closes:
            stop = _RAW[name].search(page, at)
            inner = page[at : stop.start() if stop else n]
            if name == "title" and title is None:
                title = " ".join(_unescaped(inner).split())
            if name in _UNSEEN:
                out.append(" ")
            elif not in_head:
                out.append(inner.replace("\n", " "))
            at = stop.end() if stop else n
        elif name in _BLOCKS and not in_head:
            out.append("\n")
    lines = (_BLANKS.sub(" ", x).strip() for x in _unescaped("".join(out)).replace("\xa0", " ").split("\n"))
    return "\n".join(x for x in lines if x), title or "", list(links)


def visible_text(page: str) -> str:
    return scanned(page)[0]


def title_of(page: str) -> str:
    return scanned(page)[1]


def links_of(page: str) -> list[str]:
    return scanned(page)[2]


def decoded(payload: bytes, http: list[tuple[str, str]]) -> str:
    """The payload as text, by the charset of the HTTP header."""
    said = next((re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", v, re.I) for k, v in http if k.lower() == "content-type"), None)
    try:
        return payload.decode(codecs.lookup(said[1]).name if said else "utf-8", "replace")
    except (LookupError, UnicodeError):
        return payload.decode("utf-8", "replace")


def http_response(payload: bytes, headers: dict[str, str], status: str = "200 OK") -> bytes:
    lines = [f"HTTP/1.1 {status}", *(f"{k}: {v}" for k, v in headers.items())]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status, headers and payload of an HTTP response; without a header part all is payload."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return "", [], block
    first, *rest = re.sub(rb"\r\n[ \t]+", b" ", head).decode("latin-1").split("\r\n")
    return first.partition(" ")[2], [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in rest)], payload


def serialized(headers: dict[str, str], block: bytes, compress: bool = False) -> bytes:
    lines = [*(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    out = VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(out, mtime=0) if compress else out


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a WARC file, gzip members or plain."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers.pop("Content-Length"))
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def response_of(key: str, url: str | None, page: str | None, date: str = DATE) -> tuple[dict[str, str], bytes]:
    payload = (page or "").encode()
    block = http_response(payload, {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(payload))})
    return {
        "WARC-Type": "response", "WARC-Record-ID": record_id("response", key, url or "", digest(payload)), "WARC-Date": date, "WARC-Target-URI": url,
        "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": digest(payload), "WARC-Block-Digest": digest(block),
    }, block


def derived(headers: dict[str, str], block: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The metadata and the conversion record of a response record."""
    status, http, payload = split_http(block)
    text, title, links = scanned(decoded(payload, http))
    text = text.encode()
    source, url, date = headers["WARC-Record-ID"], headers.get("WARC-Target-URI"), headers.get("WARC-Date")
    common = {"WARC-Date": date, "WARC-Target-URI": url, "WARC-Refers-To": source, "WARC-Refers-To-Target-URI": url, "WARC-Refers-To-Date": date}
    fields = [("title", title), ("http-status", status), *[(f"http-header-{k.lower()}", v) for k, v in http]]
    fields += [("source-payload-digest", headers.get("WARC-Payload-Digest") or digest(payload)), ("source-block-digest", headers.get("WARC-Block-Digest") or digest(block)), ("text-digest", digest(text))]
    fields += [("outlink", x) for x in links]
    about = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    out = []
    for kind, body, media in (("metadata", about, "application/warc-fields"), ("conversion", text, "text/plain; charset=utf-8")):
        out.append(({"WARC-Type": kind, "WARC-Record-ID": record_id(kind, source), **common, "Content-Type": media, "WARC-Block-Digest": digest(body)}, body))
    return out


_COLUMNS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "refers_to_target_uri": "WARC-Refers-To-Target-URI", "refers_to_date": "WARC-Refers-To-Date",
    "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type", "payload_digest": "WARC-Payload-Digest", "block_digest": "WARC-Block-Digest",
}
_HEADERS = tuple(_COLUMNS.values())
_SCHEMA = ", ".join(f"{c} string" for c in _COLUMNS) + ", block binary"
_MOST = 4 << 20


def _batches(names: list[str], kinds: list[pa.DataType], rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Record batches of about _MOST bytes of blocks."""
    kept, size = [], 0
    for row in rows:
        kept.append(row)
        size += len(row[-1])
        if size > _MOST:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*kept, strict=True), kinds, strict=True)], names=names)
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*kept, strict=True), kinds, strict=True)], names=names)


def responses(pages: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(id_col, the columns of records, block): a response record of each page."""
    kind = pages.schema[id_col].dataType.simpleString()
    names = [id_col, *(x.split()[0] for x in _SCHEMA.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            def rows(b=b):
                for key, u, p in zip(*(b.column(i) for i in range(3)), strict=True):
                    h, block = response_of(str(key.as_py()), u.as_py(), p.as_py())
                    yield (key.as_py(), *(h.get(x) for x in _HEADERS), block)

            yield from _batches(names, [b.schema.types[0], *[pa.string()] * len(_HEADERS), pa.binary()], rows())

    return pages.select(id_col, url, page).mapInArrow(run, f"`{id_col}` {kind}, {_SCHEMA}")


def derivatives(records: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The two derived records of each response record, in the same columns; records of other types give none."""
    kind = records.schema[id_col].dataType.simpleString()
    names = [id_col, *(x.split()[0] for x in _SCHEMA.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            def rows(b=b):
                for i in range(len(b)):
                    key, *values, block = (b.column(j)[i].as_py() for j in range(b.num_columns))
                    headers = {k: v for k, v in zip(_HEADERS, values, strict=True) if v is not None}
                    if headers.get("WARC-Type") == "response":
                        for h, body in derived(headers, block or b""):
                            yield (key, *(h.get(x) for x in _HEADERS), body)

            yield from _batches(names, [b.schema.types[0], *[pa.string()] * len(_HEADERS), pa.binary()], rows())

    return records.select(*names).mapInArrow(run, f"`{id_col}` {kind}, {_SCHEMA}")


def as_files(records: DataFrame, compress: bool = True, most: int = 64 << 20) -> DataFrame:
    """(part, number, content): the records of a table as bytes of WARC files of up to about `most` bytes, each record a gzip member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def file():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([b"".join(held)], pa.binary())], names=["part", "number", "content"])

        for b in batches:
            for i in range(len(b)):
                *values, block = (b.column(j)[i].as_py() for j in range(b.num_columns))
                held.append(serialized(dict(zip(_HEADERS, values, strict=True)), block or b"", compress))
                size += len(held[-1])
                if size >= most:
                    yield file()
                    number, held, size = number + 1, [], 0
        if held:
            yield file()

    return records.select(*_COLUMNS, "block").mapInArrow(run, "part int, number int, content binary")


def from_files(files: DataFrame, content: str = "content") -> DataFrame:
    """The records of WARC files, such as spark.read.format("binaryFile") gives them: (the columns of records, block)."""
    names = [*_COLUMNS, "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                rows = ((*(h.get(k) for k in _HEADERS), block) for h, block in read_records(x.as_py() or b""))
                yield from _batches(names, [*[pa.string()] * len(_HEADERS), pa.binary()], rows)

    return files.select(content).mapInArrow(run, _SCHEMA)
