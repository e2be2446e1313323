"""WARC derivatives: metadata and plain-text conversion records made from response records, and linked to them."""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import words as w

VERSION = "WARC/1.1"
CAPTURED = "1970-01-01T00:00:00Z"  # capture date of pages that come without one
RESPONSES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("record", T.BinaryType())])
DERIVATIVES = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("warc_type", T.StringType()), T.StructField("record_id", T.StringType()),
    T.StructField("refers_to", T.StringType()), T.StructField("concurrent_to", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("warc_date", T.StringType()),
    T.StructField("source_headers", T.MapType(T.StringType(), T.StringType())),  # of a repeated name the last value
    T.StructField("source_header_list", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))),
    T.StructField("source_payload_digest", T.StringType()), T.StructField("block_digest", T.StringType()),
    T.StructField("block", T.StringType()), T.StructField("record", T.BinaryType()), T.StructField("damage", T.StringType()),
])
_NAME = re.compile(rb"([^:\s]+):[ \t]*(.*?)\s*\Z")
_HIDDEN = re.compile(r"<!--|<(script|style|noscript|template|head)\b[^<>]*>", re.I)
_MARK = re.compile(r"<!--|<!?(/?)([a-z][^\s/<>]*+)[^<>]*+>", re.I)
_IN_HEAD = frozenset(("base", "basefont", "bgsound", "head", "html", "link", "meta", "noframes", "noscript", "script", "style", "template", "title", "doctype"))
_WHOLE = frozenset(("noframes", "noscript", "script", "style", "template", "title"))  # of those in a head, with an end of their own
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-z!?][^<>]*>", re.I)
_PLAIN_PATH = re.compile(r"/(?:[A-Za-z0-9_-]+/)*[A-Za-z0-9_-]*")  # nothing in it to resolve
_TITLE = re.compile(r"<title\b[^<>]*>([^<]*)</title", re.I)
_LINK = re.compile(r"""<a\b[^<>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_CHARSET = re.compile(r"charset=\"?([\w-]+)", re.I)


class Damaged(ValueError):
    """A record that does not follow the format, or does not match its digests."""


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: bytes) -> str:
    """The same for the same parts, whenever and wherever a record is made."""
    mark = hashlib.sha256(b"".join(len(p).to_bytes(8, "big") + p for p in parts)).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=mark[:16], version=5)}>"


def _one_line(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value)


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{name}: {_one_line(value)}" for name, value in headers if value is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers_of(lines: list[bytes]) -> list[tuple[str, str]]:
    """Names and values in order; a line that starts with white space goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (b" ", b"\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip().decode('utf-8', 'replace')}")
        elif found := _NAME.match(line):
            out.append((found[1].decode("utf-8", "replace"), found[2].decode("utf-8", "replace")))
    return out


def first(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((value for own, value in headers if own.lower() == name.lower()), None)


def parse(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of one record; its block digest is verified if it has one."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(b"WARC/"):
        raise Damaged("no record")
    headers = headers_of(lines[1:])
    size = first(headers, "Content-Length") or ""
    if not size.isdigit() or len(rest) < int(size):
        raise Damaged("record cut short")
    block = rest[:int(size)]
    said = first(headers, "WARC-Block-Digest")
    if said is not None and said.startswith("sha1:") and said != digest(block):
        raise Damaged("block digest")
    return headers, block


class _Ends:
    """Where comments and elements of a page end."""

    def __init__(self, page: str):
        self.page, self.known = page, {}

    def behind(self, kind: str, at: int) -> int | None:
        """The place behind the first end of a comment ("") or an element from `at` on, if there is one."""
        if kind not in self.known:
            self.known[kind] = [m.end() for m in re.finditer(rf"</{kind}\s*>" if kind else "-->", self.page, re.I)]
        ends = self.known[kind]
        k = bisect_left(ends, at + 3)
        return ends[k] if k < len(ends) else None

    def of_head(self, at: int) -> int:
        """Where a head ends that starts before `at`: behind its closing tag, or before the first text or element that
        cannot stand in a head."""
        while found := _MARK.search(self.page, at):
            if self.page[at:found.start()].strip():
                return at
            name = (found[2] or "").lower()
            if found[1]:
                if name in ("head", "body", "html", "br"):
                    return found.end() if name == "head" else found.start()
            elif found[2] and name not in _IN_HEAD:
                return found.start()
            whole = not found[1] and (not found[2] or name in _WHOLE)
            at = whole and self.behind(name, found.end()) or found.end()
        return at


def _seen(page: str) -> str:
    """The page without heads, comments, scripts, styles and the like. Of one that never ends only its tag goes."""
    ends, out, at = _Ends(page), [], 0
    for found in _HIDDEN.finditer(page):
        if found.start() >= at:
            kind = (found[1] or "").lower()
            out.append(page[at:found.start()])
            at = ends.of_head(found.end()) if kind == "head" else ends.behind(kind, found.end()) or found.end()
    return " ".join([*out, page[at:]])


def plain_text(page: str) -> str:
    """What a reader sees: no scripts, styles, head or comments; a line for each block."""
    text = _TAG.sub("", _BREAK.sub("\n", _seen(page)))
    lines = (" ".join(line.split()) for line in html.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def _response(page_id: int | None, url: str | None, page: bytes | None, date: str) -> bytes:
    body = page or b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    return record([
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id(str(page_id).encode(), (url or "").encode(), body)),
        ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)),
        ("Content-Type", "application/http; msgtype=response"),
    ], block)


def _site(base: str) -> str | None:
    """Scheme and host of a web address, which a plain absolute path is joined to."""
    try:
        own = urlsplit(base)
    except ValueError:
        return None
    return f"{own.scheme}://{own.netloc}" if own.scheme in ("http", "https") and own.netloc else None


def _link(base: str, site: str | None, target: str) -> str:
    if site is not None and _PLAIN_PATH.fullmatch(target):
        return site + target
    try:
        return urljoin(base, html.unescape(target))
    except ValueError:
        return target


def derive(data: bytes) -> list[dict]:
    """The metadata and the conversion record of one response record."""
    headers, block = parse(data)
    source, target, date = (first(headers, x) for x in ("WARC-Record-ID", "WARC-Target-URI", "WARC-Date"))
    if first(headers, "WARC-Type") != "response" or not source:
        raise Damaged("not a response with an id")
    head, _, body = block.partition(b"\r\n\r\n")
    status, *lines = head.split(b"\r\n")
    http = headers_of(lines)
    said = first(headers, "WARC-Payload-Digest")
    own = digest(body)
    if said is not None and said.startswith("sha1:") and said != own:
        raise Damaged("payload digest")
    charset = _CHARSET.search(first(http, "Content-Type") or "")
    try:
        page = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    text = plain_text(page)
    shown, site = text.encode(), _site(target or "")
    shown_digest = digest(shown)
    title = _TITLE.search(page)
    ids = {kind: record_id(kind.encode(), source.encode(), own.encode()) for kind in ("metadata", "conversion")}
    about = {
        "source": dict(headers), "source_list": headers,
        "http": {"status": status.decode("utf-8", "replace"), "headers": dict(http), "header_list": http},
        "payload": {"digest": own, "length": len(body)},
        "html": {
            "title": html.unescape(title[1]).strip() if title else None,
            "links": [_link(target or "", site, a or b or c) for a, b, c in _LINK.findall(page)],
        },
        "conversion": {"record_id": ids["conversion"], "digest": shown_digest, "length": len(shown)},
    }
    out = []
    for kind, other, mime, content in (
        ("metadata", "conversion", "application/json", json.dumps(about, ensure_ascii=False, sort_keys=True)),
        ("conversion", "metadata", "text/plain; charset=utf-8", text),
    ):
        block = shown if content is text else content.encode()
        own_digest = shown_digest if content is text else digest(block)
        out.append({
            "warc_type": kind, "record_id": ids[kind], "refers_to": source, "concurrent_to": ids[other], "target_uri": target,
            "warc_date": date, "source_headers": list(dict(headers).items()),
            "source_header_list": [{"name": name, "value": value} for name, value in headers], "source_payload_digest": own, "block_digest": own_digest,
            "block": content, "record": record([
                ("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Refers-To", source), ("WARC-Concurrent-To", ids[other]),
                ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", target), ("WARC-Date", date),
                ("WARC-Block-Digest", own_digest), ("Content-Type", mime),
            ], block), "damage": None,
        })
    return out


def _responses(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.blocks(batches, "html"):
            pages = batch.column("html").cast(pa.binary()).to_pylist()
            ids, urls = batch.column("page_id").to_pylist(), batch.column("url").to_pylist()
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([_response(*x, date) for x in zip(ids, urls, pages)], pa.binary()),
            ], names=["page_id", "record"])

    return run


def _derived(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.blocks(batches, "record"):
            rows = []
            for page, data in zip(batch.column("page_id").to_pylist(), batch.column("record").to_pylist()):
                try:
                    rows += [{"page_id": page, **x} for x in derive(data or b"")]
                except Damaged as damage:
                    rows.append({"page_id": page, "damage": str(damage)})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)

    return run


def responses(pages: DataFrame, date: str = CAPTURED) -> DataFrame:
    """`(page_id, record)`: each row of `pages(page_id, url, html)` as a response record. A null page is an empty
    payload, a null url leaves the target out, a null id is part of the record's id like any other."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(_responses(date), RESPONSES)


def derivatives(records: DataFrame) -> DataFrame:
    """`DERIVATIVES`: a metadata and a conversion record for each response of `records(page_id, record)`.

    Both refer to the response by its id, target and date and name each other; the metadata hold all source headers
    (repeated names in `source_list` and `header_list`), the page's links and digests; the conversion holds the text. A record that is null, damaged or no response gives one row
    with the reason in `damage`. Repeated records give the same records again, with the same ids. Other columns are not
    read. An empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    return records.select("page_id", "record").mapInArrow(_derived(to_arrow_schema(DERIVATIVES)), DERIVATIVES)
