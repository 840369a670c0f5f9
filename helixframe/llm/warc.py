"""WARC derivatives: each response record gives a metadata record and a plain-text conversion record that refer to it.

Records are read from bytes, so headers, identifiers and digests are those of the source. A derivative carries
WARC-Refers-To (the response's record id), the source's target URI and date, its own block digest, and the source's
payload digest as given. The metadata record (application/warc-fields) lists the source's HTTP status line and
headers, title, charset and outlinks. Derived ids follow from the source's id, so a repeated run gives the same ones.

Pages are read in one pass, so very long or broken ones take time in proportion to their length.

Null or malformed records, and those that are not responses, give a row with a status and null derivatives. A null
page is a response with an empty payload; a null URL leaves the target URI out. Repeated rows give equal records, ids
included: distinct them before they go into one file. An empty table gives an empty one. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NAMESPACE = uuid.UUID(hashlib.md5(b"helixframe.warc").hexdigest())
#: Elements that part lines, those whose content is not read, those that may stand in a head.
_BREAKS = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
_SILENT = frozenset("script style template noscript".split())
_IN_HEAD = frozenset("base link meta title html head".split())
#: Blanks that are not one space already.
_BLANK = re.compile(r"(?: [ \t\r\f\v\xa0]|[\t\r\f\v\xa0])[ \t\r\f\v\xa0]*+")
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_TAG_END = re.compile(r"""[^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+>""")
_HREF = re.compile(r"""\shref\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_TAG_MOST = 1 << 16


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, kind + ' ' + source)}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record; length and block digest are added."""
    own = [*headers, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {_field(v)}\r\n" for k, v in own).encode() + b"\r\n" + block + b"\r\n\r\n"


def _field(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def parse(raw: bytes) -> tuple[dict[str, str], list[tuple[str, str]], bytes] | None:
    """(headers by lower-case name, headers in order, block) of one record; None if it is malformed."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"WARC/"):
        return None
    fields = [tuple(x.strip() for x in line.split(":", 1)) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line]
    by_name = {k.lower(): v for k, v in fields}
    try:
        size = int(by_name["content-length"])
    except (KeyError, ValueError):
        return None
    return (by_name, fields, rest[:size]) if 0 <= size <= len(rest) else None


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, payload) of an HTTP response."""
    head, sep, payload = block.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"HTTP/"):
        return "", [], block
    first, *lines = head.decode("latin-1").split("\r\n")
    return first, [tuple(x.strip() for x in line.split(":", 1)) for line in lines if ":" in line], payload


class Page:
    """Title, links and readable text of a page, from one pass over it.

    The text leaves out scripts, styles, comments and the head; block elements and line breaks part lines. A head ends
    with its end tag, or without one before the first thing that cannot stand in it. What is left open (a comment, a script, a title)
    runs to the end of the page, but an open title is none. A tag ends at its first > outside quotes.
    """

    def __init__(self, page: str):
        self.title, self.links = None, []
        low = page.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: A-Z only, places stay
        out, at, n, head = [], 0, len(page), False
        last_head, last_title = low.rfind("</head"), low.rfind("</title")
        closes = last_head >= 0
        while at < n:
            tag = page.find("<", at)
            if tag < 0 or tag > at:
                part = page[at : tag if tag >= 0 else n]
                if head and not closes and part.strip():
                    head = False
                if not head:
                    out.append(part.replace("\n", " "))
                if tag < 0:
                    break
            at = tag
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = n if end < 0 else end + 3
                out.append(" ")
                continue
            name = _NAME.match(page, at)
            if not name and not page.startswith(("<!", "<?", "</"), at):
                if not head:
                    out.append("<")
                at += 1
                continue
            m = _TAG_END.match(page, at, min(n, at + _TAG_MOST))
            end = m.end() if m else page.find(">", at) + 1
            if not end:  # no tag ends any more: the rest is text
                if not head:
                    out.append(page[at:].replace("\n", " "))
                break
            kind, opens = low[name.start(1) : name.end(1)] if name else "", not page.startswith("</", at)
            begin, at = at, end
            if head and kind not in _SILENT and kind not in _IN_HEAD and not closes:
                head = False
            if kind == "head":
                head = opens
                closes = last_head >= at
                out.append(" ")
            elif opens and kind in _SILENT:
                end = low.find("</" + kind, at)
                at = n if end < 0 else low.find(">", end) + 1 or n
                out.append(" ")
            elif opens and kind == "title" and (head or self.title is None):
                end = low.find("</title", at) if last_title >= at else -1
                if end >= 0 and self.title is None:
                    self.title = page[at:end]
                if head:
                    at = n if end < 0 else end
            elif kind == "a" and opens and (href := _HREF.search(page, begin, end)):
                self.links.append(html.unescape(href[1] or href[2] or href[3] or ""))
            if kind in _BREAKS and not head:
                out.append("\n")
        text = "".join(out)
        if "&" in text:
            text = html.unescape(text)
        lines = (line.strip(" ") for line in _BLANK.sub(" ", text).split("\n"))
        self.text = "\n".join([line for line in lines if line]).strip()


def plain_text(page: str) -> str:
    return Page(page).text


_OUT = pa.struct([("status", pa.string()), ("response_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("payload_ok", pa.bool_()), ("metadata_id", pa.string()), ("conversion_id", pa.string()), ("refers_to", pa.string()), ("title", pa.string()), ("n_links", pa.int64()), ("text", pa.string()), ("metadata", pa.binary()), ("conversion", pa.binary())])
_DDL = "struct<status:string,response_id:string,target_uri:string,date:string,payload_digest:string,payload_ok:boolean,metadata_id:string,conversion_id:string,refers_to:string,title:string,n_links:bigint,text:string,metadata:binary,conversion:binary>"


def derive_one(raw: bytes | None) -> dict:
    out = dict.fromkeys((f.name for f in _OUT))
    found = parse(raw) if raw else None
    if not found:
        return out | {"status": "malformed" if raw else "empty"}
    names, _, block = found
    source = names.get("warc-record-id", "")
    out |= {"response_id": source, "target_uri": names.get("warc-target-uri"), "date": names.get("warc-date"), "payload_digest": names.get("warc-payload-digest")}
    if names.get("warc-type", "").lower() != "response" or not source:
        return out | {"status": "not a response"}
    first, http, payload = split_http(block)
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    named = _CHARSET.search(kind) or _CHARSET.search(payload[:1024].decode("latin-1"))
    charset = named[1].lower() if named else "utf-8"
    try:
        page = payload.decode(charset, "replace")
    except LookupError:
        charset, page = "utf-8", payload.decode("utf-8", "replace")
    if charset not in ("utf-8", "utf8"):
        page = page.encode("utf-8", "replace").decode()
    seen = Page(page)
    title = None if seen.title is None else _field(html.unescape(seen.title)).strip()
    links, text = seen.links, seen.text
    shared = [("WARC-Refers-To", source)]
    shared += [(k, out[c]) for k, c in (("WARC-Target-URI", "target_uri"), ("WARC-Date", "date")) if out[c] is not None]
    shared += [(k, names[k.lower()]) for k in ("WARC-Payload-Digest", "WARC-Warcinfo-ID", "WARC-IP-Address", "WARC-Concurrent-To") if k.lower() in names]
    meta = [("http-status-line", first), *((f"http-header-{k}", v) for k, v in http), ("charset", charset), *([("title", title)] if title is not None else []), *(("outlink", x) for x in links)]
    ids = {k: derived_id(source, k) for k in ("metadata", "conversion")}
    head = lambda k, kind: [("WARC-Type", k), ("WARC-Record-ID", ids[k]), *shared, ("Content-Type", kind)]
    return out | {
        "status": "ok",
        "payload_ok": None if out["payload_digest"] is None else out["payload_digest"] == digest(payload),
        "metadata_id": ids["metadata"],
        "conversion_id": ids["conversion"],
        "refers_to": source,
        "title": title,
        "n_links": len(links),
        "text": text,
        "metadata": record(head("metadata", "application/warc-fields"), "".join(f"{k}: {_field(v)}\r\n" for k, v in meta).encode()),
        "conversion": record(head("conversion", "text/plain; charset=utf-8"), text.encode()),
    }


def derive(response: Column) -> Column:
    """struct of a response record's derivatives, from the record's bytes."""

    @F.arrow_udf(_DDL)
    def build(rows: pa.Array) -> pa.Array:
        found = [derive_one(r.as_py()) for r in rows]
        return pa.StructArray.from_arrays([pa.array([x[f.name] for x in found], f.type) for f in _OUT], fields=list(_OUT))

    return build(response)


def responses(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(id, response): pages as WARC response records. Record ids follow from page id, URL and payload."""

    @F.arrow_udf("binary")
    def build(ids: pa.Array, urls: pa.Array, bodies: pa.Array) -> pa.Array:
        out = []
        for i, u, b in zip(ids, urls, bodies):
            payload = (b.as_py() or "").encode()
            url = u.as_py()
            mark = digest(payload)
            block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload
            own = [("WARC-Type", "response"), ("WARC-Record-ID", derived_id(f"{i.as_py()} {url} {mark}", "response")), ("WARC-Date", date)]
            own += [("WARC-Target-URI", url)] if url is not None else []
            out.append(record([*own, ("WARC-Payload-Digest", mark), ("Content-Type", "application/http; msgtype=response")], block))
        return pa.array(out, pa.binary())

    return pages.select(F.col(id_col).alias("id"), build(F.col(id_col), F.col(url_col), F.col(html_col)).alias("response")).withColumnRenamed("id", id_col)


def _unpacked(data: bytes, step: int) -> Iterator[bytes]:
    """The bytes of a file in pieces; gzip members one after another.

    Where a member is broken, a line says so in place of its rest, and the next member is looked for by its first bytes.
    """
    if data[:2] != _MEMBER[:2]:
        yield from (data[i : i + step] for i in range(0, len(data), step))
        return
    at = 0
    while at < len(data):
        member, rest, whole = zlib.decompressobj(31), memoryview(data)[at:], True
        while not member.eof:
            try:
                piece = member.decompress(rest, step)
            except zlib.error:
                whole = False
                break
            if not piece and not member.eof and not member.unconsumed_tail:
                whole = False
                break
            rest = memoryview(member.unconsumed_tail if not member.eof else member.unused_data)
            if piece:
                yield piece
        if whole:
            at = len(data) - len(rest)
            if not len(rest) or data[at : at + 2] == _MEMBER[:2]:
                continue
        yield b"\r\n\r\n(bytes of a file that could not be unpacked)\r\n\r\n"
        at = data.find(_MEMBER, at + 1)
        if at < 0:
            return


#: How a gzip member starts, and what stands between two records.
_MEMBER, _BETWEEN = b"\x1f\x8b\x08", b"\r\n\r\nWARC/1."
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$")
_START = re.compile(rb"(?m)^WARC/")


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a stream of bytes. Bytes that are no record, and records without a readable length, are one up to the next
    line that starts with "WARC/". A record whose length is not followed by another record's start, or by the end, but runs over such a
    start, ends there: what its length would swallow is read as records. Only the record at hand is held."""
    held, done = b"", False

    def more() -> bool:
        nonlocal held, done
        piece = next(pieces, None)
        done = piece is None
        held += piece or b""
        return not done

    while True:
        held = held.lstrip(b"\r\n")
        if not held:
            if done or not more():
                return
            continue
        end = held.find(b"\r\n\r\n")
        following = _START.search(held, 1)
        if end < 0 and not following and not done:
            more()
            continue
        nearest = following.start() if following else len(held)
        size = _LENGTH.search(held[: end + 2]) if held.startswith(b"WARC/") and 0 <= end < nearest else None
        if size:
            stop = end + 4 + int(size[1])
            parts, n = [held], len(held)
            while n < stop + len(_BETWEEN) and (piece := next(pieces, None)) is not None:
                parts.append(piece)
                n += len(piece)
            held, done = b"".join(parts), n < stop + len(_BETWEEN)
            after = held[stop : stop + len(_BETWEEN)].lstrip(b"\r\n")
            if n < stop or after and not after.startswith(b"WARC/"[: len(after)]):
                cut = held.find(_BETWEEN, end)
                if 0 <= cut < stop:
                    yield held[:cut]
                    held = held[cut:]
                    continue
            yield held[:stop] + (b"\r\n\r\n" if n >= stop else b"")
            held = held[stop:]
        elif following or done:
            yield held[:nearest]
            held = held[nearest:]
        else:
            more()


def read_warc(spark: SparkSession, path: str, piece_bytes: int = 4 << 20) -> DataFrame:
    """(path, place, record): the records of WARC files, gzipped by record, as a whole, or not at all.

    A file is one row of Spark's binary source, so at most 2 GB as stored; it is unpacked and split as a stream, a record at a time.
    What is no record is a row too, which `derive` calls malformed.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def split(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                found, held, place = [], 0, 0
                for record in chain(split_records(_unpacked(content.as_buffer().to_pybytes(), piece_bytes)), [None]):
                    if record is not None:
                        found.append(record)
                        held += len(record)
                    if found and (record is None or held > 2 * piece_bytes):
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(range(place, place + len(found)), pa.int64()), pa.array(found, pa.binary())], ["path", "place", "record"])
                        place, found, held = place + len(found), [], 0

    return files.mapInArrow(split, "path string, place bigint, record binary")
