"""WARC derivatives: linked metadata and plain-text conversion records of responses.

A record is a row: its type, its headers in order, and its block. Responses give two more records each: a metadata
record (JSON of status, headers, title, language and links) and a conversion record (the page's text). Both refer to
the response by its record id, keep its target and date, carry digests of their own block and payload, and keep the
response's digests and source headers. Record ids are derived from the response's id, so a repeated run gives the same.

All headers of the source are kept, in order: those that the new record says of itself come as WARC-Source-..., the
others (WARC-Warcinfo-ID, WARC-Concurrent-To, WARC-Profile, ones of the crawler's own) under their own names.

Everything is done row by row in Arrow batches; nothing is shuffled. read_warc() reads files of records by Spark's text
source with the end of a record as the line separator, so plain files are split and gzipped ones are streamed.

Defined cases: a null block is empty; a block without HTTP headers is all payload, with status null; bytes that no
charset explains are replaced; markup that is no HTML (unknown declarations and marked sections, unclosed ones) is left
out up to its end or read as text, and never fails; a null uri, date or id gives no such header (records refer to what
has an id); repeated rows give repeated records; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = "warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, headers array<struct<name:string,value:string>>, block binary, block_digest string, payload_digest string"
_SPACE = re.compile(r"[ \t\r\f\v\xa0]+")
#: Fixed: elements whose text isn't shown, and elements that begin a line.
_HIDDEN = {"script", "style", "noscript", "template", "head"}
_LINES = {"address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"}
_LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "form": "action"}


class _Page(HTMLParser):
    """Text in lines, title, language and links of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.links: list[dict] = []
        self.title: list[str] = []
        self.lang: str | None = None
        self.hidden: list[str] = []
        self.in_title = False

    def updatepos(self, i, j):
        """Lines and columns of the source aren't needed."""
        return j

    def handle_starttag(self, tag, attrs):
        if attrs:
            found = dict(attrs)
            if tag == "html" and found.get("lang"):
                self.lang = found["lang"]
            if tag in _LINKS and found.get(_LINKS[tag]):
                self.links.append({"path": f"{tag.upper()}@/{_LINKS[tag]}", "url": found[_LINKS[tag]]})
        if tag == "title":
            self.in_title = True
        if tag == "body":
            self.hidden = []
        elif tag in _HIDDEN:
            self.hidden.append(tag)
        if tag in _LINES:
            self.parts.append("\n")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in _HIDDEN and self.hidden:
            self.hidden.pop()

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
        if tag in _LINES:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.hidden:
            self.parts.append(data)

    def parse_marked_section(self, i, report=1):
        """<![ ... up to the next >, whatever it is called."""
        return self.parse_bogus_comment(i, report)

    def unknown_decl(self, data):
        pass

    def read(self, text: str) -> None:
        try:
            self.feed(text)
            self.close()
        except (AssertionError, ValueError):  # what the parser has not got through is text
            if not self.hidden:
                self.parts.append(self.rawdata)

    def text(self) -> str:
        lines = map(str.strip, _SPACE.sub(" ", "".join(self.parts)).split("\n"))
        return "\n".join(filter(None, lines))


#: Fixed: headers of a source that its derived records tell anew, and headers that a record says of itself.
_RETOLD = {"warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "warc-block-digest", "warc-payload-digest"}
_OF_ITSELF = {"content-type": "WARC-Source-Content-Type", "content-length": "WARC-Source-Content-Length", "warc-ip-address": "WARC-Source-IP-Address", "warc-identified-payload-type": "WARC-Source-Identified-Payload-Type", "warc-truncated": "WARC-Source-Truncated"}


def _source_name(name: str) -> str:
    return _OF_ITSELF.get(name.lower(), name)


def sha1_digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_http(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes]:
    """Status, headers and payload of an HTTP response; without a status line all of it is payload."""
    if not block.startswith(b"HTTP/"):
        return None, [], block
    head, _, payload = block.partition(b"\r\n\r\n")
    first, _, rest = head.decode("latin-1").partition("\r\n")
    found = re.match(r"HTTP/\S+ (\d{3})", first)
    return int(found[1]) if found else None, _fields(rest), payload


def _text_of(payload: bytes, headers: list[tuple[str, str]]) -> str:
    declared = next((v for n, v in headers if n.lower() == "content-type"), "")
    charset = re.search(r"charset=[\"']?([\w.:-]+)", declared, re.I)
    for name in ([charset[1]] if charset else []) + ["utf-8"]:
        try:
            return payload.decode(name)
        except (LookupError, ValueError):
            continue
    return payload.decode("utf-8", "replace")


def derived(record_id: str | None, uri: str | None, date: str | None, headers: list[tuple[str, str]], block: bytes) -> list[tuple]:
    """The metadata and the conversion record of one response, in RECORDS' columns."""
    status, http, payload = split_http(block)
    page = _Page()
    page.read(_text_of(payload, http))
    told = {n.lower(): v for n, v in reversed(headers)}
    payload_digest = told.get("warc-payload-digest") or sha1_digest(payload)
    block_digest = told.get("warc-block-digest") or sha1_digest(block)
    digests = [(n, v) for n, v in (("WARC-Block-Digest", block_digest), ("WARC-Payload-Digest", payload_digest)) if not told.get(n.lower())]
    about = {
        "Envelope": {
            "WARC-Header-Metadata": [{"name": n, "value": v} for n, v in [*headers, *digests]],
            "Payload-Metadata": {
                "HTTP-Response-Metadata": {
                    "Status": status,
                    "Headers": [{"name": n, "value": v} for n, v in http],
                    "HTML-Metadata": {"Title": "".join(page.title).strip() or None, "Lang": page.lang, "Links": page.links},
                    "Entity-Length": len(payload),
                    "Entity-Digest": payload_digest,
                }
            },
        }
    }
    out = []
    for kind, content_type, data in (("metadata", "application/json", json.dumps(about, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace")), ("conversion", "text/plain", page.text().encode("utf-8", "replace"))):
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id or uri or block_digest}#{kind}')}>"
        digest = sha1_digest(data)
        fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", record_id), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Block-Digest", digest), ("WARC-Payload-Digest", digest), ("WARC-Source-Block-Digest", block_digest), ("WARC-Source-Payload-Digest", payload_digest), ("Content-Type", content_type), ("Content-Length", str(len(data)))]
        kept = [(_source_name(n), v) for n, v in headers if n.lower() not in _RETOLD]
        out.append((kind, own, record_id, uri, date, content_type, [(n, v) for n, v in fields + kept if v is not None], data, digest, digest))
    return out


def derivatives(responses: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Metadata and conversion records of responses (record_id, target_uri, date, headers, block), with the columns in `keep`."""
    keep = keep or []
    columns = [c.split(" ")[0] for c in RECORDS.split(", ")]
    pair, fields = pa.struct([("name", pa.string()), ("value", pa.string())]), ["record_id", "target_uri", "date", "headers", "block"]

    def headers_of(lists: list[list[tuple[str, str]]]) -> pa.Array:
        ends = np.cumsum([0, *map(len, lists)])
        flat = pa.StructArray.from_arrays([pa.array([x[k] for own in lists for x in own], pa.string()) for k in (0, 1)], fields=list(pair))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part, out, own = batch.slice(at, 200), [], []
                for n, (record_id, uri, date, headers, block) in enumerate(zip(*(part.column(len(keep) + k).to_pylist() for k in range(len(fields))))):
                    records = derived(record_id, uri, date, [(h["name"], h["value"]) for h in headers or [] if h is not None and h["name"] is not None], block or b"")
                    out += records
                    own += [n] * len(records)
                made = [headers_of(list(c)) if name == "headers" else pa.array(c, pa.binary() if name == "block" else pa.string()) for name, c in zip(columns, zip(*out))]
                carried = [part.column(k).take(pa.array(own)) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*carried, *made], names=[*[f"k_{c}" for c in keep], *columns])

    rows = responses.select(*[F.col(c).alias(f"k_{c}") for c in keep], "record_id", "target_uri", "date", "headers", "block")
    kinds = "".join(f"k_{c} {responses.schema[c].dataType.simpleString()}, " for c in keep)
    out = rows.mapInArrow(work, kinds + RECORDS)
    return out.select(*[F.col(f"k_{c}").alias(c) for c in keep], *columns)


def responses_of(pages: DataFrame, date: str, url: str = "url", body: str = "html", page_id: str = "page_id") -> DataFrame:
    """Response records of a table of pages, fetched at `date`: an HTTP block, source headers and digests."""
    page = F.encode(F.coalesce(F.col(body), F.lit("")), "utf-8")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(page).cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(F.encode(head, "utf-8"), page)
    text_id = F.sha1(F.concat_ws("|", F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.coalesce(F.col(url), F.lit("")), F.sha1(page)))
    record_id = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", text_id.substr(1, 8), text_id.substr(9, 4), F.concat(F.lit("5"), text_id.substr(14, 3)), F.concat(F.lit("8"), text_id.substr(18, 3)), text_id.substr(21, 12)), F.lit(">"))
    field = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("target_uri"), record_id.alias("record_id"), F.lit(date).alias("date"), block.alias("block"))
    headers = F.array(
        field("WARC-Type", F.lit("response")), field("WARC-Record-ID", F.col("record_id")), field("WARC-Target-URI", F.col("target_uri")), field("WARC-Date", F.col("date")),
        field("Content-Type", F.lit("application/http; msgtype=response")), field("Content-Length", F.octet_length("block").cast("string")), field("WARC-Identified-Payload-Type", F.lit("text/html")),
    )
    return rows.withColumn("headers", F.filter(headers, lambda h: h["value"].isNotNull()))


def to_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as it stands in a file."""
    return b"WARC/1.0\r\n" + "".join(f"{n}: {v}\r\n" for n, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def _fields(head: str) -> list[tuple[str, str]]:
    return [(n.strip(), v.strip()) for n, colon, v in (line.partition(":") for line in head.split("\r\n")) if colon]


def parse(data: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of each record of a file's bytes."""
    out, at = [], 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        headers = _fields(data[at:end].decode("utf-8", "replace"))
        size = int(next((v for n, v in headers if n.lower() == "content-length"), "0"))
        out.append((headers, data[end + 4 : end + 4 + size]))
        at = end + 4 + size
    return out


_NEXT = "\r\n\r\nWARC/1."


def _record(raw: bytes) -> tuple | None:
    """A record's columns from its bytes without the start of the version; and how many bytes of its block aren't there."""
    if not raw or not raw.strip():
        return None
    head, ended, rest = re.sub(rb"\A(?:WARC/1\.)?\d[^\r\n]*\r\n", b"", raw, count=1).partition(b"\r\n\r\n")
    headers = _fields(head.decode("utf-8", "replace"))
    told = {n.lower(): v for n, v in reversed(headers)}
    size = told.get("content-length", "")
    size = int(size) if size.isdecimal() else len(rest)
    whole = bool(ended) and len(rest) >= size and "warc-type" in told
    row = (told.get("warc-type"), told.get("warc-record-id"), told.get("warc-target-uri"), told.get("warc-date"), [{"name": n, "value": v} for n, v in headers], rest[:size], whole)
    # a block that begins with a record: its head's end was taken for the separator's
    return row, (size - len(rest) if ended else size and size + 4) if "warc-type" in told else 0


def read_warc(spark: SparkSession, paths: str | list[str], most_bytes: int = 1 << 28) -> DataFrame:
    """Records of WARC files, plain or gzipped: record_type, record_id, target_uri, date, headers, block, and whole.

    The files are read with the end of a record and the start of the next as separator, so no file is held whole; pieces
    that follow in the same split are put together up to a record's Content-Length, so a block may hold records itself.
    Gzipped files aren't split. What stays open comes as pieces with whole = false: a record that its file ends before, one
    that lacks more than most_bytes where the separator is found in it, and one of a plain file that holds the separator and
    crosses the end of a split (the pieces beyond are rows of their own). Files may differ in their version."""
    fields = "record_type string, record_id string, target_uri string, date string, headers array<struct<name:string,value:string>>, block binary, whole boolean"

    def put(rows):
        columns = list(zip(*rows)) if rows else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)

    def work(batches):
        place, pieces, lacks = None, [], 0  # the record that is open

        def closed():
            """The open record if it is whole, else its pieces."""
            found = [_record(b if lacks <= 0 or not n else b[len(_NEXT) :]) for n, b in enumerate([b"".join(pieces)] if lacks <= 0 else pieces)]
            return [f[0] for f in found if f]

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = []
                for raw, *own in zip(*(batch.column(k).slice(at, 200).to_pylist() for k in range(3))):
                    if pieces and own == place:
                        pieces.append(_NEXT.encode() + (raw or b""))
                        lacks -= len(pieces[-1])
                        if lacks <= 0:
                            rows += closed()
                            pieces = []
                        continue
                    if pieces:  # another file, or another split
                        rows += closed()
                        pieces = []
                    found = _record(raw)
                    if found and 0 < found[1] <= most_bytes:
                        place, pieces, lacks = own, [raw], found[1]
                    elif found:
                        rows.append(found[0])
                yield put(rows)
        if pieces:
            yield put(closed())

    schema = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("block", pa.binary()), ("whole", pa.bool_())])
    raw = spark.read.option("lineSep", _NEXT).text(paths).select(F.col("value").cast("binary"), "_metadata.file_path", "_metadata.file_block_start")
    return raw.mapInArrow(work, fields)


def file_bytes(records: DataFrame) -> DataFrame:
    """records with column `record`: the bytes that a file of records concatenates."""

    @F.pandas_udf("binary")
    def joined(headers: pd.Series, block: pd.Series) -> pd.Series:
        return pd.Series([to_bytes([(h["name"], h["value"]) for h in hs], bytes(b)) for hs, b in zip(headers, block)])

    return records.withColumn("record", joined("headers", "block"))
