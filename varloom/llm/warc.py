"""Derivatives of WARC responses: linked metadata and plain-text records (operator 9).

Every response record gives a ``metadata`` record, which keeps the source's HTTP
headers and digests, and a ``conversion`` record with the page's plain text. Both
refer to the response by its identifier, target and date. Record identifiers are
derived from the source's, so a repeated task writes the same records.

Defined cases: a missing or empty page gives a response without a body and an
empty text; a missing url leaves out the target; a record that is missing, broken
or no response gives one row of type ``error`` with its reason, and nothing is
dropped; repeated rows give repeated records; other columns are kept.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "2020-01-01T00:00:00Z"
END = b"\r\n\r\n"
# Elements without visible text, and elements that break a line.
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|center|dd|details|div|dl|dt|fieldset|figcaption|figure|footer|form|"
    r"h[1-6]|head|header|hr|html|legend|li|main|menu|nav|ol|option|p|pre|section|select|summary|table|tbody|td|tfoot|th|"
    r"thead|title|tr|ul)\b[^>]*>", re.I,
)
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*>")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_CHARSET = re.compile(r"charset=[\"']?([\w.:-]+)", re.I)


def digest_of(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def record_id(*parts: object) -> str:
    """An identifier that is the same whenever the parts are."""
    name = "\n".join("" if p is None else str(p) for p in parts)
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(name.encode('utf-8', 'surrogatepass')).digest()[:16], version=5)}>"


def _line(value: object) -> str:
    return " ".join(str(value).split())


def build(kind: str, identifier: str, fields: dict[str, str | None], block: bytes) -> bytes:
    """A record without its two closing line ends."""
    head = {"WARC-Type": kind, "WARC-Record-ID": identifier} | fields
    head |= {"WARC-Block-Digest": digest_of(block), "Content-Length": str(len(block))}
    lines = ["WARC/1.1", *(f"{k}: {_line(v)}" for k, v in head.items() if v)]
    return "\r\n".join(lines).encode("utf-8", "replace") + END + block


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record; raises ValueError."""
    head, found, rest = record.partition(END)
    if not found or not head.startswith(b"WARC/1."):
        raise ValueError("no WARC header")
    fields = _fields(head)
    length = fields.get("content-length", "")
    if not length.isdigit() or len(rest) < int(length):
        raise ValueError("block shorter than Content-Length")
    block = rest[: int(length)]
    stated = fields.get("warc-block-digest")
    if stated and stated.startswith("sha256:") and stated != digest_of(block):
        raise ValueError("block digest differs")
    return fields, block


def _fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        name = name.strip().lower()
        out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
    return out


def records(data: bytes) -> Iterator[bytes]:
    """The records of an uncompressed file."""
    at = 0
    while at < len(data):
        head_end = data.find(END, at)
        if head_end < 0:
            raise ValueError("no WARC header")
        length = int(_fields(data[at:head_end]).get("content-length", "0"))
        end = head_end + 4 + length
        yield data[at:end]
        at = end + 4


def plain_text(html: str) -> str:
    """Visible text; block elements end a line, white space is one space."""
    text = unescape(_TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub("", html.replace("\n", " ").replace("\r", " ")))))
    return "\n".join(line for line in (" ".join(x.split()) for x in text.split("\n")) if line)


def response(page_id, url: str | None, html: str | None, date: str = DATE) -> bytes:
    body = (html or "").encode("utf-8", "replace")
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nServer: table\r\n"
        f"X-Page-Id: {'' if page_id is None else page_id}\r\nContent-Length: {len(body)}\r\n\r\n"
    ).encode()
    return build(
        "response", record_id("response", page_id, url), {
            "WARC-Target-URI": url, "WARC-Date": date, "Content-Type": "application/http; msgtype=response",
            "WARC-Payload-Digest": digest_of(body),
        }, http + body,
    )


def derive(record: bytes | None) -> list[dict]:
    """Rows of the metadata and the conversion record of one response, or one error row."""
    try:
        if record is None:
            raise ValueError("no record")
        fields, block = parse(record)
        if fields.get("warc-type") != "response":
            raise ValueError(f"type is {fields.get('warc-type')}")
        source = fields.get("warc-record-id")
        if not source:
            raise ValueError("no record id")
        head, found, body = block.partition(END)
        if not found:
            raise ValueError("no HTTP header")
        headers, status = _fields(head), head.split(b"\r\n", 1)[0].decode("latin-1")
        payload = digest_of(body)
        stated = fields.get("warc-payload-digest")
        if stated and stated.startswith("sha256:") and stated != payload:
            raise ValueError("payload digest differs")
    except ValueError as error:
        return [{"record_type": "error", "error": str(error)}]
    charset = _CHARSET.search(headers.get("content-type", ""))
    try:
        html = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        html = body.decode("utf-8", "replace")
    text = plain_text(html)
    title = _TITLE.search(html)
    target, date = fields.get("warc-target-uri"), fields.get("warc-date")
    linked = {
        "WARC-Target-URI": target, "WARC-Date": date, "WARC-Refers-To": source,
        "WARC-Refers-To-Target-URI": target, "WARC-Refers-To-Date": date,
    }
    kept = stated or payload
    facts = {
        "source-status": status, "source-payload-digest": kept,
        "source-block-digest": fields.get("warc-block-digest") or digest_of(block), "payload-length": len(body),
        "title": " ".join(unescape(title[1]).split()) if title else "", "text-length": len(text),
    }
    lines = [f"{k}: {_line(v)}" for k, v in facts.items()] + [f"source-header-{k}: {_line(v)}" for k, v in headers.items()]
    converted = text.encode("utf-8", "replace")
    out = []
    for kind, block_type, own in (
        ("metadata", "application/warc-fields", ("\r\n".join(lines) + "\r\n").encode("utf-8", "replace")),
        ("conversion", "text/plain; charset=utf-8", converted),
    ):
        identifier = record_id(kind, source)
        made = build(kind, identifier, linked | {"Content-Type": block_type, "WARC-Payload-Digest": digest_of(own)
                                                 if kind == "conversion" else None}, own)
        out.append({
            "record_type": kind, "record_id": identifier, "refers_to": source, "target_uri": target, "date": date,
            "source_payload_digest": kept, "block_digest": digest_of(own), "block": own, "record": made,
            "source_headers": list(headers.items()),
        })
    return out


def _respond(batches):
    for batch in batches:
        rest = [c for c in batch.schema.names if c not in ("url", "html")]
        rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in rest), pa.array([response(*r) for r in rows], pa.binary())],
            names=[*rest, "response"],
        )


_FIELDS = [
    ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()),
    ("date", pa.string()), ("source_payload_digest", pa.string()), ("source_headers", pa.map_(pa.string(), pa.string())),
    ("block_digest", pa.string()), ("block", pa.binary()), ("record", pa.binary()), ("error", pa.string()),
]
_DDL = (
    "record_type string, record_id string, refers_to string, target_uri string, date string, "
    "source_payload_digest string, source_headers map<string,string>, block_digest string, block binary, "
    "record binary, error string"
)


def _derive(column: str):
    def run(batches):
        for batch in batches:
            rest = [c for c in batch.schema.names if c != column]
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                row, found = [], []
                for k, record in enumerate(part.column(column).to_pylist()):
                    made = derive(record)
                    row += [k] * len(made)
                    found += made
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(take) for c in rest),
                     *(pa.array([f.get(n) for f in found], kind) for n, kind in _FIELDS)],
                    names=[*rest, *(n for n, _ in _FIELDS)],
                )

    return run


def responses(pages: DataFrame) -> DataFrame:
    """``pages`` with ``response``, the page as a WARC response record, instead of url and html."""
    rest = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.schema if f.name not in ("url", "html"))
    return pages.mapInArrow(_respond, rest + "response binary")


def derivatives(rows: DataFrame, column: str = "response") -> DataFrame:
    """Two rows per response record: its metadata and its conversion record; the other columns are kept."""
    rest = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != column)
    return rows.mapInArrow(_derive(column), rest + _DDL)


def write_warc(derived: DataFrame, path: str) -> None:
    """Write derived records as WARC files; the record end is the writer's line separator."""
    derived.where("record is not null").select(F.col("record").cast("string").alias("value")).write.option(
        "lineSep", END.decode()
    ).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, record) of all records of uncompressed WARC files, each of which fits into a task."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                found = []
                for record in records(content.as_py()):
                    found.append(record)
                    if len(found) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array(found, pa.binary())],
                                                         names=["path", "record"])
                        found = []
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found, pa.binary())],
                                                 names=["path", "record"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, record binary")


def digest(pages: DataFrame) -> DataFrame:
    """One row per derived record with its links, digests, length, text and the hash of the whole record."""
    made = derivatives(responses(pages.select("page_id", "url", "html")))
    return made.select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", "source_payload_digest", "block_digest",
        F.element_at("source_headers", "content-type").alias("source_content_type"),
        F.length("block").cast("long").alias("n_bytes"), F.sha2("record", 256).alias("record_sha256"),
        F.when(F.col("record_type") == "conversion", F.col("block").cast("string")).alias("text"), "error",
    )
