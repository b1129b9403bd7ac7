"""WARC derivatives: metadata and plain-text conversion records from response records.

Each response becomes two records that refer to it by its record id: a `metadata` record with what is known
about the payload and its links, and a `conversion` record with the plain text. Source headers, WARC's and HTTP's,
and source digests are carried over as they are; a payload digest is computed, over the payload's own bytes, only
where the source gives none. Text is decoded by the declared charset. Blocks get their own digests. Ids follow from
the response's id and the record's kind, so reruns and retried tasks give the same records.

Defined results: a null html is an empty payload, a null url an empty target; repeated rows give repeated
records; extra columns are ignored; an empty table gives no records. Payloads are read whole, in time in proportion
to their length. A record that is cut short ends its file, those before it are read; header lines without a colon are
passed over; an unknown charset, and bytes that it does not have, are read as UTF-8 with replacement characters, in
the text alone. Files may be gzip, whole or a member a record. A file is one row of the reader, so it must be under 2 GB.
"""

from __future__ import annotations

import base64
import hashlib
import html as html_entities
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

DATE = "1970-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*+(?:>.*?(?:</\1\s*>|\Z)|\Z)", re.S | re.I)
_TAG = re.compile(r"<(?:/?([a-zA-Z][a-zA-Z0-9]*)|[/!?])[^>]*+(>?)")
_BLOCKS = frozenset("p div br h1 h2 h3 h4 h5 h6 li ul ol tr table nav article section header footer title blockquote pre hr body head".split())
_TITLE = re.compile(r"<title[^>]*+(?:>(.*?)(?:(</title)|\Z)|\Z)", re.S | re.I)
_HTML, _LANG = re.compile(r"<html[^>]*+", re.I), re.compile(r"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_ANCHOR, _HREF = re.compile(r"<a\b[^>]*+", re.I), re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
SNIFF = 1024
_META = re.compile(rb"<meta\b[^>]*+", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)


def plain_text(page: str) -> str:
    """The text of a page: no comments, scripts or styles; a line for each block; entities resolved."""
    body = _TAG.sub(lambda m: "\n" if m[2] and (m[1] or "").lower() in _BLOCKS else "", _SKIP.sub(" ", page))
    lines = (" ".join(x.split()) for x in html_entities.unescape(body).split("\n"))
    return "\n".join(x for x in lines if x)


def decoded(payload: bytes, content_type: str = "") -> str:
    """A payload as text, by the charset of its content type, or else of its first SNIFF bytes, where browsers look for it, or else of a meta tag anywhere."""
    named = _CHARSET.search(content_type) or _CHARSET.search(payload[:SNIFF].decode("ascii", "replace"))
    if not named:
        named = next((m for tag in _META.finditer(payload) if (m := _CHARSET.search(tag[0].decode("ascii", "replace")))), None)
    try:
        return payload.decode(named[1] if named else "utf-8")
    except (LookupError, UnicodeDecodeError):
        return payload.decode("utf-8", "replace")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind} {source}')}>"


def response_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'response {key}')}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record in the WARC/1.1 format."""
    clean = (f"{k}: {' '.join(v.splitlines())}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n" + "".join(clean).encode("utf-8", "surrogatepass") + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def inflated(data: bytes) -> bytes:
    """The contents of a file, gzip or not; a member that is cut short gives what it has."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            break
        data = member.unused_data
    return b"".join(out) if out else data


def _headers(lines: bytes) -> dict[str, str]:
    split = (x.split(":", 1) for x in lines.decode("utf-8", "surrogateescape").split("\r\n")[1:] if ":" in x)
    return {k.strip(): v.strip() for k, v in split}


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a WARC file's bytes, up to one that is cut short or has no length."""
    at = 0
    while (end := data.find(b"\r\n\r\n", at)) >= 0:
        headers = _headers(data[at:end])
        length = next((v for k, v in headers.items() if k.lower() == "content-length"), "")
        if not length.isdigit() or end + 4 + int(length) > len(data):
            return
        yield headers, data[end + 4 : end + 4 + int(length)]
        at = end + 4 + int(length) + 4


def derive(source_id: str, target: str, date: str, payload: bytes | str, payload_digest: str | None = None, source_headers: dict[str, str] | None = None, http_headers: dict[str, str] | None = None) -> list[dict]:
    """The metadata and conversion record of one response."""
    raw = payload.encode("utf-8", "surrogatepass") if isinstance(payload, str) else payload
    kind_of = next((v for k, v in (http_headers or {}).items() if k.lower() == "content-type"), "")
    page = payload if isinstance(payload, str) else decoded(raw, kind_of)
    payload_digest, text = payload_digest or digest(raw), plain_text(page)
    title, html = _TITLE.search(page), _HTML.search(page)
    lang = _LANG.search(html[0]) if html else None
    links = ["".join(x or "" for x in h.groups()) for m in _ANCHOR.finditer(page) if (h := _HREF.search(m[0]))]
    about = {
        "title": html_entities.unescape(" ".join(title[1].split())) if title and title[2] else None, "lang": lang[1] if lang else None,
        "links": links, "text_chars": len(text), "payload_bytes": len(raw),
    }
    if source_headers or http_headers:
        about |= {"source_headers": source_headers or {}, "http_headers": http_headers or {}}
    out = []
    for kind, content_type, block in (
        ("metadata", "application/json", json.dumps(about, ensure_ascii=False, sort_keys=True)),
        ("conversion", "text/plain; charset=utf-8", text),
    ):
        data = block.encode("utf-8", "surrogatepass")
        out.append({
            "record_type": kind, "record_id": derived_id(source_id, kind), "refers_to": source_id, "target_uri": target, "date": date,
            "content_type": content_type, "block_digest": digest(data), "source_payload_digest": payload_digest,
            "content_length": len(data), "block": block,
        })
    return out


def record_bytes(r: dict) -> bytes:
    """A derived record as written: source headers and digests kept, refers-to first."""
    headers = [
        ("WARC-Type", r["record_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Refers-To", r["refers_to"]),
        ("WARC-Target-URI", r["target_uri"]), ("WARC-Date", r["date"]), ("WARC-Block-Digest", r["block_digest"]),
        ("WARC-Source-Payload-Digest", r["source_payload_digest"]), ("Content-Type", r["content_type"]),
    ]
    return record(headers, r["block"].encode("utf-8", "surrogatepass"))


_OUT = (("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("block_digest", pa.string()), ("source_payload_digest", pa.string()), ("content_length", pa.int64()), ("block", pa.string()))


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 4):
            keys, rows, index = batch.column(0), [], []
            values = [batch.column(i).to_pylist() for i in range(1, batch.num_columns)]
            for i, x in enumerate(zip(*values)):
                new = derive(*x[:5], *(dict(h) if h else None for h in x[5:]))
                rows += new
                index += [i] * len(new)
            columns = [keys.take(pa.array(index, pa.int64())), *(pa.array([r[n] for r in rows], t) for n, t in _OUT)]
            yield pa.RecordBatch.from_arrays(columns, ["key", *(n for n, _ in _OUT)])


def derivatives(responses: DataFrame) -> DataFrame:
    """From (key, record_id, target_uri, date, payload as text or bytes) and, where known, (payload_digest, source_headers, http_headers): two rows a response, with all headers and the block."""
    kind = responses.schema["key"].dataType.simpleString()
    schema = f"key {kind}, " + ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in _OUT)
    more = ["payload_digest", "source_headers", "http_headers"] if "source_headers" in responses.columns else []
    return responses.select("key", "record_id", "target_uri", "date", "payload", *more).mapInArrow(_derived, schema)


def responses_of(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Pages as response records; a page's record id follows from its key, url and content."""
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    h = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, F.md5(text)))
    named = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    return pages.select(F.col("page_id").alias("key"), named.alias("record_id"), url.alias("target_uri"), F.lit(date).alias("date"), text.alias("payload"))


def _serialised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, batch_column(whole)):
            yield pa.RecordBatch.from_arrays([pa.array([record_bytes(r) for r in batch.to_pylist()], pa.binary())], ["record"])


def batch_column(batch: pa.RecordBatch) -> int:
    return batch.schema.names.index("block")


def to_records(derived: DataFrame) -> DataFrame:
    """Each record in its written form, as one binary column `record`; files are these, one after the other."""
    return derived.mapInArrow(_serialised, "record binary")


_READ = "key string, record_id string, target_uri string, date string, payload binary, payload_digest string, source_headers map<string,string>, http_headers map<string,string>"
_MAP = pa.map_(pa.string(), pa.string())


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0).to_pylist():
            for headers, block in parse(inflated(data or b"")):
                get = {k.lower(): v for k, v in headers.items()}.get
                if get("warc-type") != "response":
                    continue
                head, _, body = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
                row = (get("warc-record-id", ""), get("warc-record-id", ""), get("warc-target-uri", ""), get("warc-date", ""), body, get("warc-payload-digest"))
                maps = ([(k, v.encode("utf-8", "replace").decode()) for k, v in m.items()] for m in (headers, _headers(head)))
                types = (*(pa.string(),) * 4, pa.binary(), pa.string(), _MAP, _MAP)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*row, *maps), types)], [f.split()[0] for f in _READ.split(", ")])


def read_responses(files: DataFrame) -> DataFrame:
    """Response records of WARC contents (a DataFrame of the binaryFile reader, or any with a binary `content`), with their headers, digest and bytes as they are."""
    return files.select("content").mapInArrow(_parsed, _READ)
