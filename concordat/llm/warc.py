"""Derivatives of web archive records: linked metadata and plain-text conversions.

A *response* record holds a page as it was served.  The builder makes two records of each: a
*metadata* record of JSON (the source's headers, digests, title and links) and a *conversion*
record of its plain text.  Both refer to the response by ``WARC-Refers-To`` and keep its target,
date and payload digest; their own identifiers follow from the source's, so a run that is
repeated writes the same records.

Records travel as their bytes in WARC 1.1 form, which ``to_bytes`` writes and ``records``
reads; columns of fields are taken from those bytes.
"""

from __future__ import annotations

import base64
import hashlib
import html as html_lib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import batch, pieces

VERSION = b"WARC/1.1"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the namespace of URLs in RFC 9562
_HIDDEN = re.compile(r"<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.S | re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.S | re.I)
_LINK = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_BREAK = re.compile(
    r"</?(?:p|div|article|section|header|footer|nav|aside|main|ul|ol|li|table|tr|h[1-6]|blockquote|pre|form|br|hr|title|body|head|html)\b[^>]*>",
    re.I,
)
_MARKUP = re.compile(r"<[!/?a-zA-Z][^>]*>")


@dataclass
class Record:
    """A record: its named fields in order, and its block."""

    fields: list[tuple[str, str]]
    block: bytes

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.fields if k.lower() == name.lower()), None)


def digest(data: bytes) -> str:
    """A labelled digest as archives write it: SHA-1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def to_bytes(record: Record) -> bytes:
    """A record in WARC form.  Line ends in field values become spaces."""
    lines = [f"{k}: {' '.join(v.split(chr(13)))}".replace("\n", " ") for k, v in record.fields if k.lower() != "content-length"]
    head = "\r\n".join([VERSION.decode(), *lines, f"Content-Length: {len(record.block)}"])
    return head.encode("utf-8", "replace") + b"\r\n\r\n" + record.block + b"\r\n\r\n"


def records(data: bytes) -> Iterator[Record]:
    """The records of a file's bytes, in turn; a malformed record ends the reading with an error."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        fields: list[tuple[str, str]] = []
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            if line[:1] in (" ", "\t") and fields:
                fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
            else:
                name, _, value = line.partition(":")
                fields.append((name.strip(), value.strip()))
        size = int(next(v for k, v in fields if k.lower() == "content-length"))
        at = end + 4
        if at + size > len(data):
            raise ValueError("a record is cut off")
        yield Record(fields, data[at : at + size])
        at += size + 4


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


def response(page_id: int | None, url: str | None, page: str | None, date: str = "1970-01-01T00:00:00Z") -> Record:
    """The response record of a page; a null url or page counts as empty."""
    payload = (page or "").encode("utf-8", "replace")
    block = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    )
    fields = [
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(page_id), url or "", digest(payload))),
        ("WARC-Target-URI", url or ""), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)),
    ]
    return Record(fields, block)


def payload_of(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, payload) of an HTTP response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    return status, [(n.strip(), v.strip()) for n, _, v in (line.partition(":") for line in lines)], payload


def plain_text(page: str) -> str:
    """The visible text: scripts, styles and comments go, block elements end lines, references are decoded."""
    text = _BREAK.sub("\n", _HIDDEN.sub(" ", page))
    lines = (" ".join(html_lib.unescape(line).split()) for line in _MARKUP.sub("", text).split("\n"))
    return "\n".join(line for line in lines if line)


def by_name(fields: list[tuple[str, str]]) -> dict[str, str | list[str]]:
    """The values by name, in order; a name that comes several times, in any case of letters, has a list."""
    out: dict[str, list[str]] = {}
    first: dict[str, str] = {}
    for k, v in fields:
        out.setdefault(first.setdefault(k.lower(), k), []).append(v)
    return {k: v[0] if len(v) == 1 else v for k, v in out.items()}


def derivatives(source: Record) -> tuple[Record, Record]:
    """The metadata and conversion records of a response."""
    status, headers, payload = payload_of(source.block)
    page = payload.decode("utf-8", "replace")
    seen = _HIDDEN.sub(" ", page)
    title = _TITLE.search(seen)
    origin = source.get("WARC-Record-ID") or ""
    about = {
        "Envelope": {
            "WARC-Header-Metadata": by_name(source.fields),
            "Payload-Metadata": {
                "HTTP-Response-Metadata": {
                    "Response-Message": status, "Headers": by_name(headers), "Entity-Length": len(payload),
                    "Entity-Digest": digest(payload),
                    "HTML-Metadata": {
                        "Title": " ".join(html_lib.unescape(title[1]).split()) if title else None,
                        "Links": [html_lib.unescape(a or b or c) for a, b, c in _LINK.findall(seen)],
                    },
                }
            },
        }
    }
    shared = [
        ("WARC-Refers-To", origin), ("WARC-Target-URI", source.get("WARC-Target-URI") or ""),
        ("WARC-Date", source.get("WARC-Date") or ""), ("WARC-Refers-To-Payload-Digest", source.get("WARC-Payload-Digest") or ""),
    ]

    def made(kind: str, content_type: str, block: bytes) -> Record:
        own = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, origin)), *shared]
        return Record([*own, ("Content-Type", content_type), ("WARC-Block-Digest", digest(block))], block)

    return (
        made("metadata", "application/json", json.dumps(about, ensure_ascii=False).encode("utf-8", "replace")),
        made("conversion", "text/plain; charset=utf-8", plain_text(page).encode("utf-8", "replace")),
    )


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, warc): the response record of each row of ``pages`` (page_id, url, html)."""
    out = pa.schema([("page_id", pa.int64()), ("warc", pa.binary())])

    def work(batches):
        for b in pieces(batches, 256):
            made = [to_bytes(response(*r)) for r in zip(*(b.column(i).to_pylist() for i in range(3)))]
            yield batch(out, b.column(0), made)

    chosen = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return chosen.mapInArrow(work, "page_id long, warc binary")


def derived(sources: DataFrame) -> DataFrame:
    """(page_id, source, metadata, conversion): the derivatives of the response records in ``warc``.

    ``warc`` may hold several records; each response gives a row, other records and nulls give
    none.  All three are records in WARC form.
    """
    out = pa.schema([("page_id", pa.int64()), ("source", pa.binary()), ("metadata", pa.binary()), ("conversion", pa.binary())])

    def work(batches):
        for b in pieces(batches, 256):
            rows = []
            for page_id, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for r in records(data or b""):
                    if r.get("WARC-Type") == "response":
                        rows.append((page_id, to_bytes(r), *map(to_bytes, derivatives(r))))
            if rows:
                yield batch(out, *(list(c) for c in zip(*rows)))

    return sources.select("page_id", "warc").mapInArrow(
        work, "page_id long, source binary, metadata binary, conversion binary"
    )


def linked(derivs: DataFrame) -> DataFrame:
    """The identifiers, links and digests of ``derived`` records, read from the records themselves.

    ``record_headers``, ``http_headers`` and ``links`` are JSON texts of what the metadata record has.
    """
    names = [
        "page_id", "target_uri", "source_id", "metadata_id", "conversion_id", "metadata_refers_to", "conversion_refers_to",
        "payload_digest", "metadata_payload_digest", "conversion_payload_digest", "title", "n_links", "text", "text_digest",
        "record_headers", "http_headers", "links",
    ]
    kinds = ["page_id long", *[f"{n} string" for n in names[1:11]], "n_links long", *[f"{n} string" for n in names[12:]]]
    out = pa.schema([(n, pa.int64() if n in ("page_id", "n_links") else pa.string()) for n in names])

    def work(batches):
        for b in pieces(batches, 256):
            rows = []
            for page_id, *three in zip(*(b.column(i).to_pylist() for i in range(4))):
                s, m, c = (next(records(x)) for x in three)
                envelope = json.loads(m.block)["Envelope"]
                http = envelope["Payload-Metadata"]["HTTP-Response-Metadata"]
                about = http["HTML-Metadata"]
                found = (envelope["WARC-Header-Metadata"], http["Headers"], about["Links"])
                rows.append((
                    page_id, c.get("WARC-Target-URI"), s.get("WARC-Record-ID"), m.get("WARC-Record-ID"), c.get("WARC-Record-ID"),
                    m.get("WARC-Refers-To"), c.get("WARC-Refers-To"), s.get("WARC-Payload-Digest"),
                    m.get("WARC-Refers-To-Payload-Digest"), c.get("WARC-Refers-To-Payload-Digest"), about["Title"],
                    len(about["Links"]), c.block.decode(), c.get("WARC-Block-Digest"),
                    *(json.dumps(x, ensure_ascii=False) for x in found),
                ))
            if rows:
                yield batch(out, *(list(c) for c in zip(*rows)))

    return derivs.mapInArrow(work, ", ".join(kinds))
