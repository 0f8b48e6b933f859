"""WARC derivatives: metadata and plain-text conversion records linked to the responses they come from."""

from __future__ import annotations

import base64
import hashlib
import html as html_entities
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
#: The date of responses whose source has none.
UNKNOWN_DATE = "1970-01-01T00:00:00Z"
#: Elements whose content is no text, and those that end a line; fixed values of HTML.
HIDDEN = ("script", "style", "template", "noscript", "svg", "iframe", "textarea")
BREAKS = frozenset(
    "address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hr html li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_NAME = re.compile(r"/?\s*([A-Za-z][A-Za-z0-9-]*)")
# Looked for in the page as it is: letters may change their number in lower case.
_CLOSING = {name: re.compile(f"</{name}", re.IGNORECASE | re.ASCII) for name in HIDDEN}
_LINK = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9._-]+)", re.IGNORECASE)
_SPACES = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    """A name-based identifier: the same record always has the same one."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join('' if p is None else str(p) for p in parts))}>"


def parse_html(page: str) -> tuple[str, str, list[str]]:
    """(text, title, link targets) in one pass from left to right. An element or comment that is not closed reaches to the end."""
    out, links, title, at = [], [], "", 0
    title_from = None
    while True:
        tag = page.find("<", at)
        if tag < 0:
            out.append(page[at:])
            break
        out.append(page[at:tag])
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        found = _NAME.match(page, tag + 1)
        if not found and not page.startswith(("<!", "<?"), tag):
            out.append("<")  # no markup
            at = tag + 1
            continue
        end = page.find(">", tag)
        end = end + 1 if end >= 0 else len(page)
        at = end
        if not found:
            continue
        name, closing = found.group(1).lower(), page[tag + 1] == "/"
        if name in HIDDEN and not closing:
            close = _CLOSING[name].search(page, end)
            at = close.start() if close else len(page)
            continue
        if name == "a" and not closing:
            link = _LINK.search(page, tag, end)
            if link:
                links.append(html_entities.unescape(next(g for g in link.groups() if g is not None)))
        if name == "title":
            if not closing:
                title_from = len(out)
            elif title_from is not None and not title:
                title = " ".join(html_entities.unescape("".join(out[title_from:])).split())
        if name in BREAKS:
            out.append("\n")
    text = _LINES.sub("\n", _SPACES.sub(" ", html_entities.unescape("".join(out)).replace("\r", "\n"))).strip()
    return text, title, links


def _one_line(value: str) -> str:
    """A header value cannot hold line breaks."""
    return " ".join(value.split())


def _record(kind: str, own: str, date: str, uri: str | None, content_type: str, block: bytes, more: list[tuple[str, str | None]]) -> dict:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", uri and _one_line(uri)), *more,
              ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    head = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v)
    return {"record_type": kind, "record_id": own, "target_uri": uri, "date": date, "content_type": content_type, "content_length": len(block),
            "block_digest": digest(block), "header": head, "block": block.decode("utf-8", "replace")}


_RECORD = "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length bigint, block_digest string, payload_digest string, header string, block string"
_NAMES = [field.split()[0] for field in _RECORD.split(", ")]


def responses(pages: DataFrame, date: str = UNKNOWN_DATE) -> DataFrame:
    """Response records of ``pages`` (page_id, url, html): page_id, record_id, target_uri, date, block (binary), payload_digest.

    The block is the HTTP message. A null page has an empty body, a null url no target. Equal rows are the same record.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))

    def run(batches):
        for batch in batches:
            urls, blocks = batch.column("target_uri").to_pylist(), batch.column("block").to_pylist()
            ids = [record_id("response", page, url, hashlib.sha256(block).hexdigest()) for page, url, block in zip(batch.column("page_id").to_pylist(), urls, blocks)]
            digests = [digest(block.partition(b"\r\n\r\n")[2]) for block in blocks]
            columns = [batch.column("page_id"), pa.array(ids), batch.column("target_uri"), pa.array([date] * len(ids), pa.string()), batch.column("block"), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "record_id", "target_uri", "date", "block", "payload_digest"])

    kind = pages.schema["page_id"].dataType.simpleString()
    made = pages.select("page_id", F.col("url").cast("string").alias("target_uri"), F.concat(head, body).cast("binary").alias("block"))
    return made.mapInArrow(run, f"page_id {kind}, record_id string, target_uri string, date string, block binary, payload_digest string")


def _derive(block: bytes | None, own: str, uri: str | None, date: str | None, known: str | None):
    head, cut, body = (block or b"").partition(b"\r\n\r\n")
    if not cut:
        head, body = b"", block or b""
    status, *lines = head.decode("latin-1").split("\r\n")
    source = [(k.strip(), _one_line(v)) for k, colon, v in (line.partition(":") for line in lines) if colon]
    kind = next((v for k, v in source if k.lower() == "content-type"), "")
    charset = _CHARSET.search(kind)
    try:
        page = body.decode(charset.group(1) if charset else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    is_html = not kind or "html" in kind.lower()
    text, title, links = parse_html(page) if is_html else (page.strip(), "", [])
    date, payload = date or UNKNOWN_DATE, known or digest(body)
    linked = [("WARC-Refers-To", own), ("WARC-Refers-To-Target-URI", uri and _one_line(uri)), ("WARC-Refers-To-Date", date)]
    plain = text.encode("utf-8", "replace")
    converted = record_id("conversion", own)
    conversion = _record("conversion", converted, date, uri, "text/plain; charset=utf-8", plain, [*linked, ("WARC-Payload-Digest", digest(plain))])
    conversion |= {"payload_digest": digest(plain)}
    facts = [("source-payload-digest", payload), ("source-block-digest", digest(block or b"")), ("source-status", _one_line(status)), *[(f"source-header-{k.lower()}", v) for k, v in source],
             ("conversion-record-id", converted), ("conversion-payload-digest", digest(plain)), ("title", title), *[("outlink", _one_line(link)) for link in links]]
    fields = "".join(f"{k}: {v}\r\n" for k, v in facts if v).encode("utf-8", "replace")
    metadata = _record("metadata", record_id("metadata", own), date, uri, "application/warc-fields", fields, linked) | {"payload_digest": payload}
    return [metadata | {"refers_to": own}, conversion | {"refers_to": own}]


def derivatives(found: DataFrame) -> DataFrame:
    """Two records for each of the responses ``found`` (page_id, record_id, target_uri, date, block, payload_digest).

    ``metadata`` holds the source's status line, headers and digests, the title and the outlinks; ``conversion`` is the plain text. Both name the
    response in ``refers_to``; ``payload_digest`` is that of the source for metadata and of the text for conversions. A block without
    an HTTP head is taken as the page, a null one as empty; bytes that are no text in the charset given are replaced. Repeated responses
    give repeated records. Other columns are ignored; an empty table gives no rows.
    """
    kind = found.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, pages = [], []
            for row in batch.select(["record_id", "target_uri", "date", "block", "payload_digest"]).to_pylist():
                rows += _derive(row["block"], row["record_id"], row["target_uri"], row["date"], row["payload_digest"])
            pages = batch.column("page_id").take(pa.array([i // 2 for i in range(len(rows))], pa.int64()))
            kinds = {name: pa.int64() if name == "content_length" else pa.string() for name in _NAMES}
            columns = [pa.array([row[name] for row in rows], kinds[name]) for name in _NAMES]
            yield pa.RecordBatch.from_arrays([pages, *columns], ["page_id", *_NAMES])

    return found.select("page_id", "record_id", "target_uri", "date", "block", "payload_digest").mapInArrow(run, f"page_id {kind}, {_RECORD}")


def write_warc(records: DataFrame, path: str) -> None:
    """Writes records as gzipped WARC files; the two line breaks after a record are Spark's line separator."""
    whole = records.select(F.concat("header", F.lit("\r\n"), "block").alias("value"))
    whole.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
