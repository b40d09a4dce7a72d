"""WARC derivatives: each response record gives a metadata record and a plain-text conversion record.

Both name the response (``refers_to``), its target, date and digest, and each other (``concurrent_to``), so
derivatives can be checked against their source without it. Records are made in one pass over the responses,
without a shuffle; ids are functions of the source record's id, so a repeated task makes the same records.
"""

import base64
import hashlib
import html
import json
import re
import uuid

from pyspark.sql import functions as F

from .textops import slices

DATE = "2024-01-01T00:00:00Z"
RECORD = (
    "warc_type string, record_id string, refers_to string, concurrent_to string, target_uri string, warc_date string, content_type string,"
    " source_digest string, block_digest string, content_length long, block string"
)

_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
_BLOCK = re.compile(
    r"</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|table|tr|td|th|thead|tbody|section|article|aside|header|footer|nav|main|form|pre|blockquote|figure|title|head|body|html|option|address)\b[^>]*>",
    re.I,
)
_TAG = re.compile(r"</?[a-zA-Z][^>]*>|<![a-zA-Z][^>]*>|<\?[^>]*>")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.I | re.S)
_LINK = re.compile(r"""<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_META = re.compile(r"<meta\s[^>]*>", re.I)
_BLANKS = re.compile(r"[^\S\n]+")


def responses(pages, url="url", body="html", keys=("page_id",), date=DATE):
    """Response records of a table of pages: ``record_id, target_uri, warc_date, http, payload`` and the ``keys``.

    The id is a function of address and body, so equal rows are one capture that is told twice, with one id. A null
    address is an empty target, a null body an empty payload.
    """
    u, b = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (url, body))
    mark = F.sha2(F.concat_ws("\n", F.lit(date), u, b), 256)
    name = F.concat_ws("-", *(F.substring(mark, p, n) for p, n in ((1, 8), (9, 4))), F.concat(F.lit("8"), F.substring(mark, 14, 3)), F.concat(F.lit("a"), F.substring(mark, 18, 3)), F.substring(mark, 21, 12))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(b).cast("string"), F.lit("\r\n"))
    return pages.select(*keys, F.concat(F.lit("<urn:uuid:"), name, F.lit(">")).alias("record_id"), u.alias("target_uri"), F.lit(date).alias("warc_date"), head.alias("http"), b.alias("payload"))


def derive(records, keys=()):
    """Metadata and conversion records (``RECORD``) of response records (``record_id, target_uri, warc_date, http, payload``).

    ``keys`` names columns that both records of a response carry. The payload is text; null counts as empty. HTML
    becomes text line by line, other ``text/*`` is kept as it is, and what is no text has a metadata record only.
    Malformed HTML never fails: an unclosed comment or script runs to the end, a tag ends at the next ``>``.
    """
    used = ["record_id", "target_uri", "warc_date", "http", "payload"]
    shape = ", ".join([*(f"`{k}` {records.schema[k].dataType.simpleString()}" for k in keys), RECORD])
    return records.select(*keys, *used).mapInArrow(_derive(list(keys), shape), shape)


def write_warc(records, path):
    """Writes derived records as gzipped WARC files below ``path``, a record after the other."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"\r\n{name}: "), value)).otherwise(F.lit(""))
    head = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Source-Payload-Digest", "source_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    value = F.concat(F.lit("WARC/1.1"), *(line(name, F.col(c).cast("string")) for name, c in head), F.lit("\r\n\r\n"), F.col("block"))
    records.select(value.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def digest(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def html_text(markup):
    """The visible text of a page: block elements end lines, white space is collapsed, empty lines are left out."""
    text = _TAG.sub("", _BLOCK.sub("\n", _DROPPED.sub(" ", markup).replace("\n", " ")))
    lines = (_BLANKS.sub(" ", line).strip() for line in html.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def http_headers(text):
    """The status line and the headers of an HTTP message as a list of pairs, in order and as written."""
    lines = (text or "").replace("\r\n", "\n").split("\n")
    pairs = [line.split(":", 1) for line in lines[1:] if ":" in line]
    return lines[0], [(k.strip(), v.strip()) for k, v in pairs]


def _by_name(headers):
    """The value of each header, or the list of its values in order if it is repeated in whatever case."""
    names, values = {}, {}
    for name, value in headers:
        values.setdefault(names.setdefault(name.lower(), name), []).append(value)
    return {name: v if len(v) > 1 else v[0] for name, v in values.items()}


def _describe(source, status, headers, payload):
    found = {"Status": status, "Headers": _by_name(headers)}
    if payload is not None:
        bare = _DROPPED.sub(" ", payload)
        title = _TITLE.search(bare)
        found["HTML-Metadata"] = {
            "Title": html.unescape(title[1]).strip() if title else None,
            "Metas": len(_META.findall(bare)),
            "Links": [html.unescape(a or b or c) for a, b, c in _LINK.findall(bare)],
        }
    return json.dumps({"Envelope": {"WARC-Header-Metadata": source, "Payload-Metadata": {"HTTP-Response-Metadata": found}}}, ensure_ascii=False)


def _records(record_id, target, date, http, payload):
    """The derivatives of one response, as tuples in the order of ``RECORD``."""
    payload, status_headers = payload or "", http_headers(http)
    status, headers = status_headers
    kind = next((v for k, v in headers if k.lower() == "content-type"), "").split(";")[0].strip().lower()
    is_html = kind in ("text/html", "application/xhtml+xml")
    source_digest = digest(payload.encode())
    base = record_id or ""
    ids = {k: f"<{uuid.uuid5(uuid.NAMESPACE_URL, base + '#' + k).urn}>" for k in ("metadata", "conversion")}
    source = {"WARC-Type": "response", "WARC-Record-ID": record_id, "WARC-Target-URI": target, "WARC-Date": date, "WARC-Payload-Digest": source_digest}
    text = html_text(payload) if is_html else payload if kind.startswith("text/") else None
    blocks = [("metadata", "application/json", _describe(source, status, headers, payload if is_html else None), ids["conversion"] if text is not None else None)]
    if text is not None:
        blocks.append(("conversion", "text/plain; charset=utf-8", text, ids["metadata"]))
    for warc_type, content_type, block, other in blocks:
        data = block.encode()
        yield warc_type, ids[warc_type], record_id, other, target, date, content_type, source_digest, digest(data), len(data), block


def _derive(keys, shape):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(shape))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "payload"):
                took, rows = [], []
                columns = [part[c].to_pylist() for c in ("record_id", "target_uri", "warc_date", "http", "payload")]
                for i, values in enumerate(zip(*columns, strict=True)):
                    made = list(_records(*values))
                    rows += made
                    took += [i] * len(made)
                own = [part[k].take(pa.array(took, pa.int64())) for k in keys]
                new = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[len(keys) :], strict=True)]
                if rows:
                    yield pa.record_batch([*own, *new], names=schema.names)

    return run
