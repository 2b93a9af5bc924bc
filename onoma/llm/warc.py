"""WARC derivative builder (operator 9).

``responses_from_pages`` lays a crawl table out as WARC response records.
``build_derivatives`` turns each response into two linked records:

* ``metadata``: the source headers and the payload's digest and length as
  warc-fields, ``WARC-Refers-To`` the response;
* ``conversion``: the page's plain text, ``WARC-Refers-To`` the response.

Both carry the response's target URI, date and digests. Identifiers are
name-based (a digest of type, source id and content), so reruns agree.
``record_text`` renders records, ``write_warc`` writes them as WARC files.
All expressions are built in: no shuffle, no Python, one pass over the rows.

A null payload is an empty one, a null url an empty target URI; a null id
stays a null ``page_id`` and is named ``null``. Repeated rows give repeated
(equal) records. Extra columns are ignored. An empty table gives no records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Date of records whose source has none.
EPOCH = "1970-01-01T00:00:00Z"

#: Patterns of the plain-text conversion, applied in this order.
DROPPED = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<nav\b.*?</nav\s*>|<footer\b.*?</footer\s*>"
BREAKS = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|title|header|blockquote|pre)\b[^>]*>"
TAGS = r"<[^>]*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def digest(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(data, 256))


def name_uuid(*parts: Column) -> Column:
    """A name-based record id: the first 128 bits of a SHA-256, as a URN."""
    h = F.sha2(F.concat_ws("|", *parts), 256)
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut]))


def plain_text(html: Column) -> Column:
    """Visible text: one line per block, runs of blanks collapsed, ends trimmed."""
    t = F.regexp_replace(html, DROPPED, " ")
    t = F.regexp_replace(t, r"[\x00-\x20]+", " ")
    t = F.regexp_replace(t, BREAKS, "\n")
    t = F.regexp_replace(t, TAGS, "")
    for name, char in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.regexp_replace(t, r" *\n[ \n]*", "\n")
    return F.regexp_replace(F.regexp_replace(t, " +", " "), r"^[ \n]+|[ \n]+$", "")


def responses_from_pages(pages: DataFrame) -> DataFrame:
    """``page_id, record_id, target_uri, warc_date, http_headers, payload``."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    uri = F.coalesce(F.col("url"), F.lit(""))
    headers = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length(payload).cast("string"),
    )
    pid = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    return pages.select(
        "page_id",
        name_uuid(F.lit("response"), pid, uri, F.sha2(payload, 256)).alias("record_id"),
        uri.alias("target_uri"),
        F.lit(EPOCH).alias("warc_date"),
        headers.alias("http_headers"),
        payload.alias("payload"),
    )


def build_derivatives(responses: DataFrame) -> DataFrame:
    """Two rows per response, ``metadata`` and ``conversion``.

    Columns: page_id, record_type, record_id, refers_to, target_uri,
    warc_date, content_type, source_headers, payload_digest (of the source),
    block_digest, content_length (bytes), block.
    """
    src = responses.select(
        "page_id",
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "warc_date",
        F.col("http_headers").alias("source_headers"),
        digest(F.col("payload")).alias("payload_digest"),
        F.octet_length("payload").alias("payload_length"),
        plain_text(F.col("payload")).alias("text"),
    )
    fields = F.concat(
        F.lit("fetch-status: "), F.regexp_extract("source_headers", r"^HTTP/[0-9.]+ ([0-9]{3})", 1),
        F.lit(f"{CRLF}source-content-type: "), F.regexp_extract("source_headers", r"(?i)content-type: *([^\r\n]*)", 1),
        F.lit(f"{CRLF}source-payload-digest: "), F.col("payload_digest"),
        F.lit(f"{CRLF}source-payload-length: "), F.col("payload_length").cast("string"),
        F.lit(f"{CRLF}text-digest: "), digest(F.col("text")),
        F.lit(CRLF),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    rows = src.select(*[c for c in src.columns if c not in ("text", "payload_length")], F.inline(kinds))
    return rows.select(
        "page_id", "record_type",
        name_uuid(F.col("record_type"), F.col("refers_to"), F.sha2("block", 256)).alias("record_id"),
        "refers_to", "target_uri", "warc_date", "content_type", "source_headers", "payload_digest",
        digest(F.col("block")).alias("block_digest"),
        F.octet_length("block").cast("long").alias("content_length"),
        "block",
    )


def record_text(r: DataFrame) -> DataFrame:
    """``value``: each record as WARC/1.1 text, without the closing blank lines."""
    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    angled = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    return r.select(
        F.concat(
            F.lit(f"WARC/1.1{CRLF}"),
            field("WARC-Type", F.col("record_type")),
            field("WARC-Record-ID", angled("record_id")),
            field("WARC-Refers-To", angled("refers_to")),
            field("WARC-Target-URI", F.col("target_uri")),
            field("WARC-Date", F.col("warc_date")),
            field("WARC-Payload-Digest", F.col("payload_digest")),
            field("WARC-Block-Digest", F.col("block_digest")),
            field("Content-Type", F.col("content_type")),
            field("Content-Length", F.col("content_length").cast("string")),
            F.lit(CRLF),
            F.col("block"),
        ).alias("value")
    )


def write_warc(records: DataFrame, path: str) -> None:
    """One gzip WARC file per task; the line separator closes each record."""
    record_text(records).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)
