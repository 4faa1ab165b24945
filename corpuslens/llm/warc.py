"""WARC derivatives: metadata and plain-text conversion records linked to response records.

From every response come two records that refer to it (``WARC-Refers-To``): a metadata record
(``application/warc-fields``) with the source's HTTP headers, digests, title and links, and with the id of
the conversion record; and a conversion record with the page as plain text.  Ids are name-based (a hash of
the source id and the kind), so that a task that runs again makes the same records.  All of it is column
arithmetic in one pass; nothing is shuffled.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPTURE_DATE = "1970-01-01T00:00:00Z"  # of pages that come without one
CRLF = "\r\n"
#: The references and links that the SQL knows; &amp; comes last there, so that nothing is decoded twice.
SQL_REFERENCES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "middot": "·", "copy": "©", "reg": "®", "hellip": "…",
    "ndash": "–", "mdash": "—", "laquo": "«", "raquo": "»", "euro": "€",
}
#: Every named character reference of HTML as it stands in a page; a space that does not break is a plain one.
REFERENCES = {f"&{name}": char for name, char in html5.items()} | {"&nbsp;": " ", "&nbsp": " "}
_WITHOUT_END = "|".join(sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n)))
PARTS = "[^&]+|&(?:[A-Za-z][A-Za-z0-9]*;|#[0-9]{2,7};|#[xX][0-9A-Fa-f]{2,6};|" + _WITHOUT_END + ")|&"
UNSEEN = [r"(?s)<!--.*?-->", r"(?is)<script\b.*?</script[^>]*>", r"(?is)<style\b.*?</style[^>]*>", r"(?is)<template\b.*?</template[^>]*>"]
BREAKS = r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
LINK = r"""(?i)<a[ \t\n\r\f][^>]*?href[ \t\n\r\f]*=[ \t\n\r\f]*(["'][^"'>]*["']|[^ \t\n\r\f"'>]+)"""
SQL_LINK = r"""(?i)<a[ \t\n\r\f][^>]*?href[ \t\n\r\f]*=[ \t\n\r\f]*["']([^"'>]*)["']"""
TITLE = r"(?is)<title[^>]*>(.*?)</title"
DECIMAL, HEXADECIMAL = "&#([0-9]{2,7});", "&#[xX]([0-9A-Fa-f]{2,6});"


def _decoded(text: Column) -> Column:
    """Character references replaced, each once; those of no character stay."""
    table = F.from_json(F.lit(json.dumps(REFERENCES)), "map<string,string>")  # a constant, folded once

    def number(part: Column) -> Column:
        hexadecimal = F.lower(F.substring(part, 3, 1)) == "x"
        digits = F.regexp_replace(part, "[^0-9A-Fa-f]", "")
        point = F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).cast("int")
        known = point.between(32, 0xD7FF) | point.between(0xE000, 0x10FFFF)
        return F.when(known, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")).otherwise(part)

    def decoded(part: Column) -> Column:
        return (
            F.when(~F.startswith(part, F.lit("&")) | (part == "&"), part).when(part == "&amp;", "&").when(part == "&nbsp;", " ")
            .when(F.startswith(part, F.lit("&#")), number(part)).otherwise(F.coalesce(F.try_element_at(table, part), part))
        )

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(PARTS), F.lit(0)), decoded), "")


def plain_text(html: Column) -> Column:
    """What a reader sees: no markup, a line per block, references decoded, spaces collapsed."""
    text = html
    for pattern in UNSEEN:
        text = F.regexp_replace(text, pattern, " ")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), "<[^>]*>", "")
    text = _decoded(text)
    text = F.regexp_replace(F.regexp_replace(text, "[ \\t\\r\\f\\x0B]+", " "), " ?\\n[ \\n]*", "\n")
    return F.regexp_replace(text, "^[ \\n]+|[ \\n]+$", "")


def _line(text: Column) -> Column:
    """A field's value on one line."""
    return F.trim(F.regexp_replace(text, "[ \\t\\r\\n\\f\\x0B]+", " "))


def record_id(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws("\n", *parts))
    cut = lambda a, n: F.substring(digest, a, n)
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12)))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses_of_pages(pages: DataFrame) -> DataFrame:
    """Response records (page_id, record_id, target_uri, date, http_headers, payload) of fetched pages.

    A null url or html is an empty one.  Repeated rows have one record id, as their content is one.
    """
    url, html = F.coalesce(pages["url"].cast("string"), F.lit("")), F.coalesce(pages["html"].cast("string"), F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), url.alias("target_uri"), html.alias("payload"))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF))
    own_id = record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), "target_uri", F.sha2("payload", 256))
    return rows.select("page_id", own_id.alias("record_id"), "target_uri", F.lit(CAPTURE_DATE).alias("date"), headers.alias("http_headers"), "payload")


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records of every response; columns other than those of a response are passed through.

    Columns: warc_type, record_id, refers_to, target_uri, date, content_type, block, content_length,
    block_digest, source_headers, source_block_digest, source_payload_digest.  Nulls count as empty.
    """
    own = ["record_id", "target_uri", "date", "http_headers", "payload"]
    made = ["warc_type", "refers_to", "content_type", "block", "content_length", "block_digest", "source_headers", "source_block_digest", "source_payload_digest"]
    passed = [c for c in responses.columns if c not in own + made]
    rows = responses.select(*[responses[c] for c in passed], *[F.coalesce(responses[c].cast("string"), F.lit("")).alias(f"own_{c}") for c in own])
    source = F.col("own_record_id")
    rows = rows.select(
        *passed, source, "own_target_uri", "own_date", "own_http_headers",
        _digest(F.concat("own_http_headers", F.lit(CRLF), "own_payload")).alias("whole"), _digest(F.col("own_payload")).alias("body"),
        plain_text(F.col("own_payload")).alias("text"), _line(F.regexp_extract("own_payload", TITLE, 1)).alias("title"),
        F.transform(F.regexp_extract_all("own_payload", F.lit(LINK), F.lit(1)), lambda u: _line(F.regexp_replace(u, "^[\"']|[\"']$", ""))).alias("links"),
        record_id(F.lit("metadata"), source).alias("metadata_id"), record_id(F.lit("conversion"), source).alias("conversion_id"),
    )
    statuses = F.filter(F.split("own_http_headers", "\r?\n"), lambda h: h != "")
    fields = F.concat(
        F.array(F.concat(F.lit("source-block-digest: "), "whole"), F.concat(F.lit("source-payload-digest: "), "body"), F.concat(F.lit("conversion: <"), "conversion_id", F.lit(">")), F.concat(F.lit("title: "), "title")),
        F.transform(statuses, lambda h: F.concat(F.lit("source-header: "), h)),
        F.transform("links", lambda u: F.concat(F.lit("outlink: "), u, F.lit(" L a/@href"))),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.col("metadata_id").alias("record_id"), F.lit("application/warc-fields").alias("content_type"), F.concat(F.array_join(fields, CRLF), F.lit(CRLF)).alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.col("conversion_id").alias("record_id"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    out = rows.select(*passed, F.inline(kinds), *["own_record_id", "own_target_uri", "own_date", "own_http_headers", "whole", "body"])
    return out.select(
        *passed, "warc_type", "record_id", F.col("own_record_id").alias("refers_to"), F.col("own_target_uri").alias("target_uri"), F.col("own_date").alias("date"),
        "content_type", "block", F.octet_length("block").cast("long").alias("content_length"), _digest(F.col("block")).alias("block_digest"),
        F.col("own_http_headers").alias("source_headers"), F.col("whole").alias("source_block_digest"), F.col("body").alias("source_payload_digest"),
    )


def record_text() -> Column:
    """A derivative as it stands in a WARC file."""
    named = {
        "WARC-Type": F.col("warc_type"), "WARC-Record-ID": F.concat(F.lit("<"), "record_id", F.lit(">")), "WARC-Refers-To": F.concat(F.lit("<"), "refers_to", F.lit(">")),
        "WARC-Target-URI": F.col("target_uri"), "WARC-Date": F.col("date"), "Content-Type": F.col("content_type"),
        "Content-Length": F.col("content_length").cast("string"), "WARC-Block-Digest": F.col("block_digest"),
    }
    lines = F.concat_ws(CRLF, F.lit("WARC/1.1"), *[F.concat(F.lit(f"{n}: "), v) for n, v in named.items()])
    return F.concat(lines, F.lit(CRLF * 2), F.col("block"), F.lit(CRLF * 2))


def _sql() -> str:
    """The query's rows in DuckDB SQL."""
    text = "html"
    for pattern in UNSEEN:
        text = f"regexp_replace({text}, '{pattern}', ' ', 'g')"
    text = f"regexp_replace(regexp_replace({text}, '{BREAKS}', chr(10), 'g'), '<[^>]*>', '', 'g')"
    for name, char in SQL_REFERENCES.items():
        quoted = char.replace("'", "''")
        text = f"replace({text}, '&{name};', '{quoted}')"
    for pattern, point in ((HEXADECIMAL, "CAST('0x' || {d} AS INT)"), (DECIMAL, "CAST({d} AS INT)")):
        point = point.format(d="regexp_replace(m, '[^0-9A-Fa-f]', '', 'g')")
        good = f"({point} BETWEEN 32 AND 55295 OR {point} BETWEEN 57344 AND 1114111)"
        found = f"list_filter(list_distinct(regexp_extract_all(s, '{pattern}', 0)), lambda m: {good})"
        text = f"(SELECT list_reduce(list_concat([s], {found}), lambda acc, m: replace(acc, m, chr({point}))) FROM (SELECT {text} AS s))"
    text = f"replace({text}, '&amp;', '&')"
    text = f"regexp_replace(regexp_replace({text}, '[ \\t\\r\\f\\x0B]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g')"
    text = f"regexp_replace({text}, '^[ \\n]+|[ \\n]+$', '', 'g')"
    line = "trim(regexp_replace({}, '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g'))"
    uuid = lambda d: f"'urn:uuid:' || concat_ws('-', {d}[1:8], {d}[9:12], {d}[13:16], {d}[17:20], {d}[21:32])"
    link = SQL_LINK.replace("'", "''")
    title = line.format(f"regexp_extract(html, '{TITLE}', 1)")
    nl = "(chr(13) || chr(10))"
    return f"""
WITH pages0 AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
source AS (
  SELECT *, 'HTTP/1.1 200 OK' || {nl} || 'Content-Type: text/html; charset=utf-8' || {nl} || 'Content-Length: ' || strlen(html) || {nl} AS headers,
         {uuid("md5(concat_ws(chr(10), 'response', coalesce(CAST(page_id AS VARCHAR), ''), url, sha256(html)))")} AS id FROM pages0),
parts AS (
  SELECT *, 'sha256:' || sha256(headers || {nl} || html) AS whole, 'sha256:' || sha256(html) AS body, {text} AS text, {title} AS title,
         list_transform(regexp_extract_all(html, '{link}', 1), lambda u: {line.format("u")}) AS links,
         {uuid("md5(concat_ws(chr(10), 'metadata', id))")} AS metadata_id, {uuid("md5(concat_ws(chr(10), 'conversion', id))")} AS conversion_id FROM source),
records AS (
  SELECT *, 'metadata' AS warc_type, metadata_id AS record_id, 'application/warc-fields' AS content_type,
         array_to_string(list_concat(['source-block-digest: ' || whole, 'source-payload-digest: ' || body, 'conversion: <' || conversion_id || '>', 'title: ' || title],
           list_transform(list_filter(string_split(headers, {nl}), lambda h: h <> ''), lambda h: 'source-header: ' || h),
           list_transform(links, lambda u: 'outlink: ' || u || ' L a/@href')), {nl}) || {nl} AS block FROM parts
  UNION ALL
  SELECT *, 'conversion', conversion_id, 'text/plain; charset=utf-8', text FROM parts)
SELECT page_id, warc_type, record_id, id AS refers_to, url AS target_uri, content_type, CAST(strlen(block) AS BIGINT) AS content_length,
       'sha256:' || sha256(block) AS block_digest, whole AS source_block_digest, body AS source_payload_digest,
       sha256(concat_ws({nl}, 'WARC/1.1', 'WARC-Type: ' || warc_type, 'WARC-Record-ID: <' || record_id || '>', 'WARC-Refers-To: <' || id || '>',
         'WARC-Target-URI: ' || url, 'WARC-Date: {CAPTURE_DATE}', 'Content-Type: ' || content_type, 'Content-Length: ' || strlen(block),
         'WARC-Block-Digest: sha256:' || sha256(block)) || {nl} || {nl} || block || {nl} || {nl}) AS record_sha256
FROM records"""


DERIVATIVES_SQL = _sql()
