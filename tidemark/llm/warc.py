"""WARC derivative builder: metadata and plain-text conversion records from response records.

A record is a row: record_id, record_type, target_uri, record_date, refers_to, content_type,
headers (the source's HTTP header lines), payload_digest, block_digest, content_length, block.
Everything is a projection, so the build streams at scan speed and never shuffles.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table

DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: (pattern, replacement), in order, that turn HTML into text; the syntax is common to Java's and RE2's regular expressions.
TO_TEXT = [
    (r"(?is)<!--.*?-->", ""),
    (r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>|<title\b.*?</title\s*>", ""),
    (r"(?is)<(br|/?p|/?div|/?li|/?ul|/?ol|/?tr|/?table|/?h[1-6]|/?article|/?section|/?nav|/?header|/?footer|/?main|/?blockquote|/?pre)\b[^>]*>", "\n"),
    (r"(?s)<[!/?a-zA-Z][^>]*>", ""),
    (r"[ \t\r\f]+", " "),
    (r" ?\n[ \n]*", "\n"),
    (r"^[ \n]+|[ \n]+$", ""),
]
#: The rules for tags as Spark runs them: one look at `<` before any alternative.
TAGS = [
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<(?:script\b.*?</script\s*>|style\b.*?</style\s*>|noscript\b.*?</noscript\s*>|template\b.*?</template\s*>|title\b.*?</title\s*>)", ""),
    (r"(?i)<(?:br|/?(?:p|div|li|ul|ol|tr|table|h[1-6]|article|section|nav|header|footer|main|blockquote|pre))\b[^>]*+>", "\n"),
    (r"<[!/?a-zA-Z][^>]*+>", ""),
]
#: Named references that SQL decodes one by one, `&` last; the fixed values of HTML.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&laquo;", "«"), ("&raquo;", "»"), ("&amp;", "&")]
FIELDS = ["record_id", "record_type", "target_uri", "record_date", "refers_to", "content_type", "headers", "payload_digest", "block_digest", "content_length", "block"]


def named_references() -> dict[str, str]:
    """HTML's named references by name, from the standard library's table, the common ones first; a no-break space counts as a space."""
    common = {name[1:-1]: into for name, into in reversed(ENTITIES) if "#" not in name}
    return common | {name: chr(code) for name, code in sorted(name2codepoint.items()) if name not in common}


def decode_references(text: Column) -> Column:
    """text with named and numeric character references replaced, each once; what is no known reference stays as it is."""
    table_ = F.create_map(*[F.lit(x) for pair in named_references().items() for x in pair])

    def one(piece: Column) -> Column:
        name = F.substring_index(piece, ";", 1)
        code = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, 3, 8), 16, 10)).otherwise(F.substring(name, 2, 8)).cast("int")
        valid = name.rlike("^#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6})$") & (((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF)))
        # UTF-32 of the code point, eight hexadecimal digits
        numeric = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        made = F.when(name.startswith("#"), numeric).otherwise(F.try_element_at(table_, name))
        found = F.when(piece.contains(";"), F.concat(made, F.substring(piece, F.length(name) + 2, F.length(piece))))
        return F.coalesce(found, F.concat(F.lit("&"), piece))

    parts = F.split(text, "&")
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), one)
    return F.when(text.contains("&"), F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))).otherwise(text)


def without_tags(html: Column) -> Column:
    """A page's text with its tags replaced, white space as it was."""
    for pattern, into in TAGS:
        html = F.regexp_replace(html, pattern, into)
    return html


def folded_lines(text: Column) -> Column:
    """Runs of white space in a line as one space, lines trimmed, empty ones dropped."""
    uneven = text.contains("  ") | text.contains("\t") | text.contains("\r") | text.contains("\f")
    even = F.when(uneven, F.regexp_replace(text, r"[ \t\r\f]+", " ")).otherwise(text)
    return F.array_join(F.filter(F.transform(F.split(even, "\n"), lambda line: F.btrim(line, F.lit(" "))), lambda line: line != ""), "\n")


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def record_uuid(*what: Column) -> Column:
    """A urn:uuid made of the hash of what, so a rebuild gives the same ids."""
    h = F.md5(F.concat_ws("\n", *[F.coalesce(x.cast("string"), F.lit("")) for x in what]))
    at = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in at]), F.lit(">"))


def responses(pages: DataFrame, date: str = DATE, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Response records of crawled pages (url, html): an HTTP head and the page. A null html is an empty page, a null url an empty one."""
    block = F.concat(F.lit(HTTP_HEAD), F.coalesce("html", F.lit("")))
    url = F.coalesce("url", F.lit(""))
    key = [F.col(k) for k in keep]
    out = pages.select(*keep, url.alias("target_uri"), F.lit(date).alias("record_date"), block.alias("block"))
    return out.withColumn("record_id", record_uuid(F.lit("response"), *key, F.col("target_uri"), F.col("record_date")))


def build_derivatives(source: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """A metadata and a conversion record of each response record (record_id, target_uri, record_date, block).

    Both refer to the response by id, keep its address, date, HTTP header lines and payload digest,
    and carry digests of their own blocks. A block without an end of headers has no headers and is
    payload throughout; a null block is an empty one. Repeated rows give repeated records with equal
    ids. Columns other than keep and the four read are dropped, so clashing names do no harm.
    """
    base = source.select(*keep, "record_id", "target_uri", "record_date", F.coalesce("block", F.lit("")).alias("raw"))
    cut = F.instr("raw", "\r\n\r\n")
    base = base.withColumns({"head": F.when(cut > 0, F.col("raw").substr(F.lit(1), cut - 1)).otherwise(""), "payload": F.when(cut > 0, F.col("raw").substr(cut + 4, F.length("raw"))).otherwise(F.col("raw"))})
    lines = F.filter(F.split("head", "\r\n"), lambda x: x != "")
    source_digests = base.withColumns({"headers": lines, "payload_digest": digest(F.col("payload")), "source_digest": digest(F.col("raw")), "untagged": without_tags(F.col("payload"))})
    source_digests = source_digests.withColumn("lines", folded_lines(F.col("untagged")))
    text = decode_references(F.col("lines"))
    title = F.trim(F.regexp_replace(F.regexp_extract("payload", r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1), r"\s+", " "))
    note = F.concat_ws(
        "\r\n",
        F.concat(F.lit("status: "), F.coalesce(F.get("headers", F.lit(0)), F.lit(""))),
        F.concat(F.lit("title: "), title),
        F.concat(F.lit("sourceBlockDigest: "), F.col("source_digest")),
        F.concat(F.lit("sourceContentLength: "), F.octet_length("raw").cast("string")),
        F.lit(""),
    )
    both = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), note.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), text.alias("block")),
    )
    made = source_digests.select(*keep, F.col("record_id").alias("refers_to"), "target_uri", "record_date", "headers", "payload_digest", F.explode(both).alias("r"))
    made = made.select(*keep, "refers_to", "target_uri", "record_date", "headers", "payload_digest", "r.record_type", "r.content_type", "r.block")
    made = made.withColumns({"record_id": record_uuid(F.col("record_type"), F.col("refers_to")), "block_digest": digest(F.col("block")), "content_length": F.octet_length("block").cast("long")})
    return made.select(*keep, *FIELDS)


def to_warc(records: DataFrame) -> DataFrame:
    """records with warc: the record as it stands in a WARC/1.1 file, header lines first. Line ends inside a header value are written %0D and %0A, so no value can start a line of its own."""
    safe = lambda value: F.replace(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.concat(F.lit(name + ": "), safe(value), F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Date", F.col("record_date")),
        line("WARC-Source-Payload-Digest", F.col("payload_digest")),
        line("WARC-Block-Digest", F.col("block_digest")),
        F.array_join(F.transform("headers", lambda h: line("WARC-Source-Header", h)), ""),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.col("content_length")),
    )
    return records.withColumn("warc", F.concat(head, F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n")))


def op2_warc(spark, sf_dir: str) -> DataFrame:
    made = build_derivatives(responses(table(spark, sf_dir, "pages")))
    return made.withColumn("headers", F.array_join("headers", "\n"))


def op2_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    text = "payload"
    for pattern, into in TO_TEXT:
        text = f"regexp_replace({text}, {q(pattern)}, {q(into)}, 'g')"
    for name, into in ENTITIES:
        text = f"replace({text}, {q(name)}, {q(into)})"
    crlf = "chr(13) || chr(10)"
    uuid = lambda x: f"'<urn:uuid:' || regexp_replace(md5({x}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') || '>'"
    head = " || ".join(f"'{x}'" if i % 2 == 0 else crlf for i, x in enumerate(HTTP_HEAD.replace("\r\n", "\0\r\n\0").split("\0")) if x)
    status, kind = HTTP_HEAD.split("\r\n")[:2]
    return f"""WITH a AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload, {head} || coalesce(html, '') AS raw FROM pages),
b AS (SELECT *, {uuid(f"'response' || chr(10) || page_id || chr(10) || target_uri || chr(10) || '{DATE}'")} AS refers_to,
trim(regexp_replace(regexp_extract(payload, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1), '\\s+', ' ', 'g')) AS title FROM a),
c AS (SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type, 'status: {status}' || {crlf} || 'title: ' || title || {crlf} || 'sourceBlockDigest: sha256:' || sha256(raw) || {crlf} || 'sourceContentLength: ' || strlen(raw) || {crlf} AS block FROM b
UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', {text} FROM b)
SELECT page_id, {uuid("record_type || chr(10) || refers_to")} AS record_id, record_type, target_uri, '{DATE}' AS record_date, refers_to, content_type,
'{status}' || chr(10) || '{kind}' AS headers, 'sha256:' || sha256(payload) AS payload_digest, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length, block FROM c"""
