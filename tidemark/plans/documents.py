"""Document queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import documents as D
from tidemark.sources.tables import read


def articles(spark, sf_dir):
    return D.article_text(read(spark, sf_dir, "pages")).select("page_id", "article", "truncated", "found")


def paragraph_blocks(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(D.paragraphs(F.regexp_replace("text", "\n", "\n\n"))).alias("p")).select("doc_id", "p.ordinal", "p.text")


PARAGRAPH_SQL = r"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n[ \t]*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM documents)
SELECT doc_id, CAST(i AS INT) AS ordinal, ps[i] AS text FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p)"""


def block_kinds(spark, sf_dir):
    """Kinds of Markdown blocks per document: lines of tables and paragraphs."""
    blocks = D.markdown_blocks(read(spark, sf_dir, "documents"), "doc_id")
    return D.dominant_type(blocks, "doc_id")


def number_facts(spark, sf_dir):
    """Numbers of each document: how many, and their sum, exact."""
    d = read(spark, sf_dir, "documents").select("doc_id", X.numbers(F.col("text")).alias("n"))
    total = F.aggregate("n", F.lit(0).cast("decimal(38,2)"), lambda a, x: (a + x.cast("decimal(38,2)")).cast("decimal(38,2)"))
    return d.select("doc_id", F.size("n").cast("long").alias("numbers"), total.cast("double").alias("total"))


def page_gate(spark, sf_dir):
    """OCR needs of pages: non-space characters outside tags, replacement characters among them, share of image markup in what is not other markup."""
    images = F.coalesce(F.aggregate(F.regexp_extract_all("html", F.lit("<img[^>]*>"), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x)), F.lit(0))
    text = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", ""), r"\s", "")
    shaped = read(spark, sf_dir, "pages").select("page_id", F.length(text).alias("chars"), F.regexp_count(text, F.lit("\ufffd")).alias("garbled"), (images / (images + F.length(text))).alias("image_share"))
    shaped = shaped.withColumns({"chars": F.coalesce("chars", F.lit(0)), "garbled": F.coalesce("garbled", F.lit(0)), "image_share": F.coalesce("image_share", F.lit(0.0))})
    return D.page_quality(shaped).select("page_id", "chars", "garbled", F.coalesce("need", F.lit("")).alias("need"))


GATE_SQL = r"""WITH p AS (SELECT page_id, coalesce(len(array_to_string(regexp_extract_all(html, '<img[^>]*>'), '')), 0) AS im, coalesce(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '\s', '', 'g'), '') AS t FROM pages), q AS (SELECT page_id, CAST(length(t) AS INT) AS chars, CAST(len(regexp_extract_all(t, chr(65533))) AS INT) AS garbled, im FROM p)
SELECT page_id, chars, garbled, CASE WHEN chars = 0 THEN 'NO_TEXT' WHEN im >= 0.5 * (im + chars) THEN 'IMAGE' WHEN chars < 40 THEN 'FEW_CHARS' WHEN garbled > 0.3 * chars THEN 'GARBLED' ELSE '' END AS need FROM q"""


def body_sizes(spark, sf_dir):
    """Body font of each order, its lines as spans: size from tax, characters from quantity."""
    s = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.round(F.col("l_tax") * 100) / 2 + 8).alias("size"), F.col("l_quantity").cast("long").alias("chars"))
    return D.body_font(s, "l_orderkey")


BODY_SQL = """WITH s AS (SELECT l_orderkey, round(round(l_tax * 100) / 2 + 8, 1) AS size, sum(CAST(l_quantity AS BIGINT)) AS chars FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, size AS body_size FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY chars DESC, size) = 1"""


def margins(spark, sf_dir):
    """Lines that many pages of a supplier share: orders as pages, return flags and ship status as lines."""
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") % 5).alias("page"), F.concat("l_returnflag", "l_linestatus", F.col("l_quantity").cast("int")).alias("text"), (F.col("l_linenumber") <= 2).alias("in_margin"))
    return D.repeated_margins(lines, "l_suppkey")


MARGIN_SQL = """WITH l AS (SELECT l_suppkey, l_orderkey % 5 AS page, l_returnflag || l_linestatus || CAST(l_quantity AS INT) AS text, l_linenumber <= 2 AS m FROM lineitem),
p AS (SELECT l_suppkey, count(DISTINCT page) AS pages FROM l GROUP BY 1 HAVING pages >= 3), s AS (SELECT l_suppkey, text, count(DISTINCT page) AS "on" FROM l WHERE m GROUP BY 1, 2)
SELECT l_suppkey, text, "on", pages FROM s JOIN p USING (l_suppkey) WHERE "on" >= pages * 0.6"""


def chunk_order(spark, sf_dir):
    c = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return D.chunk_ordinals(c, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "ordinal")


CHUNK_SQL = "SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS INT) AS ordinal FROM lineitem"


def table_sentences(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    header = F.array(*map(F.lit, ["size", "brand", "type"]))
    row = F.array((F.col("p_size") + 1990).cast("string"), F.col("p_brand"), F.col("p_type"))
    return p.select("p_partkey", D.table_sentence(F.col("p_name"), F.lit("mm"), header, row).alias("sentence"))


SENTENCE_SQL = "SELECT p_partkey, '表格：' || p_name || '；单位：mm；' || (p_size + 1990) || ' 年：brand ' || p_brand || '，type ' || p_type || '。' AS sentence FROM part"


def governance(spark, sf_dir):
    """Documents that hold prohibited terms."""
    d = read(spark, sf_dir, "documents").select("doc_id", D.prohibited(F.col("text"), ["disgusting", "worthless", "idiot", "scum", "trash"]).alias("t"))
    return d.filter(F.size("t") > 0).select("doc_id", F.array_join("t", ",").alias("terms"))


GOVERNANCE_SQL = "SELECT doc_id, terms FROM (SELECT doc_id, array_to_string(list_filter(['disgusting', 'worthless', 'idiot', 'scum', 'trash'], lambda x: contains(lower(text), x)), ',') AS terms FROM documents) WHERE terms <> ''"


def corpus_fingerprint(spark, sf_dir):
    """A digest per source of the hashes of all its documents; null texts count as empty ones."""
    d = read(spark, sf_dir, "documents").select("source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return D.ranged_digest(d, "source", "h")


FINGERPRINT_SQL = """WITH l AS (SELECT source, sha256(coalesce(text, '')) AS h, count(*) AS times FROM documents GROUP BY 1, 2),
r AS (SELECT source, substr(h, 1, 3) AS range, sha256(string_agg(h || ' ' || times, chr(10) ORDER BY h)) AS digest, sum(times) AS n FROM l GROUP BY 1, 2)
SELECT source, sha256(string_agg(digest, chr(10) ORDER BY range)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1"""

QUERIES = {
    "docs_articles": (articles, None),
    "docs_paragraphs": (paragraph_blocks, PARAGRAPH_SQL),
    "docs_block_kinds": (block_kinds, None),
    "docs_numbers": (number_facts, r"SELECT doc_id, len(n) AS numbers, coalesce(CAST(list_sum(list_transform(n, lambda x: round(CAST(x AS DECIMAL(37, 6)), 2))) AS DOUBLE), 0) AS total FROM (SELECT doc_id, regexp_extract_all(text, '[-+]?\d+(?:\.\d+)?') AS n FROM documents)"),
    "docs_page_gate": (page_gate, GATE_SQL),
    "docs_body_font": (body_sizes, BODY_SQL),
    "docs_margins": (margins, MARGIN_SQL),
    "docs_chunk_order": (chunk_order, CHUNK_SQL),
    "docs_table_sentences": (table_sentences, SENTENCE_SQL),
    "docs_governance": (governance, GOVERNANCE_SQL),
    "docs_fingerprint": (corpus_fingerprint, FINGERPRINT_SQL),
}
