"""Intake queries: constituents, scan outcomes, disclosures, stored locators, assets, query plans, packs, groups, table texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import intake as I
from tidemark.operators import news as N
from tidemark.plans import market, news
from tidemark.sources.tables import read


def members(spark, sf_dir):
    """Customers as members of nations; some lack a code in the first column, some in both, some a name."""
    k = F.col("c_custkey")
    code = F.lpad(k.cast("string"), 6, "0")
    rows = read(spark, sf_dir, "customer").select(
        "c_nationkey",
        F.when(k % 4 != 0, code).otherwise("").alias("code_a"),
        F.when(k % 12 != 0, code).alias("code_b"),
        F.when(k % 7 != 0, F.col("c_name")).alias("name_a"),
        F.when(k % 14 == 0, F.col("c_mktsegment")).otherwise("").alias("name_b"),
    )
    return I.constituents(rows, ["c_nationkey"], ["code_a", "code_b"], ["name_a", "name_b"])


MEMBERS_SQL = """SELECT c_nationkey, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code, CASE WHEN c_custkey % 7 <> 0 THEN c_name ELSE c_mktsegment END AS name FROM customer
WHERE c_custkey % 12 <> 0 AND (c_custkey % 7 <> 0 OR c_custkey % 14 = 0)"""


def scans(spark, sf_dir):
    """Four documents a scan; one without a url fails to map."""
    d = news._used(spark, sf_dir).select(F.floor(F.col("doc_id") / 4).alias("scan_id"), F.col("citation_url").isNull().alias("failed"), "use")
    return I.scan_outcomes(d, "scan_id")


SCANS_SQL = f"""{news._N}, c AS (SELECT doc_id // 4 AS scan_id, count(*) FILTER (citation_url IS NOT NULL AND use <> 'EXCLUDED') AS documents, count(*) FILTER (citation_url IS NULL) AS errors FROM used GROUP BY 1)
SELECT *, CASE WHEN documents = 0 AND errors > 0 THEN 'FAILED' WHEN documents = 0 THEN 'EMPTY' WHEN errors > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status FROM c"""
START, CUTOFF = "2024-01-01 20:00:00", "2024-01-02 17:00:00"


def disclosure_window(spark, sf_dir):
    """Events as disclosures of users, those of customers in debt, within two Shanghai days."""
    docs = read(spark, sf_dir, "events").select(F.col("event_id"), F.col("user_id").alias("code"), F.col("ts").alias("at"))
    codes = read(spark, sf_dir, "customer").filter("c_acctbal < 5000").select(F.col("c_custkey").alias("code"))
    return I.disclosures(docs, codes, START, CUTOFF).select("event_id", "code")


DISCLOSURE_SQL = f"""SELECT event_id, user_id AS code FROM events WHERE CAST(ts + INTERVAL 8 HOUR AS DATE) BETWEEN CAST(TIMESTAMP '{START}' + INTERVAL 8 HOUR AS DATE) AND CAST(TIMESTAMP '{CUTOFF}' + INTERVAL 8 HOUR AS DATE)
AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 5000)"""


def event_rewrite(spark, sf_dir):
    """Odd pages are saved while even ones are stored; events of three pages each name them by canonical id."""
    url = F.regexp_replace(N.canonical_url(F.col("url")), r"[?].*$", "")
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("document_id"), url.alias("locator"))
    new = I.stored_locators(pages.filter("document_id % 2 = 1"), pages.filter("document_id % 2 = 0"), "locator", "document_id")
    bridge = pages.select(F.floor(F.col("document_id") / 3).alias("event_id"), "document_id")
    return I.rewritten_bridge(bridge, new.select("document_id", "canonical_id"))


EVENT_SQL = r"""WITH p AS (SELECT page_id, regexp_replace(canonical, '\?.*$', '') AS locator FROM (""" + news.URLS_SQL + """)),
h AS (SELECT locator, coalesce(min(page_id) FILTER (page_id % 2 = 0), min(page_id)) AS head FROM p GROUP BY 1)
SELECT DISTINCT page_id // 3 AS event_id, CASE WHEN page_id % 2 = 1 THEN coalesce(head, page_id) ELSE page_id END AS document_id FROM p LEFT JOIN h USING (locator)"""
MOST_BYTES = 4000


def assets(spark, sf_dir):
    """Documents as stored assets, some declared with another hash or size, some with neither."""
    k = F.col("doc_id")
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    declared = d.select("doc_id", "text", F.when(k % 7 == 0, "none").when(k % 3 != 0, F.sha2("text", 256)).alias("declared_sha256"), F.when(k % 4 != 0, F.octet_length("text") + F.when(k % 5 == 0, 1).otherwise(0)).alias("declared_size"))
    return I.asset_verdicts(declared, "text", MOST_BYTES).select("doc_id", "verdict")


ASSETS_SQL = f"""SELECT doc_id, CASE WHEN strlen(coalesce(text, '')) > {MOST_BYTES} THEN 'TOO_LARGE' WHEN doc_id % 7 = 0 THEN 'HASH' WHEN doc_id % 4 <> 0 AND doc_id % 5 = 0 THEN 'SIZE' ELSE 'OK' END AS verdict FROM documents"""
PLAN_CUTOFF = "2024-01-03T00:00:00+00:00"


def query_levels(spark, sf_dir):
    """Market segments as runs whose candidates are the nations of their customers, suppliers as members; every fifth nation goes by its name alone."""
    n = read(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 5 == 0, F.col("n_name")).otherwise(F.concat(F.lit("N"), "n_nationkey")).alias("sector_id"), "n_name")
    c = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("run_id"), "c_nationkey").distinct()
    candidates = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("run_id", "sector_id", F.col("n_name").alias("name"), (F.lit(100) - F.col("n_nationkey")).alias("rank"))
    aliases = n.select("sector_id", F.explode(F.array(F.concat(F.lit(" "), F.lower("n_name")), F.concat(F.lit("group "), F.col("n_nationkey") % 3), F.lit(" "))).alias("alias"))
    codes = read(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("sector_id", F.lpad((F.col("s_suppkey") % 60).cast("string"), 6, "0").alias("code"))
    return I.leveled_queries(candidates, aliases, codes, PLAN_CUTOFF).withColumn("sector_id", F.coalesce("sector_id", F.lit("")))


LEVELS_SQL = f"""WITH n AS (SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 5 = 0 THEN n_name ELSE 'N' || n_nationkey END AS sector_id FROM nation),
c AS (SELECT DISTINCT c_mktsegment AS run_id, sector_id, n_name, 100 - n_nationkey AS rank, n_nationkey FROM customer JOIN n ON c_nationkey = n_nationkey),
q AS (SELECT run_id, 'KEYWORD' AS query_type, 'eastmoney' AS source_id, n_name AS value, sector_id, 90 AS priority, rank FROM c
UNION ALL SELECT run_id, 'KEYWORD', 'eastmoney', ' ' || lower(n_name), sector_id, 80, rank FROM c UNION ALL SELECT run_id, 'KEYWORD', 'eastmoney', 'group ' || (n_nationkey % 3), sector_id, 80, rank FROM c
UNION ALL SELECT run_id, 'KEYWORD', 'eastmoney', sector_id, sector_id, 70, rank FROM c WHERE sector_id <> n_name
UNION ALL SELECT run_id, 'DISCLOSURE', 'cninfo', lpad(CAST(s_suppkey % 60 AS VARCHAR), 6, '0'), sector_id, 60, rank FROM c JOIN supplier ON s_nationkey = n_nationkey),
o AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY run_id, query_type, CASE query_type WHEN 'KEYWORD' THEN lower(trim(value)) ELSE value END ORDER BY priority DESC, value, rank, sector_id) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, query_type ORDER BY priority DESC, value, rank, sector_id) AS ordinal FROM o),
a AS (SELECT run_id, query_type, source_id, value, sector_id, priority, ordinal FROM r WHERE ordinal <= CASE query_type WHEN 'KEYWORD' THEN 24 ELSE 12 END UNION ALL SELECT DISTINCT run_id, 'GLOBAL', 'cls', '全部', '', 100, 1 FROM c)
SELECT *, substr(sha256(query_type || '|' || source_id || '|' || lower(trim(value)) || '|{PLAN_CUTOFF}'), 1, 24) AS query_id FROM a"""


def packs(spark, sf_dir):
    """Candidates of both runs with their facts and linked events."""
    keys = ["run_id", "kind", "sector_id"]
    c = market.candidate_rank(spark, sf_dir).select(*keys)
    u = market.sector_snapshot(spark, sf_dir).select(*keys, "pct_change", "breadth_ratio", "turnover_rate")
    out = I.evidence_packs(c, u, news.sector_links(spark, sf_dir).select("sector_id", "event_id"), keys)
    return out.select(*keys, "pct_change", "breadth_ratio", F.coalesce("turnover_rate", F.lit(-1.0)).alias("turnover_rate"), "events", "max_level", F.size("facts").alias("facts"))


PACKS_SQL = f"""WITH c AS ({market.CANDIDATE_SQL}), u AS ({market.SNAPSHOT_SQL}), l AS ({news.LINKS_SQL}), n AS (SELECT sector_id, count(DISTINCT event_id) AS events FROM l GROUP BY 1)
SELECT c.run_id, c.kind, c.sector_id, u.pct_change, u.breadth_ratio, coalesce(u.turnover_rate, -1.0) AS turnover_rate, coalesce(events, 0) AS events, CASE WHEN events > 0 THEN 'MARKET_ASSOCIATION' ELSE 'NO_RELIABLE_EXPLANATION' END AS max_level, 3 AS facts
FROM c JOIN u ON u.run_id = c.run_id AND u.kind = c.kind AND u.sector_id = c.sector_id LEFT JOIN n ON n.sector_id = c.sector_id"""


def alias_claims(spark, sf_dir):
    """Orders as claims on customers by name, written in three ways; every tenth customer's other name is that of the one before."""
    o = read(spark, sf_dir, "orders")
    k, start = F.col("o_orderkey"), F.to_date("o_orderdate")
    name = F.concat(F.when(k % 3 == 0, "Customer ").when(k % 3 == 1, "CUSTOMER").otherwise("ｃustomer"), "o_custkey")
    claims = o.select(k.alias("claim_id"), name.alias("subject"), F.col("o_orderpriority").alias("predicate"), F.when(k % 50 != 0, start).alias("start"), F.when(k % 50 != 0, F.date_add(start, (k % 400).cast("int"))).alias("end"))
    c = F.col("c_custkey")
    aliases = read(spark, sf_dir, "customer").filter(c % 10 == 9).select(F.concat(F.lit("Customer"), c).alias("alias"), F.concat(F.lit("customer "), c - 1).alias("canonical"))
    return I.alias_groups(claims, aliases).select("claim_id", "subject_key", "component", "size", "first_claim")


ALIAS_SQL = """WITH c AS (SELECT o_orderkey AS claim_id, 'customer' || CASE WHEN o_custkey % 10 = 9 AND o_custkey IN (SELECT c_custkey FROM customer) THEN o_custkey - 1 ELSE o_custkey END AS subject_key, lower(replace(o_orderpriority, ' ', '')) AS p,
CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) END AS s, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INT) END AS e FROM orders),
g1 AS (SELECT *, max(e) OVER (PARTITION BY subject_key, p ORDER BY s NULLS FIRST, claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, bool_or(s IS NULL) OVER (PARTITION BY subject_key, p) AS unk, min(claim_id) OVER (PARTITION BY subject_key, p) AS first_claim FROM c),
g AS (SELECT *, CAST(sum(CASE WHEN NOT unk AND s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY subject_key, p ORDER BY s NULLS FIRST, claim_id ROWS UNBOUNDED PRECEDING) AS INT) AS component FROM g1)
SELECT claim_id, subject_key, component, count(*) OVER (PARTITION BY subject_key, p, component) AS size, first_claim FROM g QUALIFY size >= 2"""


def table_texts(spark, sf_dir):
    """Parts as tables of three rows, some without a unit, notes or any row."""
    k = F.col("p_partkey")
    columns = F.array(*map(F.lit, ["year", "brand", "type"]))
    rows = F.array(F.array((F.col("p_size") + 1990).cast("string"), F.col("p_brand"), F.col("p_type")), F.array(F.lit(" 12345 "), F.lit(" "), F.col("p_type")), F.array(F.lit("total"), F.lit(""), F.lit("")))
    t = read(spark, sf_dir, "part").select("p_partkey", I.table_text(F.col("p_name"), F.when(k % 3 != 0, "mm"), columns, F.when(k % 9 != 0, rows).otherwise(F.slice(rows, 1, 0)), F.when(k % 2 == 0, F.col("p_type"))).alias("text"))
    return t.withColumn("text", F.coalesce("text", F.lit("")))


TABLE_SQL = """SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE '表格：' || p_name || chr(10) || CASE WHEN p_partkey % 3 <> 0 THEN '单位：mm' || chr(10) ELSE '' END || (p_size + 1990) || ' 年：brand ' || p_brand || '，type ' || p_type || '。' || chr(10) || '12345：type ' || p_type || '。' || chr(10) || 'total。'
|| CASE WHEN p_partkey % 2 = 0 THEN chr(10) || '注释：' || p_type ELSE '' END END AS text FROM part"""

QUERIES = {
    "records_constituents": (members, MEMBERS_SQL),
    "news_scan_outcomes": (scans, SCANS_SQL),
    "news_disclosures": (disclosure_window, DISCLOSURE_SQL),
    "news_event_rewrite": (event_rewrite, EVENT_SQL),
    "store_asset_verdicts": (assets, ASSETS_SQL),
    "news_query_levels": (query_levels, LEVELS_SQL),
    "records_evidence_packs": (packs, PACKS_SQL),
    "claims_alias_groups": (alias_claims, ALIAS_SQL),
    "docs_table_texts": (table_texts, TABLE_SQL),
}
