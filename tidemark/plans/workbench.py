"""Workbench queries: search, news records, comparison guards, cards, lifecycles, transitions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import workbench as W
from tidemark.operators.market import ranked
from tidemark.sources.tables import SPLIT, read

NEEDLE = "re"


def search(spark, sf_dir):
    """Parts whose name or type holds a needle, dearest first, those without a price last, ties by key; the first 200 with their place."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", F.when(F.col("p_size") > 5, F.col("p_retailprice")).alias("price"))
    hits = p.filter(W.contains_needle(f" {NEEDLE.upper()} ", "p_name", "p_type"))
    return ranked(hits, W.missing_last("price", True, "p_partkey"), None, 200, "position").select("p_partkey", F.coalesce("price", F.lit(-1.0)).alias("price"), "position")


SEARCH_SQL = f"""WITH p AS (SELECT p_partkey, CASE WHEN p_size > 5 THEN p_retailprice END AS price FROM part WHERE contains(lower(p_name), '{NEEDLE}') OR contains(lower(p_type), '{NEEDLE}'))
SELECT p_partkey, coalesce(price, -1.0) AS price, CAST(row_number() OVER (ORDER BY price DESC NULLS LAST, p_partkey) AS INT) AS position FROM p QUALIFY position <= 200"""


def news_records(spark, sf_dir):
    """Parts as documents found by orders as queries; any query urgent, any finished. Newest first, then by id: place among the first 500."""
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    links = li.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("document_id"), F.struct("l_shipdate", "l_linenumber").alias("arrival"))
    queries = o.select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("status"))
    seen = li.groupBy(F.col("l_partkey").alias("document_id")).agg(F.max(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("published_at"), F.max("l_shipdate").alias("collected_at"))
    found = W.news_records(links, queries, seen, "1-URGENT", "F")
    out = ranked(found, [F.desc("at"), F.desc("document_id")], None, 500, "position")
    return out.select("document_id", "queries", "primary_source", "primary_status", F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"), "position")


NEWS_RECORDS_SQL = """WITH k AS (SELECT l_partkey AS document_id, o_orderpriority AS source, o_orderstatus AS status, l_shipdate, l_linenumber, o_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
f AS (SELECT document_id, count(*) AS queries, arg_min(source, (l_shipdate, l_linenumber, o_orderkey)) AS primary_source, arg_min(status, (l_shipdate, l_linenumber, o_orderkey)) AS primary_status FROM k GROUP BY 1 HAVING bool_or(source = '1-URGENT') AND bool_or(status = 'F')),
s AS (SELECT l_partkey AS document_id, coalesce(max(l_shipdate) FILTER (l_returnflag = 'R'), max(l_shipdate)) AS seen FROM lineitem GROUP BY 1)
SELECT document_id, queries, primary_source, primary_status, epoch_us(seen) AS at_us, CAST(row_number() OVER (ORDER BY seen DESC, document_id DESC) AS INT) AS position FROM f JOIN s USING (document_id) QUALIFY position <= 500"""


def _run(date="o_orderdate"):
    """The run of a row: base before the split date, compare from then on; all rows are in one of them."""
    return F.when(F.col(date) < F.lit(SPLIT).cast("timestamp_ntz"), "base").otherwise("compare")


def _contexts(spark, sf_dir, run):
    """Snapshots of a run's orders by priority: what identifies them follows from their number."""
    o = read(spark, sf_dir, "orders").filter(_run() == run)
    n = F.count("*")
    per = o.groupBy(F.col("o_orderpriority").alias("kind")).agg(n.alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("p"))
    return per.select("kind", F.lit("orders").alias("provider_id"), F.concat(F.lit("v"), F.col("n") % 2).alias("classification_version"), F.concat(F.lit("s"), F.col("n") % 3).alias("source_version"), (F.col("p") % 2).alias("n_fields"))


def kind_status(spark, sf_dir):
    """Orders of two runs compared by priority; line statuses count as kinds without a snapshot."""
    kinds = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind")).union(read(spark, sf_dir, "lineitem").select("l_linestatus"))
    out = W.kind_status(_contexts(spark, sf_dir, "base"), _contexts(spark, sf_dir, "compare"), kinds)
    return out.withColumn("warnings", F.array_join("warnings", ","))


_RUN = f"CASE WHEN o_orderdate < TIMESTAMP '{SPLIT}' THEN 'base' ELSE 'compare' END"
_CONTEXTS = f"""ctx AS (SELECT {_RUN} AS y, o_orderpriority AS kind, 'v' || (count(*) % 2) AS cv, 's' || (count(*) % 3) AS sv, count(*) FILTER (o_orderstatus = 'P') % 2 AS nf FROM orders GROUP BY 1, 2),
kinds AS (SELECT DISTINCT o_orderpriority AS kind FROM orders UNION SELECT l_linestatus FROM lineitem),
st AS (SELECT kinds.kind, CASE WHEN b.kind IS NULL OR c.kind IS NULL THEN 'UNAVAILABLE' WHEN b.cv <> c.cv THEN 'INCOMPATIBLE' ELSE 'COMPARABLE' END AS status, b.sv AS bs, c.sv AS cs, b.nf AS bf, c.nf AS cf
FROM kinds LEFT JOIN (SELECT * FROM ctx WHERE y = 'base') b ON b.kind = kinds.kind LEFT JOIN (SELECT * FROM ctx WHERE y = 'compare') c ON c.kind = kinds.kind)"""
KIND_SQL = f"""WITH {_CONTEXTS} SELECT kind, status, CASE status WHEN 'UNAVAILABLE' THEN 'SNAPSHOT_MISSING' WHEN 'INCOMPATIBLE' THEN 'CLASSIFICATION_MISMATCH' ELSE
array_to_string(list_filter([CASE WHEN bs <> cs THEN 'SOURCE_VERSION_DIFF' END, CASE WHEN bf = 0 THEN 'FIELD_SCHEMA_UNKNOWN:BASE' END, CASE WHEN cf = 0 THEN 'FIELD_SCHEMA_UNKNOWN:COMPARE' END], lambda x: x IS NOT NULL), ',') END AS warnings FROM st"""


def _run_candidates(spark, sf_dir, run):
    o = read(spark, sf_dir, "orders").filter(_run() == run)
    return o.select(F.col("o_orderpriority").alias("kind"), F.col("o_custkey").alias("sector_id"))


def membership_counts(spark, sf_dir):
    """Customers of two runs' orders by priority, comparable priorities only."""
    statuses = kind_status(spark, sf_dir)
    return W.membership_counts(_run_candidates(spark, sf_dir, "base"), _run_candidates(spark, sf_dir, "compare"), statuses)


MEMBERSHIP_SQL = f"""WITH {_CONTEXTS}, b AS (SELECT DISTINCT o_orderpriority AS kind, o_custkey AS id FROM orders WHERE {_RUN} = 'base' AND o_orderpriority IN (SELECT kind FROM st WHERE status = 'COMPARABLE')),
c AS (SELECT DISTINCT o_orderpriority AS kind, o_custkey AS id FROM orders WHERE {_RUN} = 'compare' AND o_orderpriority IN (SELECT kind FROM st WHERE status = 'COMPARABLE'))
SELECT count(*) FILTER (b.id IS NOT NULL AND c.id IS NOT NULL) AS both, count(*) FILTER (c.id IS NULL) AS only_base, count(*) FILTER (b.id IS NULL) AS only_compare, (SELECT count(*) FROM st WHERE status <> 'COMPARABLE') AS unavailable_kinds FROM b FULL JOIN c ON b.kind = c.kind AND b.id = c.id"""


def pair_guard(spark, sf_dir):
    """Each order against the customer's next one: why the two runs cannot be compared, and warnings."""
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "READY").when(F.col("o_orderstatus") == "P", "DEGRADED").otherwise("RUNNING")
    run = o.select("o_custkey", "o_orderkey", status.alias("status"), F.substring("o_orderpriority", 1, 1).alias("provider"), (F.month("o_orderdate") % 2).alias("mode"), F.when(F.col("o_totalprice") > 50000, F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("cutoff"), (F.col("o_orderkey") % 3).alias("window"), F.lit(12).alias("limit"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    fields = ["status", "provider", "mode", "cutoff", "window", "limit"]
    nxt = F.lead(F.struct("o_orderkey", *fields)).over(w)
    pairs = run.withColumn("n", nxt).select(F.col("o_orderkey").alias("base_id"), F.col("n.o_orderkey").alias("compare_id"), *[F.col(f).alias(f"base_{f}") for f in fields], *[F.col(f"n.{f}").alias(f"compare_{f}") for f in fields])
    return W.run_warnings(W.pair_guard(pairs)).select("base_id", "guard", F.array_join("warnings", ",").alias("warnings"))


GUARD_SQL = """WITH r AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'READY' WHEN 'P' THEN 'DEGRADED' ELSE 'RUNNING' END AS st, substr(o_orderpriority, 1, 1) AS pr, month(o_orderdate) % 2 AS mo, CASE WHEN o_totalprice > 50000 THEN epoch(o_orderdate) END AS cu, o_orderkey % 3 AS wi FROM orders),
p AS (SELECT *, lead(st) OVER w AS st2, lead(pr) OVER w AS pr2, lead(mo) OVER w AS mo2, lead(cu) OVER w AS cu2, lead(wi) OVER w AS wi2, lead(o_orderkey) OVER w AS k2 FROM r WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_orderkey AS base_id, CASE WHEN st2 IS NULL THEN 'NOT_FOUND' WHEN st = 'RUNNING' OR st2 = 'RUNNING' THEN 'NOT_FINISHED' WHEN pr <> pr2 OR mo <> mo2 THEN 'DIFFERENT_SOURCE' ELSE 'OK' END AS guard,
array_to_string(list_filter([CASE WHEN st <> 'READY' OR coalesce(st2 <> 'READY', false) THEN 'RUN_PARTIAL' END, CASE WHEN cu IS NULL OR cu2 IS NULL THEN 'CUTOFF_MISSING' END, CASE WHEN wi IS DISTINCT FROM wi2 THEN 'NEWS_WINDOW_DIFF' END, CASE WHEN k2 IS NULL THEN 'CANDIDATE_LIMIT_DIFF' END, CASE WHEN cu2 < cu THEN 'REVERSED_TIME' END], lambda x: x IS NOT NULL), ',') AS warnings FROM p"""


def evidence_links(spark, sf_dir):
    """Links of two runs, by ship date, side by side, for suppliers and parts that are candidates (cheap ones)."""
    li = read(spark, sf_dir, "lineitem")
    side = lambda y: li.filter(_run("l_shipdate") == y).groupBy(F.col("l_linestatus").alias("kind"), F.col("l_partkey").alias("sector_id"), F.col("l_suppkey").alias("event_id")).agg(F.min("l_returnflag").alias("relation"))
    keys = li.join(read(spark, sf_dir, "part").filter("p_retailprice < 1200").select(F.col("p_partkey").alias("l_partkey")), "l_partkey").select(F.col("l_linestatus").alias("kind"), F.col("l_partkey").alias("sector_id"))
    out = W.evidence_links(side("base"), side("compare"), keys)
    return out.withColumns({"base_relation": F.coalesce("base_relation", F.lit("")), "compare_relation": F.coalesce("compare_relation", F.lit(""))})


EVIDENCE_SQL = f"""WITH k AS (SELECT l_linestatus AS kind, l_partkey AS sector_id, l_suppkey AS event_id, {_RUN.replace('o_orderdate', 'l_shipdate')} AS y, min(l_returnflag) AS r FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_retailprice < 1200) GROUP BY ALL),
b AS (SELECT * FROM k WHERE y = 'base'), c AS (SELECT * FROM k WHERE y = 'compare')
SELECT coalesce(b.kind, c.kind) AS kind, coalesce(b.sector_id, c.sector_id) AS sector_id, coalesce(b.event_id, c.event_id) AS event_id, coalesce(b.r, '') AS base_relation, coalesce(c.r, '') AS compare_relation, CASE WHEN b.r IS NULL THEN 'ONLY_COMPARE' WHEN c.r IS NULL THEN 'ONLY_BASE' ELSE 'BOTH' END AS membership
FROM b FULL JOIN c ON b.kind = c.kind AND b.sector_id = c.sector_id AND b.event_id = c.event_id"""


def code_sectors(spark, sf_dir):
    """Brands of each part type, each once, in order."""
    out = W.inverted(read(spark, sf_dir, "part"), "p_brand", "p_type")
    return out.select("p_type", F.array_join("keys", ",").alias("brands"))


SECTORS_SQL = "SELECT p_type, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM part GROUP BY 1"


def pinned(spark, sf_dir):
    """Each order's single returned line, if there is exactly one."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    lines = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("detail"))
    return W.pinned(o, lines, ["k"], "detail").withColumn("detail", F.coalesce("detail", F.lit(-1)))


PINNED_SQL = "SELECT o_orderkey AS k, CASE WHEN n IS NULL THEN 'MISSING' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'OK' END AS pinned, CASE WHEN n = 1 THEN d ELSE -1 END AS detail FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, min(l_partkey) AS d FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey"


def card_issues(spark, sf_dir):
    """orders as cards: returned lines' suppliers against those of finished lines, and levels against a limit from the priority."""
    li = read(spark, sf_dir, "lineitem")
    pick = lambda when: F.collect_set(F.when(when, F.col("l_suppkey")))
    cards = li.groupBy("l_orderkey").agg(pick(F.col("l_returnflag") == "R").alias("evidence"), pick(F.col("l_linestatus") == "F").alias("eligible"), pick(F.col("l_returnflag") == "N").alias("background"), pick(F.col("l_quantity") > 10).alias("allowed_background"), F.max("l_linenumber").alias("level"))
    limit = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.substring("o_orderpriority", 1, 1).cast("int") + 1).alias("max_level"))
    return W.card_issues(cards.join(limit, "l_orderkey")).select("l_orderkey", F.array_join("issues", ",").alias("issues"))


CARD_SQL = """WITH c AS (SELECT l_orderkey, coalesce(list(l_suppkey) FILTER (l_returnflag = 'R'), []) AS e, coalesce(list(l_suppkey) FILTER (l_linestatus = 'F'), []) AS g, coalesce(list(l_suppkey) FILTER (l_returnflag = 'N'), []) AS b, coalesce(list(l_suppkey) FILTER (l_quantity > 10), []) AS a, max(l_linenumber) AS level FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_filter([CASE WHEN len(list_filter(e, lambda x: NOT list_contains(g, x))) > 0 THEN 'EVIDENCE_NOT_ELIGIBLE' END, CASE WHEN len(list_filter(b, lambda x: NOT list_contains(a, x))) > 0 THEN 'BACKGROUND_NOT_ALLOWED' END, CASE WHEN level > CAST(substr(o_orderpriority, 1, 1) AS INT) + 1 THEN 'LEVEL_TOO_HIGH' END], lambda x: x IS NOT NULL), ',') AS issues FROM c JOIN orders ON l_orderkey = o_orderkey"""


def ungoverned(spark, sf_dir):
    """lines as sections: their supplier is a source unless the line is small; a draft lists the suppliers of its finished lines."""
    li = read(spark, sf_dir, "lineitem")
    sections = li.select(F.col("l_orderkey").alias("draft_id"), F.col("l_linenumber").alias("section_id"), F.when(F.col("l_quantity") > 5, F.col("l_suppkey")).alias("source_id"))
    sources = li.filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("draft_id"), F.col("l_suppkey").alias("source_id"))
    return W.ungoverned_sections(sections, sources)


UNGOVERNED_SQL = """WITH s AS (SELECT l_orderkey AS draft_id, l_linenumber AS section_id, count(*) FILTER (l_quantity > 5) AS n, count(*) FILTER (l_quantity > 5 AND (l_orderkey, l_suppkey) NOT IN (SELECT (l_orderkey, l_suppkey) FROM lineitem WHERE l_linestatus = 'F')) AS u FROM lineitem GROUP BY 1, 2)
SELECT draft_id, section_id, CASE WHEN n = 0 THEN 'NO_SOURCE' ELSE 'UNKNOWN_SOURCE' END AS issue FROM s WHERE n = 0 OR u > 0"""


def text_relations(spark, sf_dir):
    """What consecutive benchmark passages say about each other."""
    b = read(spark, sf_dir, "benchmark")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    j = b.join(nxt, "item_id").withColumn("o", X.coverage(F.col("text"), F.col("other")))
    r = W.text_relation(F.col("text"), F.col("other"), F.col("o"))
    return j.select("item_id", r["relation"].alias("relation"), F.round(r["confidence"], 6).alias("confidence"))


def _relations_sql():
    from tidemark.plans.retrieval import COVERAGE_SQL

    words = ", ".join(f"'{w}'" for w in W.NEGATIONS)
    neg = lambda t: f"(list_has_any(regexp_split_to_array(lower({t}), '[^\\p{{L}}]+'), [{words}])" + "".join(f" OR contains({t}, '{w}')" for w in W.NEGATIONS_CJK) + ")"
    return f"""WITH c AS ({COVERAGE_SQL}), j AS (SELECT a.item_id, coverage AS o, {neg("a.text")} <> {neg("b.text")} AS turned FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1 JOIN c ON c.item_id = a.item_id)
SELECT item_id, CASE WHEN turned THEN 'CONTRADICTION' WHEN o >= 0.5 THEN 'ENTAILMENT' ELSE 'UNCERTAIN' END AS relation, round(CASE WHEN turned THEN least(0.99, 1 - o / 2) WHEN o >= 0.5 THEN least(0.99, 0.5 + o / 2) ELSE o / 2 END, 6) AS confidence FROM j"""


def vision_gate(spark, sf_dir):
    """parts as figures: type words as values, name words as the series, sureness from the size."""
    p = read(spark, sf_dir, "part")
    values = F.when(F.col("p_size") % 3 == 0, F.array("p_brand", F.col("p_size").cast("string"))).when(F.col("p_size") % 3 == 1, F.split("p_type", " ")).otherwise(F.array().cast("array<string>"))
    series = F.when(F.col("p_size") % 5 != 0, F.split("p_name", " ")).otherwise(F.array().cast("array<string>"))
    return p.select("p_partkey", W.vision_usable((F.col("p_size") / 50).cast("double"), values, series).alias("usable"))


VISION_SQL = """WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) / 50 AS c, CASE p_size % 3 WHEN 0 THEN [p_brand, CAST(p_size AS VARCHAR)] WHEN 1 THEN string_split(p_type, ' ') ELSE [] END AS v, p_size % 5 <> 0 AS s FROM part)
SELECT p_partkey, c >= 0.6 AND len(list_filter(v, lambda x: NOT regexp_matches(x, '[0-9]'))) = 0 AND (len(v) = 0 OR s) AS usable FROM p"""


def subject_repair(spark, sf_dir):
    """The first match of a pattern in each passage replaced."""
    b = read(spark, sf_dir, "benchmark")
    return b.select("item_id", F.sha2(W.replace_once(F.col("text"), "ll|ss|tt|en", "<>"), 256).alias("digest"))


REPAIR_SQL = "SELECT item_id, sha256(regexp_replace(text, 'll|ss|tt|en', '<>')) AS digest FROM benchmark"


def day_bounds(spark, sf_dir):
    start, end = W.day_bounds(F.col("ts"))
    return read(spark, sf_dir, "events").select("event_id", start.alias("start_s"), end.alias("end_s"))


BOUNDS_SQL = "SELECT event_id, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start_s, CAST(epoch(date_trunc('day', ts)) AS BIGINT) + 86399 AS end_s FROM events"


def paragraph_spans(spark, sf_dir):
    """Paragraphs of pages' source with their spans."""
    p = read(spark, sf_dir, "pages").select("page_id", F.explode(W.paragraph_spans(F.regexp_replace("html", "<(p|div|li)>", "\n \n"))).alias("p"))
    return p.select("page_id", "p.ordinal", "p.start", "p.end")


SPANS_SQL = r"""WITH l AS (SELECT page_id, string_split(regexp_replace(html, '<(p|div|li)>', chr(10) || ' ' || chr(10), 'g'), chr(10)) AS ls FROM pages),
u AS (SELECT page_id, i, ls[i] AS line, CAST(sum(length(ls[i]) + 1) OVER (PARTITION BY page_id ORDER BY i) - length(ls[i]) - 1 AS BIGINT) AS pos FROM (SELECT page_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l)),
t AS (SELECT *, length(line) - length(regexp_replace(line, '^\s+', '')) AS lead, length(regexp_replace(regexp_replace(line, '^\s+', ''), '\s+$', '')) AS n FROM u),
g AS (SELECT *, sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS g FROM t),
s AS (SELECT page_id, g, min(pos + lead) AS a, max(pos + lead + n) AS b FROM g WHERE n > 0 GROUP BY 1, 2)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY a) AS INT) AS ordinal, CAST(a AS INT) AS start, CAST(b AS INT) AS end FROM s"""


def ingestion_signals(spark, sf_dir):
    """Orders as ingestions, their lines as chunks: days taken, outcome, chunks, mean length, share read by OCR (returned lines)."""
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    per = li.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ended"), F.count("*").alias("chunks"), F.round(F.avg("l_quantity"), 6).alias("mean_length"), F.round(F.count_if(F.col("l_returnflag") == "R") / F.count("*"), 6).alias("ocr_ratio"))
    j = o.join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "DONE").when(F.col("o_orderstatus") == "P", "FAILED").otherwise("RUNNING").alias("outcome"), F.coalesce(F.datediff("ended", "o_orderdate"), F.lit(-1)).alias("days"), F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("mean_length", F.lit(0.0)).alias("mean_length"), F.coalesce("ocr_ratio", F.lit(0.0)).alias("ocr_ratio"))


INGESTION_SQL = """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'P' THEN 'FAILED' ELSE 'RUNNING' END AS outcome, coalesce(CAST(date_diff('day', o_orderdate, e) AS INT), -1) AS days, coalesce(n, 0) AS chunks, coalesce(m, 0.0) AS mean_length, coalesce(r, 0.0) AS ocr_ratio
FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS e, count(*) AS n, round(avg(l_quantity), 6) AS m, round(CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) / count(*), 6) AS r FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""


def draft_length(spark, sf_dir):
    """Characters of a document's lines: the first as intro, the last as conclusion, the rest as bodies."""
    lines = F.split("text", "\n")
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.coalesce(F.aggregate(F.transform(lines, lambda x: F.length(x)), F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("chars"))


LENGTH_SQL = "SELECT doc_id, CAST(coalesce(list_sum(list_transform(string_split(text, chr(10)), lambda x: length(x))), 0) AS BIGINT) AS chars FROM documents"


def index_lifecycle(spark, sf_dir):
    """Documents staged again, some changed, by language as generation; what each generation would publish."""
    d = read(spark, sf_dir, "documents").filter("lang is not null").select("doc_id", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    stored = d.filter("doc_id % 2 = 0")
    again = d.withColumn("digest", F.when((F.col("doc_id") % 50 == 0) & (F.col("lang") == "en"), "changed").otherwise(F.col("digest")))
    staged = W.stage_records(stored, again, ["doc_id", "lang"], "digest")
    wanted = d.groupBy("lang").agg((F.count("*") + F.count_if((F.col("lang") == "de") & (F.col("doc_id") == 0))).alias("records"))
    return W.published(staged, "lang", wanted)


LIFECYCLE_SQL = """WITH d AS (SELECT *, doc_id % 50 = 0 AND lang = 'en' AS c FROM documents WHERE lang IS NOT NULL),
g AS (SELECT lang, count(*) FILTER (NOT c) AS visible, count(*) FILTER (c) AS conflicts, count(*) + count(*) FILTER (lang = 'de' AND doc_id = 0) AS records FROM d GROUP BY 1)
SELECT lang, visible, conflicts, CASE WHEN conflicts > 0 THEN 'REJECTED' WHEN visible <> records THEN 'INCOMPLETE' ELSE 'PUBLISHED' END AS state FROM g"""


def expected_append(spark, sf_dir):
    """V4: even orders are stored versions of a customer, odd ones requests that expect three versions."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    stored = o.filter("o_orderkey % 2 = 0").groupBy("o_custkey").agg(F.count("*").alias("version"))
    asked = o.filter("o_orderkey % 2 = 1").select("o_custkey", F.col("o_orderkey").alias("request_id"), F.lit(3).alias("expected"))
    return W.expected_append(stored, asked, "o_custkey").select("request_id", "outcome", F.coalesce("version", F.lit(-1)).cast("long").alias("version"))


EXPECTED_SQL = """WITH s AS (SELECT o_custkey, count(*) AS top FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
r AS (SELECT o_orderkey, coalesce(top, 0) AS top, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders LEFT JOIN s USING (o_custkey) WHERE o_orderkey % 2 = 1)
SELECT o_orderkey AS request_id, CASE WHEN top = 3 AND n = 1 THEN 'APPENDED' ELSE 'STALE' END AS outcome, CASE WHEN top = 3 AND n = 1 THEN 4 ELSE -1 END AS version FROM r"""


def _tasks(spark, sf_dir):
    status = lambda c: F.when(c == "view", "PENDING").when(c == "click", "RUNNING").when(c == "error", "RETRY_WAITING").when(c == "purchase", "SUCCEEDED").otherwise("UNKNOWN")
    e = read(spark, sf_dir, "events")
    wanted = F.element_at(F.array(*map(F.lit, ["RUNNING", "SUCCEEDED", "FAILED", "RETRY_WAITING", "CANCELLED"])), (F.col("user_id") % 5 + 1).cast("int"))
    return e.select("event_id", status(F.col("event_type")).alias("status"), wanted.alias("wanted"))


def transitions(spark, sf_dir):
    """Events as tasks, each asked to move once."""
    return W.transitioned(_tasks(spark, sf_dir)).select("event_id", "status", "allowed")


def _transitions_sql():
    may = " OR ".join(f"(st = '{old}' AND w IN ({', '.join(repr(x) for x in new)}))" for old, new in W.TRANSITIONS.items())
    return f"""WITH t AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'RUNNING' WHEN 'error' THEN 'RETRY_WAITING' WHEN 'purchase' THEN 'SUCCEEDED' ELSE 'UNKNOWN' END AS st, (['RUNNING', 'SUCCEEDED', 'FAILED', 'RETRY_WAITING', 'CANCELLED'])[user_id % 5 + 1] AS w FROM events)
SELECT event_id, CASE WHEN {may} THEN w ELSE st END AS status, coalesce({may}, false) AS allowed FROM t"""


def failure_classes(spark, sf_dir):
    """Events as failures: errors of parsing, others of providers with a flag, or of anything else."""
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "PARSE").when(F.col("event_type") == "click", "PROVIDER").otherwise("OTHER")
    return e.groupBy(W.failure_class(kind, F.when(F.col("value") < 20, F.lit(True)).when(F.col("value") < 40, F.lit(False))).alias("class")).agg(F.count("*").alias("n"))


FAILURE_SQL = "SELECT CASE WHEN event_type = 'error' THEN 'PERMANENT' WHEN event_type = 'click' AND NOT coalesce(value < 20, false) THEN 'PERMANENT' ELSE 'RETRYABLE' END AS class, count(*) AS n FROM events GROUP BY 1"


def audit_list(spark, sf_dir):
    """A user's audit rows in order, the newest ten of each."""
    e = read(spark, sf_dir, "events")
    return ranked(e, [F.desc("ts"), F.desc("event_id")], ["user_id"], 10, "position").select("user_id", "event_id", "event_type", "position")


AUDIT_LIST_SQL = "SELECT user_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS position FROM events QUALIFY position <= 10"


def task_detail(spark, sf_dir):
    """Orders with what belongs to them: lines, suppliers, the first and the last shipment."""
    li = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("payloads"), F.countDistinct("l_suppkey").alias("artifacts"), F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("status"))
    j = o.join(li, F.col("task_id") == F.col("l_orderkey"), "left")
    us = lambda c: F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(-1))
    return j.select("task_id", "status", F.coalesce("payloads", F.lit(0)).alias("payloads"), F.coalesce("artifacts", F.lit(0)).alias("artifacts"), us("a").alias("first_us"), us("b").alias("last_us"))


DETAIL_SQL = "SELECT o_orderkey AS task_id, o_orderstatus AS status, count(l_orderkey) AS payloads, count(DISTINCT l_suppkey) AS artifacts, coalesce(epoch_us(min(l_shipdate)), -1) AS first_us, coalesce(epoch_us(max(l_shipdate)), -1) AS last_us FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2"


QUERIES = {
    "records_search": (search, SEARCH_SQL),
    "news_query_records": (news_records, NEWS_RECORDS_SQL),
    "runs_kind_status": (kind_status, KIND_SQL),
    "runs_membership_counts": (membership_counts, MEMBERSHIP_SQL),
    "runs_pair_guard": (pair_guard, GUARD_SQL),
    "runs_evidence_links": (evidence_links, EVIDENCE_SQL),
    "runs_ingestion_signals": (ingestion_signals, INGESTION_SQL),
    "runs_task_detail": (task_detail, DETAIL_SQL),
    "runs_audit_list": (audit_list, AUDIT_LIST_SQL),
    "records_code_sectors": (code_sectors, SECTORS_SQL),
    "records_pinned": (pinned, PINNED_SQL),
    "review_card_issues": (card_issues, CARD_SQL),
    "review_ungoverned_sections": (ungoverned, UNGOVERNED_SQL),
    "review_subject_repair": (subject_repair, REPAIR_SQL),
    "review_draft_length": (draft_length, LENGTH_SQL),
    "claims_text_relations": (text_relations, _relations_sql()),
    "docs_vision_gate": (vision_gate, VISION_SQL),
    "docs_paragraph_spans": (paragraph_spans, SPANS_SQL),
    "store_index_lifecycle": (index_lifecycle, LIFECYCLE_SQL),
    "store_expected_append": (expected_append, EXPECTED_SQL),
    "state_transitions": (transitions, _transitions_sql()),
    "state_failure_classes": (failure_classes, FAILURE_SQL),
    "time_day_bounds": (day_bounds, BOUNDS_SQL),
}
