"""Queries on records: mapping, stores, evidence trees, selections, reviews, lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.time import backoff_seconds, local_to_utc
from tidemark.operators import records as P
from tidemark.plans import market, news
from tidemark.sources.tables import NEWS_SQL, news_documents, read


def vendor_rows(spark, sf_dir):
    """Parts as vendor rows with two names for a field, percent signs and blanks."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    rows = p.select("p_partkey", F.when(k % 3 == 0, "nan").otherwise(F.col("p_name")).alias("name_a"), F.col("p_type").alias("name_b"), F.when(k % 4 != 0, F.concat(k % 100, F.lit(".5%"))).otherwise(" ").alias("change"), F.when(k % 5 != 0, F.col("p_brand")).alias("code"))
    out = P.map_sectors(rows, {"name": ["name_a", "name_b", "absent"], "sector_id": ["code"], "pct_change": ["change"]}, ["p_partkey"])
    return out.withColumn("pct_change", F.col("pct_change").cast("double"))


VENDOR_SQL = """SELECT p_partkey, name, coalesce(CASE WHEN p_partkey % 5 <> 0 THEN p_brand END, name) AS sector_id, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey % 100 AS DOUBLE) + 0.5 ELSE 0 END AS pct_change
FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END AS name FROM part)"""


def fallback(spark, sf_dir):
    """Two feeds with the same fallback, finished orders: one that has rows (urgent open orders), one that has none (open orders below any price)."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    spare, cols = o.filter("o_orderstatus = 'F'"), ["o_orderkey", "o_orderstatus"]
    feeds = {"urgent": o.filter("o_orderstatus = 'O' and o_orderpriority = '1-URGENT'"), "free": o.filter("o_orderstatus = 'O' and o_totalprice <= 0")}
    served = [P.with_fallback(feed.select(*cols), spare.select(*cols)).withColumn("feed", F.lit(name)) for name, feed in feeds.items()]
    return served[0].unionByName(served[1])


FALLBACK_SQL = """SELECT o_orderkey, o_orderstatus, 'urgent' AS feed FROM orders WHERE o_orderstatus = CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') THEN 'O' ELSE 'F' END AND (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT')
UNION ALL SELECT o_orderkey, o_orderstatus, 'free' FROM orders WHERE o_orderstatus = CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'O' AND o_totalprice <= 0) THEN 'O' ELSE 'F' END AND (o_orderstatus = 'F' OR o_totalprice <= 0)"""


def key_match(spark, sf_dir):
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    return P.total_match(o.select(F.col("o_orderkey").alias("k")), li.select(F.col("l_orderkey").alias("k")).distinct(), "k")


MATCH_SQL = """WITH j AS (SELECT o_orderkey AS a, l AS b FROM orders FULL JOIN (SELECT DISTINCT l_orderkey AS l FROM lineitem) ON o_orderkey = l)
SELECT count(*) FILTER (a IS NULL) AS missing_left, count(*) FILTER (b IS NULL) AS missing_right, 0 AS repeated, count(*) FILTER (a IS NULL OR b IS NULL) = 0 AS ok FROM j"""


def candidates_view(spark, sf_dir):
    """Candidates with snapshot fields and news counts (0 without news), missing values last."""
    c = market.candidate_rank(spark, sf_dir).select("run_id", "kind", "sector_id", "rank")
    u = market.sector_snapshot(spark, sf_dir).select("run_id", "kind", "sector_id", "turnover_rate", "breadth_ratio")
    n = news.news_per_sector(spark, sf_dir).select("sector_id", "events")
    out = c.join(u, ["run_id", "kind", "sector_id"], "left").join(n, "sector_id", "left")
    return out.withColumns({"events": F.coalesce("events", F.lit(0)), "turnover_rate": F.coalesce("turnover_rate", F.lit(-1.0))})


VIEW_SQL = f"""WITH c AS ({market.CANDIDATE_SQL}), u AS ({market.SNAPSHOT_SQL}), n AS ({news.PER_SECTOR_SQL})
SELECT c.run_id, c.kind, c.sector_id, c.rank, coalesce(turnover_rate, -1.0) AS turnover_rate, breadth_ratio, coalesce(events, 0) AS events FROM c LEFT JOIN u ON u.run_id = c.run_id AND u.kind = c.kind AND u.sector_id = c.sector_id LEFT JOIN n ON n.sector_id = c.sector_id"""


def evidence_tree(spark, sf_dir):
    """Stories with their documents: those with a citation first, newest first, then by id."""
    d = news_documents(spark, sf_dir)
    stories = d.select("story").distinct()
    order = [F.col("citation_url").isNull(), F.desc_nulls_last("published_us"), F.asc("doc_id")]
    return P.ordered_children(stories, d.select("story", "doc_id"), d.select("doc_id", "citation_url", "published_us", "source_grade"), "story", "doc_id", order, ["source_grade"])


TREE_SQL = f"WITH {NEWS_SQL} SELECT story, doc_id, CAST(row_number() OVER (PARTITION BY story ORDER BY citation_url IS NULL, published_us DESC NULLS LAST, doc_id) AS INT) AS place, source_grade FROM news"


def selections(spark, sf_dir):
    """Selections of orders: its lines' suppliers among those offered, the seven suppliers from the order's key on."""
    li = read(spark, sf_dir, "lineitem")
    chosen = li.select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("key"))
    offered = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("key")).withColumn("rank", F.col("key"))
    return P.validate_selection(chosen, offered, "run", "key")


SELECTION_SQL = """WITH a AS (SELECT l_orderkey AS run, count(*) AS n, count(DISTINCT l_linenumber) AS d, count(*) FILTER (l_linenumber > 6) AS u, max(CASE WHEN l_linenumber <= 6 THEN l_linenumber END) AS last FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1),
w AS (SELECT *, CASE WHEN u > 0 THEN 'UNKNOWN_CANDIDATE' WHEN n <> d THEN 'REPEATED' WHEN n NOT BETWEEN 3 AND 12 THEN 'COUNT' ELSE '' END AS why FROM a)
SELECT run, n, why = '' AS ok, why, CASE WHEN why <> '' THEN '' WHEN last = n THEN 'DEFAULT' ELSE 'MANUAL' END AS mode FROM w"""


def number_checks(spark, sf_dir):
    """Claims of orders that quote their size rightly or, every seventh, wrongly."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    claims = p.select("p_partkey", k.alias("claim_id"), F.concat(F.lit("size "), F.when(k % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")), F.lit(" of 50")).alias("text"))
    facts = p.select("p_partkey", F.col("p_size").alias("value")).union(p.select("p_partkey", F.lit(50)))
    return P.claim_number_issues(claims, facts, "p_partkey")


NUMBER_SQL = "SELECT p_partkey, p_partkey AS claim_id, (p_size + 1) || '.0' AS wrong FROM part WHERE p_partkey % 7 = 0 AND p_size + 1 <> 50"


def draft_issues(spark, sf_dir):
    """Drafts made of benchmark passages: heading and body hold their first word, but every third lacks it."""
    b = read(spark, sf_dir, "benchmark")
    k = F.col("item_id")
    first = F.regexp_extract("text", r"^(\S+)", 1)
    s = b.select((F.floor(k / 4)).alias("draft_id"), k.alias("ordinal"), (k % 3).alias("sector_id"), F.when(k % 3 == 0, F.lit("none")).otherwise(F.concat(F.lit("On "), first)).alias("heading"), F.concat("text", F.when(k % 5 == 0, " TODO check").otherwise("")).alias("body"), first.alias("subject"))
    return P.draft_issues(s)


DRAFT_SQL = r"""WITH s AS (SELECT item_id // 4 AS draft_id, item_id AS ordinal, item_id % 3 AS sector_id, regexp_extract(text, '^(\S+)', 1) AS subject, text || CASE WHEN item_id % 5 = 0 THEN ' TODO check' ELSE '' END AS body FROM benchmark),
h AS (SELECT *, CASE WHEN ordinal % 3 = 0 THEN 'none' ELSE 'On ' || subject END AS heading, count(*) OVER (PARTITION BY draft_id, sector_id) AS n, regexp_extract(body, '^([^.。！？!?]*)', 1) AS f FROM s)
SELECT draft_id, ordinal, 'DUPLICATE_SECTOR' AS issue FROM h WHERE n > 1 UNION ALL SELECT draft_id, ordinal, 'SUBJECT_NOT_IN_HEADING' FROM h WHERE NOT contains(lower(heading), lower(subject))
UNION ALL SELECT draft_id, ordinal, 'SUBJECT_NOT_IN_FIRST_SENTENCE' FROM h WHERE NOT contains(lower(f), lower(subject)) UNION ALL SELECT draft_id, ordinal, 'WORKFLOW_MARKER' FROM h WHERE ordinal % 5 = 0"""


def evidence_issues(spark, sf_dir):
    """Orders as claims that cite their lines' suppliers; suppliers are active, in conflict or verified by key."""
    claims = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_suppkey").alias("evidence_id"))
    k = F.col("s_suppkey")
    accepted = read(spark, sf_dir, "supplier").select(k.alias("evidence_id"), (k % 10 != 0).alias("active"), (k % 15 == 1).alias("conflict"), (k % 2 == 0).alias("verified"))
    return P.evidence_issues(claims, accepted)


EVIDENCE_SQL = """WITH a AS (SELECT l_orderkey AS claim_id, bool_or(NOT coalesce(s_suppkey % 10 <> 0, false)) AS i, bool_or(coalesce(s_suppkey % 15 = 1, false)) AS c, bool_and(NOT coalesce(s_suppkey % 2 = 0, false)) AS u FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)
SELECT claim_id, 'INACTIVE_SOURCE' AS issue FROM a WHERE i UNION ALL SELECT claim_id, 'UNRESOLVED_CONFLICT' FROM a WHERE c UNION ALL SELECT claim_id, 'ONLY_UNVERIFIED' FROM a WHERE u"""


def weakest_origins(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    parts = li.select("l_orderkey", F.element_at(F.array(*map(F.lit, ["TEXT", "TABLE", "OCR", "VISION"])), F.col("l_linenumber") % 4 + 1).alias("origin"), (1 - F.col("l_tax")).alias("confidence"), (F.col("l_returnflag") == "R").alias("requires_verification"))
    return P.weakest_origin(parts, "l_orderkey", ["TEXT", "TABLE", "OCR", "VISION"])


WEAKEST_SQL = "SELECT l_orderkey, (['TEXT', 'TABLE', 'OCR', 'VISION'])[max(l_linenumber % 4) + 1] AS origin, min(1 - l_tax) AS confidence, bool_or(l_returnflag = 'R') AS requires_verification FROM lineitem GROUP BY 1"


def metrics(spark, sf_dir):
    """Metric samples of events: totals per type and label set, for shards that have the label asked."""
    e = read(spark, sf_dir, "events")
    labels = F.create_map(F.lit("shard"), (F.col("user_id") % 3).cast("string"), F.lit("app"), F.lit("x"))
    cents = F.round(F.col("value") * 100).cast("long")
    s = e.select(F.col("event_type").alias("name"), labels.alias("labels"), cents.alias("value")).filter(P.labels_match(F.col("labels"), {"app": "x"}))
    return P.metric_totals(s)


METRICS_SQL = """SELECT event_type AS name, '{"app":"x","shard":"' || (user_id % 3) || '"}' AS labels, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) AS mean FROM events GROUP BY 1, 2"""


def stages(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("s", P.stage(F.when(F.col("o_orderkey") % 6 == 0, "X").otherwise(F.col("o_orderstatus"))))
    return o.groupBy("s.stage", "s.index").agg(F.count("*").alias("n"))


STAGES_SQL = "SELECT CASE WHEN o_orderkey % 6 = 0 THEN 'TERMINATED' WHEN o_orderstatus = 'P' THEN 'COLLECTING' WHEN o_orderstatus = 'O' THEN 'WRITING' ELSE 'DONE' END AS stage, CASE WHEN o_orderkey % 6 = 0 THEN 5 WHEN o_orderstatus = 'P' THEN 1 WHEN o_orderstatus = 'O' THEN 3 ELSE 4 END AS index, count(*) AS n FROM orders GROUP BY 1, 2"


def version_append(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    stored = o.filter("o_orderkey % 2 = 0").groupBy("o_custkey").agg(F.count("*").alias("version"))
    return P.next_versions(stored, o.filter("o_orderkey % 2 = 1"), ["o_custkey"], "version", "o_orderkey")


APPEND_SQL = "SELECT o_custkey, o_orderkey, coalesce(n, 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version FROM orders LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) USING (o_custkey) WHERE o_orderkey % 2 = 1"


def status_cas(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    changes = o.filter(k % 3 == 0).select("o_orderkey", F.when(k % 2 == 0, "O").otherwise("P").alias("expected"), F.lit("CLOSED").alias("new_status"))
    out = P.compare_and_set(o.select("o_orderkey", F.col("o_orderstatus").alias("status")), changes, "o_orderkey")
    return out.withColumn("applied", F.coalesce("applied", F.lit(False)))


CAS_SQL = "SELECT o_orderkey, CASE WHEN hit THEN 'CLOSED' ELSE o_orderstatus END AS status, hit AS applied FROM (SELECT *, o_orderkey % 3 = 0 AND o_orderstatus = CASE WHEN o_orderkey % 2 = 0 THEN 'O' ELSE 'P' END AS hit FROM orders)"


def bridge(spark, sf_dir):
    """Orders divisible by four get a single new line, the rest keep theirs."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    new = read(spark, sf_dir, "orders").filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(-1).cast("long").alias("l_suppkey"))
    return P.replace_bridge(li, new, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_suppkey").alias("low"))


BRIDGE_SQL = "WITH b AS (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0) UNION ALL SELECT o_orderkey, -1 FROM orders WHERE o_orderkey % 4 = 0) SELECT l_orderkey, count(*) AS n, min(l_suppkey) AS low FROM b GROUP BY 1"


def patches(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("section_id"), F.col("text").alias("body"))
    k = F.col("section_id")
    p = b.select("section_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("patch_no"), "body").withColumns({"expected_hash": F.when((k + F.col("patch_no")) % 3 == 0, F.lit("stale")).otherwise(F.sha2("body", 256)), "new_body": F.concat_ws("-", F.lit("patch"), "patch_no", "section_id")}).drop("body")
    return P.apply_patches(b, p)


PATCH_SQL = """SELECT item_id AS section_id, CASE WHEN (item_id + 2) % 3 <> 0 THEN 'patch-2-' || item_id WHEN (item_id + 1) % 3 <> 0 THEN 'patch-1-' || item_id ELSE text END AS body, true AS patched FROM benchmark"""


def purged(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), (F.col("o_orderstatus") == "F").alias("deleted"), F.col("o_orderdate").alias("purge_after"))
    left, audit = P.purge(o, "1997-01-01")
    return left.select("document_id", F.lit("KEPT").alias("event")).union(audit)


PURGE_SQL = "SELECT o_orderkey AS document_id, CASE WHEN o_orderstatus = 'F' AND o_orderdate <= TIMESTAMP '1997-01-01' THEN 'PURGED' ELSE 'KEPT' END AS event FROM orders"


def uploads(spark, sf_dir):
    """Documents uploaded again: some unchanged, some changed, some new."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("upload_key"), F.sha2("text", 256).alias("content_hash"))
    again = d.select(F.when(F.col("upload_key") % 5 == 0, -F.col("upload_key") - 1).otherwise(F.col("upload_key")).alias("upload_key"), F.when(F.col("upload_key") % 4 == 0, "changed").otherwise(F.col("content_hash")).alias("content_hash"))
    return P.idempotent_uploads(d, again).groupBy("outcome").agg(F.count("*").alias("n"))


UPLOAD_SQL = "SELECT CASE WHEN doc_id % 5 = 0 THEN 'NEW' WHEN doc_id % 4 = 0 THEN 'CONFLICT' ELSE 'EXISTING' END AS outcome, count(*) AS n FROM documents GROUP BY 1"


def cache_keys(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", P.cache_key(F.col("c_mktsegment"), F.col("c_nationkey"), F.lit(None), F.lit(12)).alias("key"))


CACHE_SQL = "SELECT c_custkey, 'rk_' || substr(sha256(c_mktsegment || chr(31) || c_nationkey || chr(31) || chr(31) || '12'), 1, 32) AS key FROM customer"


def expanded(spark, sf_dir):
    syn = F.create_map(F.lit("red"), F.array(F.lit("crimson"), F.lit("scarlet"), F.lit("ruby"), F.lit("cherry")), F.lit("ring"), F.array(F.lit("band"), F.lit("red")))
    return read(spark, sf_dir, "part").select("p_partkey", P.expand_query(F.col("p_name"), syn).alias("query"))


EXPAND_SQL = """SELECT p_partkey, p_name || ' ' || array_to_string(list_filter(CASE WHEN p_name LIKE 'red %' AND p_name LIKE '% ring' THEN ['crimson', 'scarlet', 'ruby', 'band'] WHEN p_name LIKE 'red %' THEN ['crimson', 'scarlet', 'ruby'] WHEN p_name LIKE '% ring' THEN ['band', 'red'] ELSE [] END, lambda x: true), ' ') AS query FROM part"""


def wrapped(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(P.join_wrapped(F.split("text", "\n")), 256).alias("hash"))


WRAPPED_SQL = "SELECT doc_id, sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), ' ')) AS hash FROM documents"


def utc_times(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    utc = local_to_utc(F.col("ts").cast("timestamp"))
    return e.select("event_id", F.date_format(utc, "yyyy-MM-dd HH:mm:ss").alias("utc"), backoff_seconds(F.col("event_id") % 6 + 1, 0.5).alias("backoff"))


UTC_SQL = "SELECT event_id, strftime(ts - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS utc, CAST(0.5 AS DOUBLE) * pow(2.0, event_id % 6) AS backoff FROM events"


def document_membership(spark, sf_dir):
    """Documents of two runs (embedded; labelled good), per document BOTH or the one side."""
    a = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("a"))
    b = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct().withColumn("b", F.lit(True))
    j = a.join(b, "doc_id", "full_outer")
    return j.select("doc_id", F.when(F.col("a") & F.col("b"), "BOTH").when(F.col("a"), "ONLY_BASE").otherwise("ONLY_COMPARE").alias("membership"))


MEMBERSHIP_SQL = "SELECT coalesce(vec_id, doc_id) AS doc_id, CASE WHEN vec_id IS NOT NULL AND doc_id IS NOT NULL THEN 'BOTH' WHEN vec_id IS NOT NULL THEN 'ONLY_BASE' ELSE 'ONLY_COMPARE' END AS membership FROM embeddings FULL JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) ON vec_id = doc_id"


def run_counts(spark, sf_dir):
    """Lines and returned lines of every order, 0 without any."""
    li = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    o = read(spark, sf_dir, "orders").select("o_orderkey")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("lines"), F.coalesce("r", F.lit(0)).alias("returned"))


RUN_COUNTS_SQL = "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS returned FROM orders"


QUERIES = {
    "records_vendor_rows": (vendor_rows, VENDOR_SQL),
    "records_fallback": (fallback, FALLBACK_SQL),
    "records_key_match": (key_match, MATCH_SQL),
    "records_candidates_view": (candidates_view, VIEW_SQL),
    "records_evidence_tree": (evidence_tree, TREE_SQL),
    "records_selections": (selections, SELECTION_SQL),
    "review_number_checks": (number_checks, NUMBER_SQL),
    "review_draft_issues": (draft_issues, DRAFT_SQL),
    "review_evidence_issues": (evidence_issues, EVIDENCE_SQL),
    "review_patches": (patches, PATCH_SQL),
    "rag_weakest_origin": (weakest_origins, WEAKEST_SQL),
    "rag_metric_totals": (metrics, METRICS_SQL),
    "rag_cache_keys": (cache_keys, CACHE_SQL),
    "rag_expanded_queries": (expanded, EXPAND_SQL),
    "runs_stages": (stages, STAGES_SQL),
    "runs_counts": (run_counts, RUN_COUNTS_SQL),
    "runs_document_membership": (document_membership, MEMBERSHIP_SQL),
    "store_version_append": (version_append, APPEND_SQL),
    "store_status_cas": (status_cas, CAS_SQL),
    "store_bridge_replace": (bridge, BRIDGE_SQL),
    "store_purge": (purged, PURGE_SQL),
    "store_uploads": (uploads, UPLOAD_SQL),
    "docs_wrapped_lines": (wrapped, WRAPPED_SQL),
    "time_utc": (utc_times, UTC_SQL),
}
