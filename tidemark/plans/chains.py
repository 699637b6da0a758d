"""Queries of revision chains, payload columns, feeds, claim classes and cache keys."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import claims as C
from tidemark.operators import payloads as P
from tidemark.operators import records as R
from tidemark.operators import revisions as V
from tidemark.operators import workbench as W
from tidemark.plans.retrieval import _GRAMS
from tidemark.sources.steps import shared_root, written
from tidemark.sources.tables import read, spread


def revision_chain(spark, sf_dir):
    """Events as saves to one snapshot an event type by many users; each expects the revision that it read up to three steps ago."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    expected = F.when(F.col("event_id") >= 60, F.floor(F.col("event_id") / 60) - 1 - k % 3)
    saves = read(spark, sf_dir, "events").select("event_id", "event_type", expected.alias("expected"))
    out = V.chained(saves, "event_type", "event_id")
    return out.select("event_id", "event_type", "accepted", F.coalesce("revision", F.lit(-1)).alias("revision"))


REVISION_SQL = """WITH RECURSIVE s AS MATERIALIZED (SELECT event_id, event_type, CASE WHEN event_id >= 60 THEN event_id // 60 - coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) % 3 ELSE 0 END AS made, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events),
c(event_type, n, event_id, rev, ok) AS (SELECT DISTINCT event_type, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), false FROM s
UNION ALL SELECT c.event_type, s.n, s.event_id, CASE WHEN s.made = c.rev + 1 THEN c.rev + 1 ELSE c.rev END, s.made = c.rev + 1 FROM c JOIN s ON s.event_type = c.event_type AND s.n = c.n + 1)
SELECT event_id, event_type, ok AS accepted, CASE WHEN ok THEN rev ELSE -1 END AS revision FROM c WHERE n > 0"""


def _saved(spark, sf_dir):
    """Orders with their lines as payload texts; every fiftieth is cut short, every seventieth has none."""
    k = F.col("o_orderkey")
    line = F.struct(F.col("l_partkey").alias("part"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.col("l_linenumber").alias("line"))
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    text = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), k.alias("order"), F.coalesce("lines", F.array()).alias("lines")))
    payload = F.when(k % 70 == 0, None).when(k % 50 == 0, F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    o = read(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").withColumn("text", text)
    return o.select(F.col("o_custkey").alias("run"), F.col("o_orderpriority").alias("kind"), k.alias("saved"), payload.alias("payload"))


def payload_snapshots(spark, sf_dir):
    """JS1, V1, S25, T20: the last readable payload of each customer and priority, read by path, with its digest and the number of saves that could not be read."""
    good, bad = P.split_payloads(_saved(spark, sf_dir))
    good = written(good, "payloads")
    last = P.newest(good, ["run", "kind"], "saved")
    broken = bad.groupBy("run", "kind").agg(F.count("*").alias("malformed"))
    lines = F.variant_get("payload", "$.lines", "array<struct<part: bigint, cents: bigint>>")
    cents = F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + x["cents"])
    out = last.select("run", "kind", F.variant_get("payload", "$.order", "bigint").alias("order_id"), F.variant_get("payload", "$.status", "string").alias("status"), F.size(lines).alias("lines"), cents.alias("cents"), P.canonical_digest("payload").alias("digest"))
    return out.join(broken, ["run", "kind"], "full").select("run", "kind", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("order_id", "lines", "cents")], *[F.coalesce(c, F.lit("")).alias(c) for c in ("status", "digest")], F.coalesce("malformed", F.lit(0)).alias("malformed"))


PAYLOAD_SQL = """WITH l AS (SELECT l_orderkey AS k, count(*) AS lines, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
string_agg('{"cents":' || CAST(round(l_extendedprice * 100) AS BIGINT) || ',"line":' || l_linenumber || ',"part":' || l_partkey || '}', ',' ORDER BY l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT), l_linenumber) AS items FROM lineitem GROUP BY 1),
o AS (SELECT o_custkey AS run, o_orderpriority AS kind, o_orderkey AS k, o_orderstatus AS status, coalesce(lines, 0) AS lines, coalesce(cents, 0) AS cents, coalesce(items, '') AS items FROM orders LEFT JOIN l ON l.k = o_orderkey),
b AS (SELECT run, kind, count(*) AS malformed FROM o WHERE k % 50 = 0 AND k % 70 <> 0 GROUP BY 1, 2),
g AS (SELECT * FROM o WHERE k % 50 <> 0 AND k % 70 <> 0 QUALIFY row_number() OVER (PARTITION BY run, kind ORDER BY k DESC) = 1)
SELECT run, kind, coalesce(k, -1) AS order_id, CAST(coalesce(lines, -1) AS INT) AS lines, coalesce(cents, -1) AS cents, coalesce(status, '') AS status,
CASE WHEN k IS NULL THEN '' ELSE sha256('{"lines":[' || items || '],"order":' || k || ',"status":"' || status || '"}') END AS digest, coalesce(malformed, 0) AS malformed FROM g FULL JOIN b USING (run, kind)"""


def _feeds(spark, sf_dir):
    """Pages as RSS files in the shared folder: their title's markup, url and a date. Every eleventh date has no zone, every thirteenth item no link, every seventeenth is no XML."""
    k = F.col("page_id")
    when = F.date_format(F.timestamp_seconds(F.lit(1704067200) + k * 3600), "dd MMM yyyy HH:mm:ss")
    zone = F.when(k % 11 == 0, "").when(k % 3 == 0, " GMT").when(k % 3 == 1, " +0800").otherwise(" -0330")
    date = F.when(k % 19 != 0, F.concat(F.lit("Mon, "), when, zone))
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    element = lambda name, c: F.concat(F.lit(f"<{name}>"), escaped(F.coalesce(c, F.lit(""))), F.lit(f"</{name}>"))
    inner = F.concat(element("guid", F.when(k % 5 != 0, k.cast("string"))), element("title", title), element("link", F.when(k % 13 != 0, F.col("url"))), element("pubDate", date))
    rows = spread(read(spark, sf_dir, "pages"), "page_id").select(F.concat(F.lit("<item>"), inner, F.when(k % 17 == 0, "<open>").otherwise(""), F.lit("</item>")).alias("value"))
    path = f"{shared_root(spark)}/tidemark/feeds-{uuid.uuid4().hex}"
    rows.write.text(path)
    return path


def feed_items(spark, sf_dir):
    """Every item of the feeds, good or with its problem."""
    out = R.feed_items(R.rss_items(spark, _feeds(spark, sf_dir)))
    bad = F.col("problem") == "MALFORMED"
    shown = lambda c, other: F.when(F.coalesce(bad, F.lit(False)), other).otherwise(F.coalesce(c, F.lit(other)))
    return out.select(shown(F.col("item_id"), "").alias("item_id"), shown(F.col("link"), "").alias("link"), shown(F.col("published_us"), -1).alias("published_us"), shown(F.col("content_hash"), "").alias("content_hash"), F.coalesce("problem", F.lit("")).alias("problem"))


FEED_SQL = r"""WITH p AS (SELECT page_id AS k, trim(regexp_extract(html, '<title>(.*?)</title>', 1, 's')) AS title, CASE WHEN page_id % 13 <> 0 AND trim(url) <> '' THEN trim(url) END AS url FROM pages),
q AS (SELECT *, sha256(title || chr(10) || coalesce(url, '')) AS h, k % 17 = 0 AS bad, CASE WHEN k % 19 <> 0 AND k % 11 <> 0 THEN (1704067200 + k * 3600 - CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 28800 ELSE -12600 END) * 1000000 END AS us FROM p)
SELECT CASE WHEN bad THEN '' WHEN k % 5 <> 0 THEN CAST(k AS VARCHAR) ELSE coalesce(url, h) END AS item_id,
CASE WHEN bad OR url IS NULL THEN '' ELSE lower(regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1)) || regexp_replace(substr(url, length(regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1)) + 1), '#.*$', '') END AS link,
CASE WHEN bad OR us IS NULL THEN -1 ELSE us END AS published_us, CASE WHEN bad THEN '' ELSE h END AS content_hash,
CASE WHEN bad THEN 'MALFORMED' WHEN url IS NULL THEN 'NO_LINK' WHEN k % 19 <> 0 AND k % 11 = 0 THEN 'BAD_DATE' ELSE '' END AS problem FROM q"""


ATTRIBUTES = ["subject", "predicate", "text", "stance", "start", "end", "document_id", "version", "version_id", "status", "weight", "grade", "relevance"]


def _order_claims(spark, sf_dir):
    """Orders as claims about a segment of a nation, in words, valid in the year of the order; every fiftieth states no time."""
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "c_mktsegment", "n_name")
    o = read(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    k, stance, year = F.col("o_orderkey"), F.col("o_orderstatus"), F.year("o_orderdate")
    words = F.when(stance == "F", " was delivered as agreed with the buyer").when(stance == "O", " was not delivered as agreed with the buyer").otherwise(" came in parts, the first of them early")
    document, version = k % 2, F.floor(k / 2) % 2
    return o.select(
        k.alias("claim_id"),
        F.col("c_nationkey").alias("subject"),
        F.col("c_mktsegment").alias("predicate"),
        F.concat("c_mktsegment", F.lit(" of "), "n_name", words).alias("text"),
        stance.alias("stance"),
        F.when(k % 50 != 0, F.make_date(year, F.lit(1), F.lit(1))).alias("start"),
        F.when(k % 50 != 0, F.make_date(year, F.lit(12), F.lit(31))).alias("end"),
        document.alias("document_id"),
        version.alias("version"),
        (document * 10 + version).alias("version_id"),
        F.when((document == 0) & (version == 0), "SUPERSEDED").otherwise("ACTIVE").alias("status"),
        document.alias("weight"),
        F.when(stance != "P", 1).otherwise(0).alias("grade"),
        F.when(F.col("o_totalprice") > 100000, 1.0).otherwise(0.5).alias("relevance"),
    )


def class_conflicts(spark, sf_dir):
    """Claims as classes, the verdict of each pair of classes from its texts, the decision with the number of claim pairs it stands for."""
    classes = written(C.claim_classes(_order_claims(spark, sf_dir), ATTRIBUTES), "claim-classes")
    verdicts = written(W.text_verdicts(classes, ["subject", "predicate"]), "claim-verdicts")
    pairs = C.claim_pairs(C.comparable_groups(classes, ["subject", "predicate"]), ["subject", "predicate", "component"])
    window = (F.lit("1995-01-01").cast("date"), F.lit("1995-12-31").cast("date"))
    out = C.resolve(pairs.join(verdicts, ["text_l", "text_r"], "left"), window)
    winner = F.when(F.col("winner") == "l", F.col("claim_id_l")).when(F.col("winner") == "r", F.col("claim_id_r")).otherwise(-1)
    return out.select("subject", "predicate", F.col("claim_id_l").alias("first_l"), F.col("claim_id_r").alias("first_r"), (F.col("n_l") * F.col("n_r")).alias("pairs"), "decision", F.coalesce("rule", F.lit("")).alias("rule"), winner.alias("winner"))


_SHORT, _LONG = "CASE WHEN length(a) <= length(b) THEN a ELSE b END", "CASE WHEN length(a) <= length(b) THEN b ELSE a END"
CLASS_SQL = rf"""WITH c AS MATERIALIZED (SELECT o_orderkey AS id, c_nationkey AS subject, c_mktsegment AS predicate, c_mktsegment || ' of ' || n_name || CASE o_orderstatus WHEN 'F' THEN ' was delivered as agreed with the buyer' WHEN 'O' THEN ' was not delivered as agreed with the buyer' ELSE ' came in parts, the first of them early' END AS text, o_orderstatus AS stance,
CASE WHEN o_orderkey % 50 <> 0 THEN year(o_orderdate) END AS y, o_orderkey % 2 AS d, o_orderkey // 2 % 2 AS v, NOT (o_orderkey % 2 = 0 AND o_orderkey // 2 % 2 = 0) AS active, o_orderkey % 2 AS w, CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END AS g, CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE 0.5 END AS rel
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
k AS MATERIALIZED (SELECT *, min(id) OVER (PARTITION BY subject, predicate, text, stance, y, d, v, active, w, g, rel) AS first, bool_or(y IS NULL) OVER (PARTITION BY subject, predicate) AS open FROM c),
t AS (SELECT DISTINCT l.text AS a, r.text AS b FROM (SELECT DISTINCT subject, predicate, text FROM c) l JOIN (SELECT DISTINCT subject, predicate, text FROM c) r USING (subject, predicate)),
u AS (SELECT a, b, regexp_replace({_SHORT}, '\s+', '', 'g') AS s, regexp_replace({_LONG}, '\s+', '', 'g') AS g FROM t),
o AS MATERIALIZED (SELECT a, b, CAST(len(list_intersect({_GRAMS("s")}, {_GRAMS("g")})) AS DOUBLE) / len({_GRAMS("s")}) AS o, contains(a, ' not ') <> contains(b, ' not ') AS neg FROM u),
p AS (SELECT l.subject AS subject, l.predicate AS predicate, l AS l, r AS r, coalesce(l.y <> r.y, false) AS apart, coalesce(l.y = 1995, false) AS ml, coalesce(r.y = 1995, false) AS mr FROM k l JOIN k r ON l.subject = r.subject AND l.predicate = r.predicate AND l.first < r.first AND (l.open OR l.y = r.y) WHERE NOT (l.d = r.d AND l.v = r.v AND l.stance IS NOT DISTINCT FROM r.stance)),
q AS (SELECT p.*, CASE WHEN neg THEN 'CONTRADICTION' WHEN o >= 0.5 THEN 'ENTAILMENT' ELSE 'UNCERTAIN' END AS relation, CASE WHEN neg THEN least(0.99, 1 - o / 2) WHEN o >= 0.5 THEN least(0.99, 0.5 + o / 2) ELSE o / 2 END AS conf FROM p JOIN o ON o.a = l.text AND o.b = r.text),
x AS (SELECT *, NOT apart AND relation = 'CONTRADICTION' AND conf >= 0.7 AS fight,
CASE WHEN l.active <> r.active THEN 'STATUS' WHEN l.d = r.d AND l.v <> r.v THEN 'EXPLICIT_VERSION' WHEN ml <> mr THEN 'EFFECTIVE_TIME' WHEN l.w <> r.w THEN 'SOURCE_WEIGHT' WHEN l.g <> r.g THEN 'EVIDENCE_QUALITY' WHEN l.d = r.d AND l.rel <> r.rel THEN 'RELEVANCE' END AS rule,
CASE WHEN l.active <> r.active THEN l.active WHEN l.d = r.d AND l.v <> r.v THEN l.v > r.v WHEN ml <> mr THEN ml WHEN l.w <> r.w THEN l.w > r.w WHEN l.g <> r.g THEN l.g > r.g ELSE l.rel > r.rel END AS won FROM q)
SELECT subject, predicate, l.first AS first_l, r.first AS first_r, count(*) AS pairs, CASE WHEN apart THEN 'NOT_CONFLICT' WHEN conf < 0.7 OR relation = 'UNCERTAIN' THEN 'UNRESOLVED' WHEN relation <> 'CONTRADICTION' THEN 'NOT_CONFLICT' WHEN rule IS NULL THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS decision,
CASE WHEN apart THEN 'EFFECTIVE_TIME' WHEN fight THEN coalesce(rule, '') ELSE '' END AS rule, CASE WHEN fight AND rule IS NOT NULL THEN CASE WHEN won THEN l.first ELSE r.first END ELSE -1 END AS winner FROM x GROUP BY ALL"""


def generation_keys(spark, sf_dir):
    """Seven-part keys of the customers' questions against the generation of all documents; every ninth names no reranker and gets none."""
    state = F.when(F.col("quality") == 1, "ACTIVE").otherwise("SUPERSEDED")
    d, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", state.alias("status"), (F.col("toxic") == 1).alias("deleted"))
    entry = F.concat_ws("|", F.col("doc_id").cast("string"), F.coalesce("status", F.lit("NONE")), F.coalesce("deleted", F.lit(False)).cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256))
    generation = R.corpus_generation(d.join(labels, "doc_id", "left").select(entry.alias("entry")), "entry")
    c = read(spark, sf_dir, "customer").crossJoin(generation)
    k = F.col("c_custkey")
    key, missing = R.seven_part_key(
        query_fingerprint=F.sha2("c_name", 256),
        corpus_generation=F.col("generation"),
        filters=F.to_json(F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))),
        embedding_model_version=F.lit("hash-256"),
        reranker_model_version=F.when(k % 9 != 0, "overlap-1"),
        nli_model_version=F.when(k % 2 == 0, "rule-1").otherwise("not-used"),
        conflict_policy_version=F.lit(R.policy_version(min_nli_confidence=0.7, min_claim_confidence=0.5)),
    )
    return c.select(k.alias("c_custkey"), "generation", F.coalesce(key, F.lit("")).alias("key"), F.coalesce(missing, F.lit("")).alias("missing"))


_WORDS = " || '-' || ".join(f"CAST(coalesce(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)), 0) AS BIGINT)" for i in range(8))
KEYS_SQL = rf"""WITH e AS (SELECT sha256(d.doc_id || '|' || CASE WHEN l.doc_id IS NULL THEN 'NONE' WHEN quality = 1 THEN 'ACTIVE' ELSE 'SUPERSEDED' END || '|' || coalesce(toxic = 1, false) || '|' || sha256(coalesce(text, ''))) AS h FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
g AS (SELECT 'corpus_' || substr(sha256({_WORDS}), 1, 24) AS generation FROM e)
SELECT c_custkey, generation, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'rk_' || substr(sha256('{{"conflict_policy_version":"cp_' || substr(sha256('min_nli_confidence=0.7|min_claim_confidence=0.5'), 1, 12) || '","corpus_generation":"' || generation || '","embedding_model_version":"hash-256","filters":"{{\"nation\":' || c_nationkey || ',\"segment\":\"' || c_mktsegment || '\"}}","nli_model_version":"' || CASE WHEN c_custkey % 2 = 0 THEN 'rule-1' ELSE 'not-used' END || '","query_fingerprint":"' || sha256(c_name) || '","reranker_model_version":"overlap-1"}}'), 1, 32) END AS key,
CASE WHEN c_custkey % 9 = 0 THEN 'reranker_model_version' ELSE '' END AS missing FROM customer, g"""


QUERIES = {
    "store_revision_chain": (revision_chain, REVISION_SQL),
    "store_payload_snapshots": (payload_snapshots, PAYLOAD_SQL),
    "news_feed_items": (feed_items, FEED_SQL),
    "claims_class_conflicts": (class_conflicts, CLASS_SQL),
    "rag_generation_keys": (generation_keys, KEYS_SQL),
}
