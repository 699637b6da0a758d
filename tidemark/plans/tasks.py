"""Task queries: outbox, delegation, registry search, path patches, reviews, lineage, artifacts, library commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import tasks as T
from tidemark.sources.tables import read

NOW_US = 1704196800000000  # 2024-01-02 12:00:00 UTC
WORKER, LIMIT = "w1", 500


def _outbox(spark, sf_dir):
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    status = F.when(k % 5 == 0, "DONE").when(k % 5 == 1, "CLAIMED").when(k % 5 == 2, "FAILED").otherwise("PENDING")
    claimed = k % 5 == 1
    return e.select("event_id", status.alias("status"), at.alias("available_us"), F.when(claimed, F.concat(F.lit("w"), k % 2)).alias("claimed_by"), F.when(claimed, F.when(k % 3 == 0, at).otherwise(NOW_US - 1)).alias("claimed_us"), (k % 4).cast("int").alias("attempts"))


OUTBOX_SQL = f"""box AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'DONE' WHEN 1 THEN 'CLAIMED' WHEN 2 THEN 'FAILED' ELSE 'PENDING' END AS status, epoch_us(ts) AS due_us, CASE WHEN event_id % 5 = 1 THEN 'w' || (event_id % 2) END AS claimed_by,
CASE WHEN event_id % 5 = 1 THEN CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) ELSE {NOW_US - 1} END END AS claimed_us, event_id % 4 AS attempts FROM events),
due AS (SELECT event_id FROM box WHERE due_us <= {NOW_US} AND (status IN ('PENDING', 'FAILED') OR (status = 'CLAIMED' AND claimed_us <= {NOW_US} - 300000000)) ORDER BY due_us, event_id LIMIT {LIMIT}),
claimed AS (SELECT b.event_id, b.due_us, CASE WHEN d.event_id IS NOT NULL THEN 'CLAIMED' ELSE status END AS status, CASE WHEN d.event_id IS NOT NULL THEN '{WORKER}' ELSE claimed_by END AS claimed_by, CASE WHEN d.event_id IS NOT NULL THEN {NOW_US} ELSE claimed_us END AS claimed_us, attempts + CASE WHEN d.event_id IS NOT NULL THEN 1 ELSE 0 END AS attempts
FROM box b LEFT JOIN due d ON b.event_id = d.event_id)"""


def outbox_claims(spark, sf_dir):
    """ST6: a worker claims the first 500 events due."""
    out = T.claim_outbox(_outbox(spark, sf_dir), WORKER, NOW_US, LIMIT)
    return out.select("event_id", "status", F.coalesce("claimed_by", F.lit("")).alias("claimed_by"), F.coalesce("claimed_us", F.lit(-1)).alias("claimed_us"), "attempts")


CLAIM_SQL = f"WITH {OUTBOX_SQL} SELECT event_id, status, coalesce(claimed_by, '') AS claimed_by, coalesce(claimed_us, -1) AS claimed_us, attempts FROM claimed"


def outbox_finish(spark, sf_dir):
    """ST6: the worker reports on every third event, of those every second with an error, whether it holds them or not."""
    box, k = _outbox(spark, sf_dir), F.col("event_id")
    results = read(spark, sf_dir, "events").filter(k % 3 == 0).select("event_id", F.lit(WORKER).alias("worker"), F.when(k % 2 == 0, "timeout").alias("error"))
    out = T.finish_outbox(T.claim_outbox(box, WORKER, NOW_US, LIMIT), results, NOW_US + 60000000)
    return out.select("event_id", "status", F.coalesce("claimed_by", F.lit("")).alias("claimed_by"), "available_us", F.coalesce("outcome", F.lit("")).alias("outcome"))


FINISH_SQL = f"""WITH {OUTBOX_SQL}, f AS (SELECT *, event_id % 3 = 0 AND status = 'CLAIMED' AND coalesce(claimed_by, '') = '{WORKER}' AS good FROM claimed)
SELECT event_id, CASE WHEN good THEN CASE WHEN event_id % 2 = 0 THEN 'FAILED' ELSE 'DONE' END ELSE status END AS status, CASE WHEN good THEN '' ELSE coalesce(claimed_by, '') END AS claimed_by, CASE WHEN good THEN {NOW_US + 60000000} ELSE due_us END AS available_us, CASE WHEN good THEN 'APPLIED' WHEN event_id % 3 = 0 THEN 'CONFLICT' ELSE '' END AS outcome FROM f"""


def delegated(spark, sf_dir):
    """Customers as runs with a root task; open orders are their tasks, the others ask to delegate, some below the root of another run."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    run, root = F.col("o_custkey").alias("run_id"), -F.col("o_custkey") - 1
    roots = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), (-F.col("c_custkey") - 1).alias("task_id"), F.lit(None).cast("long").alias("parent_id"), F.lit("A0").alias("role"), F.lit("all").alias("scope"), F.lit("RUNNING").alias("status"))
    old = o.filter("o_orderstatus = 'O'").select(run, k.alias("task_id"), root.alias("parent_id"), F.when(k % 2 == 0, "A2").otherwise("A1").alias("role"), F.col("o_orderpriority").alias("scope"), F.when(k % 3 == 0, "WAITING").otherwise("COMPLETED").alias("status"))
    role = F.when(k % 13 == 0, "A5").when(k % 4 == 3, "A3").otherwise("A2")
    asked = o.filter("o_orderstatus <> 'O'").select(run, k.alias("request_no"), F.when(k % 11 == 0, root - 1).otherwise(root).alias("parent_id"), k.alias("child_id"), role.alias("role"), F.when(k % 17 == 0, " ").otherwise(F.col("o_orderpriority")).alias("scope"))
    return T.delegations(roots.union(old), asked).select("run_id", "request_no", "outcome")


DELEGATED_SQL = """WITH RECURSIVE a AS (SELECT o_custkey AS run_id, o_orderpriority AS scope FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0 AND o_orderkey % 3 = 0),
b AS (SELECT run_id, list(scope) AS held, count(*) AS n FROM a GROUP BY 1),
q AS (SELECT o_custkey AS run_id, o_orderkey AS request_no, CASE WHEN o_orderkey % 13 = 0 THEN 'A5' WHEN o_orderkey % 4 = 3 THEN 'A3' ELSE 'A2' END AS role, CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE o_orderpriority END AS scope, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders WHERE o_orderstatus <> 'O'),
w AS (SELECT *, CASE WHEN role = 'A5' THEN 'BAD_ROLE' WHEN scope = ' ' THEN 'BAD_SCOPE' WHEN request_no % 11 = 0 OR run_id NOT IN (SELECT c_custkey FROM customer) THEN 'NO_PARENT' WHEN role <> 'A2' THEN 'DELEGATED' END AS why FROM q),
r(run_id, request_no, i, held, n, outcome) AS (SELECT run_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), coalesce(held, CAST([] AS VARCHAR[])), coalesce(n, 0), '' FROM (SELECT DISTINCT run_id FROM q) LEFT JOIN b USING (run_id)
UNION ALL SELECT w.run_id, w.request_no, w.i, CASE WHEN why IS NULL AND NOT list_contains(held, scope) AND n < 2 THEN list_append(held, scope) ELSE held END, n + CASE WHEN why IS NULL AND NOT list_contains(held, scope) AND n < 2 THEN 1 ELSE 0 END,
coalesce(why, CASE WHEN list_contains(held, scope) THEN 'SCOPE_OWNED' WHEN n >= 2 THEN 'LIMIT' ELSE 'DELEGATED' END) FROM r JOIN w ON w.run_id = r.run_id AND w.i = r.i + 1)
SELECT run_id, request_no, outcome FROM r WHERE i > 0"""


#: A page behind the last one of any table.
PAST = 2**63 - 1


def search(spark, sf_dir):
    """a page far behind the last one of active runs of a scene and provider in thirty days whose id or mode holds "1"."""
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 2 == 0, "post close").otherwise("Intraday").alias("mode"), F.col("o_orderstatus").alias("status"), F.when(k % 2 == 0, "post_close").otherwise("intraday").alias("scene"), F.substring("o_orderpriority", 1, 1).alias("provider"), F.col("o_orderdate").alias("requested_at"))
    return T.registry_search(rows, ["O", "P"], "1998-08-02 00:00:00", needle="1 I", status="RUNNING", scene="intraday", provider="3", days=900, page=PAST).select("id", "mode", "status", "provider", "position", "total")


SEARCH_SQL = """WITH r AS (SELECT o_orderkey AS id, 'Intraday' AS mode, o_orderstatus AS status, '3' AS provider, o_orderdate AS asked FROM orders WHERE o_orderkey % 2 <> 0 AND contains(lower(o_orderkey || ' Intraday'), '1 i') AND o_orderstatus IN ('O', 'P') AND substr(o_orderpriority, 1, 1) = '3' AND o_orderdate >= TIMESTAMP '1998-08-02' - INTERVAL 900 DAY),
n AS (SELECT *, row_number() OVER (ORDER BY asked DESC, id) AS position, count(*) OVER () AS total FROM r) SELECT id, mode, status, provider, position, total FROM n WHERE position > (greatest(1, ceil(total / 20.0)) - 1) * 20"""


def path_patches(spark, sf_dir):
    """Drafts of four passages as titles, headings and bodies; some patch sets chain two edits of a body, some expect an old version, an unknown path or another value."""
    b = read(spark, sf_dir, "benchmark")
    k, draft = F.col("item_id"), F.floor(F.col("item_id") / 4).alias("draft_id")
    body = F.concat(F.lit("sections/"), k, F.lit("/body"))
    pairs = F.array(F.struct(body.alias("path"), F.col("text").alias("value")), F.struct(F.concat(F.lit("sections/"), k, F.lit("/heading")).alias("path"), F.substring("text", 1, 20).alias("value")), F.struct(F.concat(F.lit("titles/"), k % 4).alias("path"), F.concat(F.lit("T"), k).alias("value")))
    fields = b.select(draft, F.explode(pairs).alias("p")).select("draft_id", "p.path", "p.value")
    versions = b.select(draft).distinct().withColumn("version", F.lit(3))
    d = F.floor(k / 4)
    new = F.concat(F.lit("new "), k)
    ops = F.array(
        F.struct(F.lit(1).alias("op_no"), F.when(d % 5 == 1, F.lit("sections/none/body")).otherwise(body).alias("path"), F.sha2("text", 256).alias("old_hash"), new.alias("value")),
        F.struct(F.lit(2).alias("op_no"), F.when(d % 5 == 1, F.lit("sections/none/body")).otherwise(body).alias("path"), F.when(d % 5 == 2, F.lit("stale")).otherwise(F.sha2(new, 256)).alias("old_hash"), F.concat(new, F.lit("!")).alias("value")),
    )
    asked = b.filter(k % 4 < 2).filter(d % 6 != 5).select(draft, F.when(d % 5 == 0, 2).otherwise(3).alias("base_version"), k.alias("k"), F.explode(ops).alias("o"))
    patches = asked.select("draft_id", "base_version", (F.col("k") * 2 + F.col("o.op_no")).alias("op_no"), "o.path", "o.old_hash", "o.value")
    after, outcomes = T.patch_paths(fields, versions, patches)
    return after.join(outcomes, "draft_id").select("draft_id", "path", F.sha2("value", 256).alias("hash"), "version", F.coalesce("outcome", F.lit("")).alias("outcome"))


PATHS_SQL = """WITH b AS (SELECT *, item_id // 4 AS d, item_id % 4 AS i FROM benchmark),
o AS (SELECT *, CASE WHEN d % 6 = 5 THEN '' WHEN d % 5 = 0 THEN 'STALE_VERSION' WHEN d % 5 = 1 THEN 'BAD_PATH' WHEN d % 5 = 2 THEN 'STALE_VALUE' ELSE 'APPLIED' END AS outcome FROM b),
f AS (SELECT d, i, outcome, item_id, 'sections/' || item_id || '/body' AS path, CASE WHEN outcome = 'APPLIED' AND i < 2 THEN 'new ' || item_id || '!' ELSE text END AS value FROM o
UNION ALL SELECT d, i, outcome, item_id, 'sections/' || item_id || '/heading', substr(text, 1, 20) FROM o UNION ALL SELECT d, i, outcome, item_id, 'titles/' || i, 'T' || item_id FROM o)
SELECT d AS draft_id, path, sha256(value) AS hash, CASE WHEN outcome = 'APPLIED' THEN 4 ELSE 3 END AS version, outcome FROM f"""


def draft_reviews(spark, sf_dir):
    """Returned lines as reviews of the line number's version; open lines are the versions that exist."""
    li = read(spark, sf_dir, "lineitem")
    reviews = li.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("draft_id"), F.col("l_linenumber").alias("draft_version"), F.col("l_partkey").alias("review_id"), F.col("l_suppkey").alias("verdict"))
    drafts = li.filter("l_linestatus = 'O'").select(F.col("l_orderkey").alias("draft_id"), F.col("l_linenumber").alias("version")).distinct()
    return T.newest_reviews(reviews, drafts)


REVIEWS_SQL = """SELECT l_orderkey AS draft_id, l_linenumber AS draft_version, l_partkey AS review_id, l_suppkey AS verdict FROM lineitem WHERE l_returnflag = 'R' AND (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_linestatus = 'O')
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1"""


def lineage(spark, sf_dir):
    """Users as runs linked to their events; documents belong to the events of their id and of the next one, and to one run by id."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_id")
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"))
    bridge = d.select("document_id", F.explode(F.array("document_id", F.col("document_id") + 1)).alias("event_id"))
    return T.run_documents(e, bridge, d.select((F.col("document_id") % 50).alias("run_id"), "document_id"))


LINEAGE_SQL = """SELECT user_id AS run_id, doc_id AS document_id FROM events JOIN documents ON event_id = doc_id UNION SELECT user_id, doc_id FROM events JOIN documents ON event_id = doc_id + 1 UNION SELECT doc_id % 50, doc_id FROM documents"""


def artifacts(spark, sf_dir):
    """Orders as tasks in their third attempt at most, lines as artifacts of the attempt of their number."""
    tasks = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), (F.col("o_orderkey") % 3 + 1).alias("attempt"))
    made = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").cast("long").alias("attempt"))
    return T.task_artifacts(tasks, made)


ARTIFACTS_SQL = """SELECT o_orderkey AS task_id, o_orderkey % 3 + 1 AS attempt, count(l_orderkey) FILTER (l_linenumber = o_orderkey % 3 + 1) AS owned, count(l_orderkey) FILTER (l_linenumber <> o_orderkey % 3 + 1) AS stale FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"""
NOW = "1999-01-01 00:00:00"


def library(spark, sf_dir):
    """Orders as library documents, finished ones deleted; commands by key."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    gone = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    docs = o.select(k.alias("document_id"), gone.alias("deleted_at"), (gone + F.expr("INTERVAL 30 DAYS")).alias("purge_after"), F.lit(1.0).alias("source_weight"))
    commands = o.filter(k % 4 != 3).select(k.alias("document_id"), F.element_at(F.array(F.lit("DELETE"), F.lit("RESTORE"), F.lit("WEIGHT")), (k % 4 + 1).cast("int")).alias("command"), F.lit(0.5).alias("weight"))
    out = T.library_commands(docs, commands, NOW, 90)
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("")).alias(c)
    return out.select("document_id", day("deleted_at"), day("purge_after"), "source_weight", F.coalesce("outcome", F.lit("")).alias("outcome"))


LIBRARY_SQL = f"""WITH d AS (SELECT o_orderkey AS document_id, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS del, o_orderkey % 4 AS c FROM orders),
e AS (SELECT *, CASE WHEN c = 3 THEN '' WHEN (c = 1) = (del IS NOT NULL) THEN 'APPLIED' ELSE 'CONFLICT' END AS outcome FROM d),
f AS (SELECT *, CASE WHEN outcome = 'APPLIED' AND c = 0 THEN TIMESTAMP '{NOW}' WHEN outcome = 'APPLIED' AND c = 1 THEN NULL ELSE del END AS gone FROM e)
SELECT document_id, coalesce(strftime(gone, '%Y-%m-%d'), '') AS deleted_at, coalesce(strftime(gone + CASE WHEN outcome = 'APPLIED' AND c = 0 THEN INTERVAL 90 DAY ELSE INTERVAL 30 DAY END, '%Y-%m-%d'), '') AS purge_after, CASE WHEN outcome = 'APPLIED' AND c = 2 THEN 0.5 ELSE 1.0 END AS source_weight, outcome FROM f"""

QUERIES = {
    "state_outbox_claims": (outbox_claims, CLAIM_SQL),
    "state_outbox_finish": (outbox_finish, FINISH_SQL),
    "state_delegations": (delegated, DELEGATED_SQL),
    "runs_registry_search": (search, SEARCH_SQL),
    "review_path_patches": (path_patches, PATHS_SQL),
    "store_draft_reviews": (draft_reviews, REVIEWS_SQL),
    "records_run_documents": (lineage, LINEAGE_SQL),
    "records_task_artifacts": (artifacts, ARTIFACTS_SQL),
    "store_library_commands": (library, LIBRARY_SQL),
}
