"""Run queries: comparison of two runs, operations, reviews, ledgers, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.time import next_occurrence
from tidemark.operators import market as M
from tidemark.operators import runs as R
from tidemark.plans import market
from tidemark.sources.tables import read

FIELDS = ["rank", "score", "pct_change"]


def _sides(spark, sf_dir):
    c = market.candidate_rank(spark, sf_dir)
    return c.filter("run_id = 'base'"), c.filter("run_id = 'compare'")


def comparison(spark, sf_dir):
    base, other = _sides(spark, sf_dir)
    out = R.compare(base, other, ["kind", "sector_id"], FIELDS)
    names = [f"{p}_{f}" for f in FIELDS for p in ("base", "compare", "delta")]
    filled = [F.round(F.coalesce(F.col(n).cast("double"), F.lit(-999.0)), 6).alias(n) for n in names]
    return out.select("kind", "sector_id", "membership", *filled, *[f"why_{f}" for f in FIELDS])


_F = ", ".join(f"round(coalesce(CAST(b.{f} AS DOUBLE), -999), 6) AS base_{f}, round(coalesce(CAST(o.{f} AS DOUBLE), -999), 6) AS compare_{f}, round(coalesce(CAST(o.{f} - b.{f} AS DOUBLE), -999), 6) AS delta_{f}, CASE WHEN b.sector_id IS NULL OR o.sector_id IS NULL THEN 'SECTOR_MISSING' WHEN o.{f} - b.{f} IS NULL THEN 'VALUE_MISSING' ELSE '' END AS why_{f}" for f in FIELDS)
COMPARISON_SQL = f"""WITH cand AS ({market.CANDIDATE_SQL}) SELECT coalesce(b.kind, o.kind) AS kind, coalesce(b.sector_id, o.sector_id) AS sector_id, CASE WHEN b.sector_id IS NULL THEN 'ONLY_COMPARE' WHEN o.sector_id IS NULL THEN 'ONLY_BASE' ELSE 'BOTH' END AS membership, {_F}
FROM (SELECT * FROM cand WHERE run_id = 'base') b FULL JOIN (SELECT * FROM cand WHERE run_id = 'compare') o ON b.kind = o.kind AND b.sector_id = o.sector_id"""


def comparison_counts(spark, sf_dir):
    return comparison(spark, sf_dir).groupBy("kind").agg(*[F.count_if(F.col("membership") == m).alias(m.lower()) for m in ("BOTH", "ONLY_BASE", "ONLY_COMPARE")])


COMPARISON_COUNTS_SQL = f"WITH c AS ({COMPARISON_SQL}) SELECT kind, count(*) FILTER (membership = 'BOTH') AS both, count(*) FILTER (membership = 'ONLY_BASE') AS only_base, count(*) FILTER (membership = 'ONLY_COMPARE') AS only_compare FROM c GROUP BY 1"


def comparison_order(spark, sf_dir):
    """L4: the comparison's rows in their fixed order, missing ranks last."""
    base, other = _sides(spark, sf_dir)
    out = R.compare(base, other, ["kind", "sector_id"], ["rank"])
    ranked = M.ranked(out, [F.asc_nulls_last("compare_rank"), F.asc_nulls_last("base_rank"), F.asc("kind"), F.asc("sector_id")], None, None, "position")
    return ranked.select("kind", "sector_id", "position")


ORDER_SQL = f"WITH c AS ({COMPARISON_SQL}) SELECT kind, sector_id, CAST(row_number() OVER (ORDER BY compare_rank = -999, compare_rank, base_rank = -999, base_rank, kind, sector_id) AS INT) AS position FROM c"


def _content(spark, sf_dir):
    """Content runs: orders of every priority but the lowest. With the data runs they cover all orders."""
    o = read(spark, sf_dir, "orders").filter(~F.col("o_orderpriority").eqNullSafe("5-LOW"))
    return o.select(F.col("o_orderkey").alias("run_id"), F.lit("content").alias("kind"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("requested_at"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cost"))


def _data(spark, sf_dir):
    """Data runs: orders of every priority but the highest, without a cost; most are content runs too."""
    o = read(spark, sf_dir, "orders").filter(~F.col("o_orderpriority").eqNullSafe("1-URGENT"))
    return o.select(F.col("o_orderkey").alias("run_id"), F.lit("data").alias("kind"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("requested_at"))


RUNS_SQL = """content AS (SELECT o_orderkey AS run_id, 'content' AS kind, o_orderstatus AS status, o_orderdate AS requested_at, CAST(round(o_totalprice * 100) AS BIGINT) AS cost FROM orders WHERE o_orderpriority IS DISTINCT FROM '5-LOW'),
runs AS (SELECT * FROM content UNION ALL SELECT o_orderkey, 'data', o_orderstatus, o_orderdate, NULL FROM orders WHERE o_orderpriority IS DISTINCT FROM '1-URGENT' AND o_orderkey NOT IN (SELECT run_id FROM content))"""


def _runs(spark, sf_dir):
    return R.merged_history(_content(spark, sf_dir), _data(spark, sf_dir), "run_id")


def unified_runs(spark, sf_dir):
    return _runs(spark, sf_dir).withColumn("cost", F.coalesce("cost", F.lit(-1)))


UNIFIED_SQL = f"WITH {RUNS_SQL} SELECT run_id, kind, status, requested_at, coalesce(cost, -1) AS cost FROM runs"
TODAY = "2001-07-01"


def operations_summary(spark, sf_dir):
    day = F.to_date("requested_at")
    return _runs(spark, sf_dir).agg(
        F.count("*").alias("total"),
        F.count_if((F.col("status") == "F") & (day == F.lit(TODAY).cast("date"))).alias("completed_today"),
        F.count_if(F.col("status") == "O").alias("active"),
        F.count_if((F.col("status") == "P") & (F.col("kind") == "content")).alias("attention"),
    )


SUMMARY_SQL = f"WITH {RUNS_SQL} SELECT count(*) AS total, count(*) FILTER (status = 'F' AND CAST(requested_at AS DATE) = DATE '{TODAY}') AS completed_today, count(*) FILTER (status = 'O') AS active, count(*) FILTER (status = 'P' AND kind = 'content') AS attention FROM runs"


def daily_trend(spark, sf_dir):
    """Runs per day of the last thirty days; days without a run have no row."""
    day = F.to_date("requested_at")
    today = F.lit(TODAY).cast("date")
    rows = _runs(spark, sf_dir).withColumn("day", day).filter(F.col("day").between(F.date_sub(today, 29), today))
    return rows.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "F").alias("completed"), F.count_if(F.col("status") == "P").alias("failed"))


TREND_SQL = f"WITH {RUNS_SQL} SELECT strftime(requested_at, '%Y-%m-%d') AS day, count(*) AS runs, count(*) FILTER (status = 'F') AS completed, count(*) FILTER (status = 'P') AS failed FROM runs WHERE CAST(requested_at AS DATE) BETWEEN DATE '{TODAY}' - 29 AND DATE '{TODAY}' GROUP BY 1"


def registry_page(spark, sf_dir):
    """The third page of twenty of the costliest content runs; missing costs last, ties by run."""
    rows = _runs(spark, sf_dir).filter("status <> 'O'")
    return R.paged(rows, [F.desc_nulls_last("cost"), F.asc("run_id")], 20, 3).select("run_id", "kind", "status", "position", "total")


PAGE_SQL = f"WITH {RUNS_SQL}, r AS (SELECT * FROM runs WHERE status <> 'O') SELECT run_id, kind, status, CAST(row_number() OVER (ORDER BY cost DESC NULLS LAST, run_id) AS INT) AS position, CAST((SELECT count(*) FROM r) AS INT) AS total FROM r QUALIFY position BETWEEN 41 AND 60"


def _audit(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    event = F.when(F.col("event_type") == "purchase", "APPROVED").when((F.col("event_type") == "error") & (F.col("event_id") % 4 == 0), "REVOKED").when(F.col("event_type") == "click", "PATCHED").when(F.col("event_type") == "view", "CHECKED").otherwise("CREATED")
    return e.select((F.col("event_id") % 400).alias("run_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), event.alias("event"), F.when(F.col("event_type") == "click", F.round(F.col("value") * 100).cast("long")).alias("cost"))


AUDIT_SQL = """audit AS (SELECT event_id % 400 AS run_id, epoch_us(ts) AS at_us, CASE WHEN event_type = 'purchase' THEN 'APPROVED' WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'REVOKED' WHEN event_type = 'click' THEN 'PATCHED' WHEN event_type = 'view' THEN 'CHECKED' ELSE 'CREATED' END AS event,
CASE WHEN event_type = 'click' THEN CAST(round(value * 100) AS BIGINT) END AS cost FROM events)"""
_COUNTS = ", ".join(f"count(*) FILTER (event = '{e}') AS {n}" for e, n in (("APPROVED", "approvals"), ("REVOKED", "revocations"), ("PATCHED", "patches"), ("CHECKED", "checks")))


def review_metrics(spark, sf_dir):
    return R.review_metrics(_audit(spark, sf_dir), "run_id")


REVIEW_SQL = f"WITH {AUDIT_SQL} SELECT run_id, {_COUNTS}, CAST(coalesce(sum(cost), 0) AS BIGINT) AS cost, greatest(0, CAST(floor((min(CASE WHEN event IN ('APPROVED', 'REVOKED') THEN at_us END) - min(at_us)) / 1000000) AS BIGINT)) AS seconds FROM audit GROUP BY 1"


def review_summary(spark, sf_dir):
    """Distinct runs, approvals and their rate within a half-open week."""
    a = _audit(spark, sf_dir).filter("at_us >= 1704067200000000 and at_us < 1704672000000000")
    out = a.agg(F.countDistinct("run_id").alias("runs"), F.count_if(F.col("event") == "APPROVED").alias("approvals"), F.count_if(F.col("event") == "PATCHED").alias("patches"))
    return out.withColumn("rate", F.when(F.col("runs") == 0, 0.0).otherwise(F.col("approvals").cast("double") / F.col("runs").cast("double")))


REVIEW_SUMMARY_SQL = f"WITH {AUDIT_SQL}, a AS (SELECT * FROM audit WHERE at_us >= 1704067200000000 AND at_us < 1704672000000000) SELECT count(DISTINCT run_id) AS runs, count(*) FILTER (event = 'APPROVED') AS approvals, count(*) FILTER (event = 'PATCHED') AS patches, CAST(count(*) FILTER (event = 'APPROVED') AS DOUBLE) / count(DISTINCT run_id) AS rate FROM a"


def _calls(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    state = F.when(F.col("event_id") % 7 == 0, "OPEN").when(F.col("event_id") % 11 == 0, "RELEASED").otherwise("SETTLED")
    kind = F.when(F.col("event_type").isin("click", "view"), "TOOL").otherwise("MODEL")
    return e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("ordinal"), kind.alias("kind"), F.when(k % 3 != 0, k).alias("tokens"), (k + 5).alias("reserved"), F.when(k % 4 != 0, k).alias("actual"), state.alias("state"))


CALLS_SQL = """calls AS (SELECT user_id AS run_id, event_id AS ordinal, CASE WHEN event_type IN ('click', 'view') THEN 'TOOL' ELSE 'MODEL' END AS kind, CASE WHEN k % 3 <> 0 THEN k END AS tokens, k + 5 AS reserved, CASE WHEN k % 4 <> 0 THEN k END AS actual,
CASE WHEN event_id % 7 = 0 THEN 'OPEN' WHEN event_id % 11 = 0 THEN 'RELEASED' ELSE 'SETTLED' END AS state FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def ledger_totals(spark, sf_dir):
    return R.ledger_totals(_calls(spark, sf_dir), "run_id")


LEDGER_SQL = f"WITH {CALLS_SQL} SELECT run_id, count(*) AS calls, count(*) FILTER (kind = 'MODEL') AS model_calls, count(*) FILTER (kind = 'TOOL') AS tool_calls, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, CAST(sum(CASE state WHEN 'SETTLED' THEN coalesce(actual, reserved) WHEN 'OPEN' THEN reserved ELSE 0 END) AS BIGINT) AS charged, bool_or(state = 'SETTLED' AND actual IS NULL) AS has_unknown_cost FROM calls GROUP BY 1"


def budget_admission(spark, sf_dir):
    return R.admitted(_calls(spark, sf_dir).select("run_id", "ordinal", F.col("reserved").alias("amount")), "run_id", 1500)


ADMISSION_SQL = f"""WITH RECURSIVE {CALLS_SQL}, o AS (SELECT run_id, ordinal, reserved AS amount, row_number() OVER (PARTITION BY run_id ORDER BY ordinal) AS i FROM calls),
r(run_id, ordinal, i, admitted, used) AS (SELECT run_id, ordinal, i, amount <= 1500, CASE WHEN amount <= 1500 THEN amount ELSE 0 END FROM o WHERE i = 1
UNION ALL SELECT o.run_id, o.ordinal, o.i, r.used + o.amount <= 1500, CASE WHEN r.used + o.amount <= 1500 THEN r.used + o.amount ELSE r.used END FROM r JOIN o ON o.run_id = r.run_id AND o.i = r.i + 1)
SELECT run_id, ordinal, admitted, used FROM r"""


def usage_merge(spark, sf_dir):
    """One usage row per call; tool rows overwrite model rows, model rows legacy ones."""
    e = read(spark, sf_dir, "events")
    key = F.col("event_id") % 3000
    p = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2).otherwise(1) * 100000 + F.col("event_id")
    return R.prioritised(e.select(key.alias("call_id"), "event_type", "user_id", p.alias("priority")), "call_id", "priority")


USAGE_SQL = "SELECT event_id % 3000 AS call_id, event_type, user_id, CASE WHEN event_type = 'purchase' THEN 3 WHEN event_type = 'click' THEN 2 ELSE 1 END * 100000 + event_id AS priority FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 3000 ORDER BY priority DESC) = 1"


def latest_versions(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("version"), "o_orderstatus", "o_totalprice")
    return R.latest(o, ["o_custkey"], "version")


LATEST_SQL = "SELECT o_custkey, o_orderkey AS version, o_orderstatus, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1"


def version_activation(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "ACTIVE").when(F.col("o_orderstatus") == "P", "READY").otherwise("FAILED")
    return R.activate(o.select("o_custkey", F.col("o_orderkey").alias("version"), status.alias("status")), "o_custkey", "version")


ACTIVATION_SQL = """WITH v AS (SELECT o_custkey, o_orderkey AS version, CASE o_orderstatus WHEN 'F' THEN 'ACTIVE' WHEN 'P' THEN 'READY' ELSE 'FAILED' END AS status FROM orders),
m AS (SELECT *, max(CASE WHEN status <> 'FAILED' THEN version END) OVER (PARTITION BY o_custkey) AS newest FROM v)
SELECT o_custkey, version, CASE WHEN status <> 'FAILED' AND version = newest THEN 'ACTIVE' WHEN status = 'ACTIVE' THEN 'SUPERSEDED' ELSE status END AS status FROM m"""


def reconciliation(spark, sf_dir):
    """Documents that should be indexed (labelled good) against those that are (embedded)."""
    labels = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return R.reconcile(labels, read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


RECONCILE_SQL = """SELECT DISTINCT doc_id, 'MISSING' AS state FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT DISTINCT vec_id, 'UNEXPECTED' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)"""
NOW_US = 1704499200000000


def lease_claim(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    status = F.when(F.col("event_type") == "purchase", "SUCCEEDED").when(F.col("event_type") == "click", "RUNNING").when(F.col("event_type") == "error", "RETRY_WAITING").otherwise("PENDING")
    owner = F.when(F.col("event_type").isin("click", "purchase"), F.concat(F.lit("w"), F.col("user_id") % 3))
    jobs = e.select("event_id", status.alias("status"), owner.alias("lease_owner"), F.when(owner.isNotNull(), us).alias("lease_until_us"))
    out = R.leased(jobs, NOW_US, "w1", 60000000)
    return out.select("event_id", "status", F.coalesce("lease_owner", F.lit("")).alias("lease_owner"), F.coalesce("lease_until_us", F.lit(-1)).alias("lease_until_us"))


LEASE_SQL = f"""WITH j AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'click' THEN 'RUNNING' WHEN 'error' THEN 'RETRY_WAITING' ELSE 'PENDING' END AS status, CASE WHEN event_type IN ('click', 'purchase') THEN 'w' || (user_id % 3) END AS o, CASE WHEN event_type IN ('click', 'purchase') THEN epoch_us(ts) END AS u FROM events),
c AS (SELECT *, coalesce((o IS NULL OR u <= {NOW_US} OR o = 'w1') AND status IN ('PENDING', 'RETRY_WAITING', 'RUNNING'), false) AS claim FROM j)
SELECT event_id, CASE WHEN status = 'RUNNING' AND coalesce(u <= {NOW_US}, false) THEN 'RETRY_WAITING' ELSE status END AS status, coalesce(CASE WHEN claim THEN 'w1' ELSE o END, '') AS lease_owner, coalesce(CASE WHEN claim THEN {NOW_US + 60000000} ELSE u END, -1) AS lease_until_us FROM c"""


def progress_replay(spark, sf_dir):
    """The last 256 events of each user up to the first purchase worth over 30."""
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", ((F.col("event_type") == "purchase") & (F.col("value") > 30)).alias("terminal"))
    return R.replay_tail(e, "user_id", ["ts", "event_id"], 256, "terminal").select("user_id", "event_id", "terminal", "from_end")


REPLAY_SQL = """WITH e AS (SELECT user_id, ts, event_id, event_type = 'purchase' AND value > 30 AS terminal FROM events),
w AS (SELECT *, coalesce(sum(CASE WHEN terminal THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM e)
SELECT user_id, event_id, terminal, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS from_end FROM w WHERE ended = 0 QUALIFY from_end <= 256"""


def due_schedules(spark, sf_dir):
    """The next weekday occurrence of each event's schedule: its minute of the day from the props, after its time."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    days = F.array(*[F.lit(d) for d in range(5)])
    return e.select("event_id", F.date_format(next_occurrence(F.col("ts").cast("timestamp"), k * 14, days), "yyyy-MM-dd HH:mm:ss").alias("next_at"))


DUE_SQL = """WITH e AS (SELECT event_id, ts, CAST(json_extract_string(props, '$.k') AS INT) * 14 AS m FROM events),
c AS (SELECT event_id, ts, CAST(CAST(ts AS DATE) AS TIMESTAMP) + to_days(d) + to_minutes(m) AS t FROM e, (SELECT CAST(unnest(range(0, 8)) AS INT) AS d))
SELECT event_id, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS next_at FROM c WHERE t > ts AND isodow(t) <= 5 GROUP BY 1"""


def shadow_progress(spark, sf_dir):
    """Distinct days and counts per outcome per priority; complete after the twenty days of the rule."""
    o = read(spark, sf_dir, "orders")
    out = o.groupBy("o_orderpriority").agg(F.countDistinct(F.to_date("o_orderdate")).alias("days"), *[F.count_if(F.col("o_orderstatus") == s).alias(f"status_{s.lower()}") for s in "FOP"])
    return out.withColumns({"remaining": F.greatest(F.lit(0), F.lit(20) - F.col("days")), "complete": F.col("days") >= 20})


SHADOW_SQL = "SELECT o_orderpriority, count(DISTINCT CAST(o_orderdate AS DATE)) AS days, count(*) FILTER (o_orderstatus = 'F') AS status_f, count(*) FILTER (o_orderstatus = 'O') AS status_o, count(*) FILTER (o_orderstatus = 'P') AS status_p, greatest(0, 20 - days) AS remaining, days >= 20 AS complete FROM orders GROUP BY 1"


QUERIES = {
    "runs_comparison": (comparison, COMPARISON_SQL),
    "runs_comparison_counts": (comparison_counts, COMPARISON_COUNTS_SQL),
    "runs_comparison_order": (comparison_order, ORDER_SQL),
    "runs_unified": (unified_runs, UNIFIED_SQL),
    "runs_operations_summary": (operations_summary, SUMMARY_SQL),
    "runs_daily_trend": (daily_trend, TREND_SQL),
    "runs_registry_page": (registry_page, PAGE_SQL),
    "runs_review_metrics": (review_metrics, REVIEW_SQL),
    "runs_review_summary": (review_summary, REVIEW_SUMMARY_SQL),
    "runs_ledger_totals": (ledger_totals, LEDGER_SQL),
    "runs_budget_admission": (budget_admission, ADMISSION_SQL),
    "runs_usage_merge": (usage_merge, USAGE_SQL),
    "store_latest_versions": (latest_versions, LATEST_SQL),
    "store_version_activation": (version_activation, ACTIVATION_SQL),
    "store_reconciliation": (reconciliation, RECONCILE_SQL),
    "state_lease_claim": (lease_claim, LEASE_SQL),
    "state_progress_replay": (progress_replay, REPLAY_SQL),
    "state_due_schedules": (due_schedules, DUE_SQL),
    "state_shadow_progress": (shadow_progress, SHADOW_SQL),
}
