"""Streaming queries over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.sources.tables import read
from tidemark.streaming import events as S
from tidemark.streaming import keyed as K


def _events(spark, sf_dir):
    return S.event_stream(spark, f"{sf_dir}/events.parquet*")  # a glob, so a file and a folder both do


def tumbling(spark, sf_dir):
    return S.run_to_end(S.window_totals(_events(spark, sf_dir), "1 hour"))


def sliding(spark, sf_dir):
    return S.run_to_end(S.window_totals(_events(spark, sf_dir), "2 hours", "1 hour"))


def session(spark, sf_dir):
    return S.run_to_end(S.sessions(_events(spark, sf_dir), "30 minutes"))


def dedup(spark, sf_dir):
    return S.run_to_end(S.first_sightings(_events(spark, sf_dir), ["user_id", "event_type"]), "append", S.firsts)


def static_join(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return S.segment_totals(S.run_to_end(S.enriched(_events(spark, sf_dir), c, "user_id")))


def cutoff(spark, sf_dir):
    kept = S.within_cutoff(_events(spark, sf_dir), "2024-01-10 00:00:00")
    return S.run_to_end(kept.select("event_id", "user_id"), "append", S.outbox_sink)


def progress(spark, sf_dir):
    return S.run_to_end(S.progress_bus(_events(spark, sf_dir), 256), "update", key="user_id")


def _k():
    return F.get_json_object("props", "$.k").cast("long")


def _commands(events):
    """Events as commands of the user's run: purchases settle a call, errors fail one, others ask for one; its tool, fingerprint and price follow from the number in the props."""
    op = F.when(F.col("event_type") == "purchase", "SETTLE").when(F.col("event_type") == "error", "FAIL").otherwise("ADMIT")
    call, tool = F.concat(F.lit("c"), _k() % 20), F.when(_k() % 3 == 0, "search").otherwise("fetch")
    amount = F.when(op == "ADMIT", (_k() % 40) * 10).otherwise((_k() % 7) * 25)
    return events.select(F.col("user_id").alias("run_id"), "event_id", "ts", op.alias("op"), call.alias("call_id"), tool.alias("tool"), F.concat(F.lit("f"), _k() % 40).alias("fingerprint"), amount.alias("amount"))


LIMITS = {"most_calls": 12, "most_per_tool": 8, "most_money": 2000, "lasts_us": 20 * K.DAY_US}


def ledger(spark, sf_dir):
    """ST8, ST9, V25: admission, replay and settlement of each user's calls, with a deadline after twenty days."""
    return S.run_to_end(K.ledger(_commands(_events(spark, sf_dir)), **LIMITS), "append", conf=K.PROVIDER)


def scheduler(spark, sf_dir):
    """ST4, ST5: a daily run of each user from the first event on, at a minute of their own; purchases end an open run well, errors badly, and six hours without either end its lease."""
    e = _events(spark, sf_dir)
    signal = F.when(F.col("event_type") == "purchase", "DONE").when(F.col("event_type") == "error", "BROKEN")
    return S.run_to_end(K.scheduler(e.select(F.col("user_id").alias("schedule_id"), "event_id", "ts", ((F.col("user_id") * 37) % 1440).alias("minute"), signal.alias("signal")), 6 * 3_600_000_000), "append", conf=K.PROVIDER)


SCHEDULER_SQL = """WITH e AS (SELECT user_id AS s, event_id, event_type, epoch_us(ts) AS us FROM events),
u AS (SELECT s, min(us) AS t0, greatest(max(us), (SELECT (max(us) // 1000) * 1000 - 3600000000 FROM e)) AS h, ((s * 37) % 1440) * CAST(60000000 AS BIGINT) AS m FROM e GROUP BY s),
f AS (SELECT s, t0, h, t0 - t0 % 86400000000 + m + CASE WHEN t0 - t0 % 86400000000 + m <= t0 THEN 86400000000 ELSE 0 END AS first FROM u),
d AS (SELECT s, h, first + unnest(range(0, 1 + (h - first) // 86400000000)) * 86400000000 AS due FROM f WHERE first <= h),
o AS (SELECT d.s, d.due, d.h, min(CASE WHEN event_type IN ('purchase', 'error') THEN {'us': us, 'id': event_id, 'kind': event_type} END) AS x FROM d LEFT JOIN e ON e.s = d.s AND us >= due AND us < due + 21600000000 GROUP BY 1, 2, 3),
r AS (SELECT s, due, 'FIRED' AS event, due AS at_us FROM d UNION ALL SELECT s, due, CASE WHEN x IS NULL THEN 'RETRY_WAITING' WHEN x.kind = 'purchase' THEN 'SUCCEEDED' ELSE 'FAILED' END, coalesce(x.us, due + 21600000000) FROM o WHERE x IS NOT NULL OR due + 21600000000 <= h)
SELECT s AS schedule_id, due AS due_us, event, substr(sha256(s || '|' || due), 1, 32) AS run_key, at_us FROM r"""
_CENTS = "CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents"
TUMBLING_SQL = f"SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start_s, event_type, count(*) AS n, {_CENTS} FROM events GROUP BY 1, 2"
SLIDING_SQL = f"SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) - d * 3600 AS start_s, event_type, count(*) AS n, {_CENTS} FROM events, (SELECT unnest([0, 1]) AS d) GROUP BY 1, 2"
SESSION_SQL = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, i"""
PROGRESS_SQL = """WITH e AS (SELECT user_id, ts, event_id, event_type = 'purchase' AND value > 30 AS terminal FROM events),
w AS (SELECT *, coalesce(sum(CASE WHEN terminal THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM w WHERE ended = 0)
SELECT user_id, bool_or(terminal) AS ended, count(*) AS kept, max(CASE WHEN b = m THEN event_id END) AS first_id, max(CASE WHEN b = 1 THEN event_id END) AS last_id FROM (SELECT *, max(b) OVER (PARTITION BY user_id) AS m FROM k WHERE b <= 256) GROUP BY 1"""

QUERIES = {
    "stream_tumbling": (tumbling, TUMBLING_SQL),
    "stream_sliding": (sliding, SLIDING_SQL),
    "stream_session": (session, SESSION_SQL),
    "stream_dedup": (dedup, "SELECT DISTINCT user_id, event_type FROM events"),
    "stream_static_join": (static_join, "SELECT c_mktsegment AS segment, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events JOIN customer ON user_id = c_custkey GROUP BY 1"),
    "stream_outbox_cutoff": (cutoff, "SELECT event_id, user_id FROM events WHERE ts <= TIMESTAMP '2024-01-10 00:00:00'"),
    "stream_progress_bus": (progress, PROGRESS_SQL),
    "stream_ledger": (ledger, None),
    "stream_scheduler": (scheduler, SCHEDULER_SQL),
}
