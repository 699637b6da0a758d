"""Limits and row sets of queries against the reference's, computed here from the tables."""

from collections import defaultdict

from pyspark.sql import functions as F


def test_recent_research_keeps_seven_days(spark, sf_dir):
    from tidemark.plans import news as P

    since = P.CUTOFF_US - 7 * 86400 * 1000000
    rows = P._used(spark, sf_dir).filter("use <> 'EXCLUDED'").select("source", "doc_id", "published_us").collect()
    want = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.doc_id):
        if (r.published_us is None or r.published_us >= since) and len(want[r.source]) < 10:
            want[r.source].append(r.doc_id)
    got = defaultdict(list)
    for r in P.recent_research(spark, sf_dir).orderBy("ordinal").collect():
        got[r.source].append(r.doc_id)
    assert got == {k: v for k, v in want.items() if v}


def test_replay_holds_256_events(spark, sf_dir):
    from tidemark.plans import runs, streams

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type", "value")
    live, ended = defaultdict(list), set()
    for r in sorted(events.collect(), key=lambda r: (r.user_id, r.ts, r.event_id)):
        if r.user_id not in ended:
            live[r.user_id].append(r.event_id)
            if r.event_type == "purchase" and r.value > 30:
                ended.add(r.user_id)
    assert any(len(v) > 16 for v in live.values())
    got = runs.progress_replay(spark, sf_dir).groupBy("user_id").agg(F.collect_set("event_id").alias("ids")).collect()
    assert {r.user_id: set(r.ids) for r in got} == {k: set(v[-256:]) for k, v in live.items()}
    assert {r.user_id: r.kept for r in streams.progress(spark, sf_dir).collect()} == {k: len(v[-256:]) for k, v in live.items()}


def test_runs_cover_every_order(spark, sf_dir):
    from tidemark.plans import runs

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    kinds = {r.run_id: r.kind for r in runs.unified_runs(spark, sf_dir).collect()}
    want = {r.o_orderkey: "data" if r.o_orderpriority == "5-LOW" else "content" for r in orders.collect()}
    assert kinds == want and set(kinds.values()) == {"content", "data"}
    assert runs.operations_summary(spark, sf_dir).first().total == len(want)
    assert runs.registry_page(spark, sf_dir).first().total == orders.filter("o_orderstatus <> 'O'").count()
    today = F.lit(runs.TODAY).cast("date")
    days = orders.filter(F.to_date("o_orderdate").between(F.date_sub(today, 29), today)).count()
    assert sum(r.runs for r in runs.daily_trend(spark, sf_dir).collect()) == days
