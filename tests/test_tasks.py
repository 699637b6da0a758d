"""Intake and task rules on small fixtures, against plain Python."""

import hashlib
import random
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import documents as D
from tidemark.operators import intake as I
from tidemark.operators import news as N
from tidemark.operators import records as P
from tidemark.operators import runs as U
from tidemark.operators import tasks as T


def test_delegations_match_the_plain_walk(spark):
    rng = random.Random(2)
    tasks, asked = [], []
    for run in range(40):
        tasks.append((run, -1, None, "A0", "all", "RUNNING"))
        tasks += [(run, 100 + i, -1, rng.choice(["A1", "A2"]), rng.choice("xyz"), rng.choice(["RUNNING", "WAITING", "FAILED", "COMPLETED"])) for i in range(rng.randint(0, 3))]
        asked += [(run, i, rng.choice([-1, -1, -1, -1, 100, -7]), rng.choice([200 + i, 200 + i, 200 + i, 100]), rng.choice(["A2", "A2", "A2", "A3", "A9"]), rng.choice(["x", "y", "z", "w", " "])) for i in range(8)]
    want = {}
    for run in range(40):
        mine = {t[1]: t for t in tasks if t[0] == run}
        ids = set(mine)
        held = [t[4] for t in mine.values() if t[3] == "A2" and t[5] not in T.FINAL]
        for _, no, parent, child, role, scope in (a for a in asked if a[0] == run):
            if role not in T.ROLES:
                out = "BAD_ROLE"
            elif not scope.strip():
                out = "BAD_SCOPE"
            elif parent not in mine:
                out = "NO_PARENT"
            elif mine[parent][2] is not None or mine[parent][3] != "A0":
                out = "NOT_ROOT"
            elif child in ids:
                out = "REPEATED_ID"
            elif role == "A2" and scope in held:
                out = "SCOPE_OWNED"
            elif role == "A2" and len(held) >= 2:
                out = "LIMIT"
            else:
                out = "DELEGATED"
                held += [scope] if role == "A2" else []
            want[run, no] = out
    t = spark.createDataFrame(tasks, "run_id int, task_id int, parent_id int, role string, scope string, status string")
    a = spark.createDataFrame(asked, "run_id int, request_no int, parent_id int, child_id int, role string, scope string")
    got = {(r.run_id, r.request_no): r.outcome for r in T.delegations(t, a).collect()}
    assert got == want and len(set(want.values())) == 8
    assert T.delegations(t.limit(0), a.limit(0)).collect() == []


def test_patches_apply_together_or_not_at_all(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    fields = spark.createDataFrame([(d, p, v) for d in range(5) for p, v in (("introduction", "i"), ("titles/0", "t"))], "draft_id int, path string, value string")
    versions = spark.createDataFrame([(d, 7) for d in range(5)], "draft_id int, version int")
    patches = [(0, 7, 1, "titles/0", sha("t"), "u"), (0, 7, 2, "titles/0", sha("u"), "v"), (1, 6, 1, "titles/0", sha("t"), "u"), (2, 7, 1, "introduction", sha("i"), "j"), (2, 7, 2, "titles/x", sha("t"), "u"), (3, 7, 1, "introduction", sha("i"), "j"), (3, 7, 2, "titles/0", sha("u"), "v")]
    after, outcomes = T.patch_paths(fields, versions, spark.createDataFrame(patches, "draft_id int, base_version int, op_no int, path string, old_hash string, value string"))
    assert {(r.draft_id, r.version, r.outcome) for r in outcomes.collect()} == {(0, 8, "APPLIED"), (1, 7, "STALE_VERSION"), (2, 7, "BAD_PATH"), (3, 7, "STALE_VALUE"), (4, 7, None)}
    assert {(r.draft_id, r.path, r.value) for r in after.collect() if r.value not in "it"} == {(0, "titles/0", "v")}


def test_outbox_events_are_claimed_and_finished_once(spark):
    old, new = 1000, 10**9
    rows = [(1, "PENDING", 5, None, None, 0), (2, "FAILED", 4, None, None, 3), (3, "CLAIMED", 3, "b", old, 1), (4, "CLAIMED", 3, "b", new - 1, 1), (5, "DONE", 1, None, None, 1), (6, "PENDING", new + 1, None, None, 0)]
    box = spark.createDataFrame(rows, "event_id int, status string, available_us long, claimed_by string, claimed_us long, attempts int")
    claimed = T.claim_outbox(box, "a", new, 2)
    assert {r.event_id: r.attempts for r in claimed.filter("claimed_by = 'a'").collect()} == {3: 2, 2: 4}
    results = spark.createDataFrame([(2, "a", None), (3, "a", "late"), (4, "a", None)], "event_id int, worker string, error string")
    done = {r.event_id: (r.status, r.claimed_by, r.outcome) for r in T.finish_outbox(claimed, results, new + 5).collect()}
    assert [done[i] for i in (2, 3, 4, 5)] == [("DONE", None, "APPLIED"), ("FAILED", None, "APPLIED"), ("CLAIMED", "b", "CONFLICT"), ("DONE", None, None)]


def test_scans_end_in_one_of_four_states(spark):
    rows = [("a", False, "EVIDENCE"), ("b", False, "EVIDENCE"), ("b", True, "EVIDENCE"), ("c", True, "EXCLUDED"), ("d", False, "EXCLUDED")]
    got = I.scan_outcomes(spark.createDataFrame(rows, "scan string, failed boolean, use string"), "scan").collect()
    assert {r.scan: (r.documents, r.errors, r.status) for r in got} == {"a": (1, 0, "SUCCESS"), "b": (1, 1, "PARTIAL"), "c": (0, 1, "FAILED"), "d": (0, 0, "EMPTY")}


def test_disclosures_count_local_days(spark):
    docs = spark.createDataFrame([(i, "x", datetime(2024, 1, d, h)) for i, (d, h) in enumerate([(1, 15), (1, 16), (2, 15), (2, 16)])], "id int, code string, at timestamp_ntz")
    codes = spark.createDataFrame([("x",), ("x",), (None,)], "code string")
    assert [r.id for r in I.disclosures(docs, codes, "2024-01-01 23:00:00", "2024-01-02 01:00:00").orderBy("id").collect()] == [1, 2]


def test_claims_meet_under_another_name(spark):
    day = [datetime(2024, 1, d).date() for d in range(1, 9)]
    rows = [(1, "Ａcme Ltd", "Price", day[0], day[2]), (2, "acme", "price", day[1], day[3]), (3, "ACME ltd", "price", day[5], day[6]), (4, "other", "price", day[0], day[1]), (5, None, "price", day[0], day[1])]
    claims = spark.createDataFrame(rows, "claim_id int, subject string, predicate string, start date, end date")
    got = I.alias_groups(claims, spark.createDataFrame([("acme LTD", "Acme")], "alias string, canonical string")).collect()
    assert sorted((r.claim_id, r.subject_key, r["size"], r.first_claim) for r in got) == [(1, "acme", 2, 1), (2, "acme", 2, 1)]


def test_event_ids_are_those_of_the_joined_hashes(spark):
    sizes = [1, 2, 1000, 1001, 1002, 2500]
    got = N.event_ids(spark.createDataFrame([(f"h{n}", n) for n in sizes], "h string, n long"), "h", "n").collect()
    assert {r.n: r.event_id for r in got} == {n: "event-" + hashlib.sha256("|".join([f"h{n}"] * n).encode()).hexdigest()[:24] for n in sizes}


def test_budgets_are_carried_in_order(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abcd"), i, rng.choice([1, 4, 7, 30, None])) for i in range(300)]
    want, used = {}, {}
    for k, i, amount in rows:
        fits = None if amount is None else used.get(k, 0) + amount <= 60
        used[k] = used.get(k, 0) + (amount if fits else 0)
        want[i] = (fits, used[k])
    df = spark.createDataFrame(rows, "k string, ordinal int, amount int").repartition(3, F.rand(1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {r.ordinal: (r.admitted, r.used) for r in U.admitted(df, "k", 60).collect()} == want
        assert U.admitted(df.limit(0), "k", 60).collect() == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_digests_depend_on_rows_and_their_number_only(spark):
    rows = [("a", hashlib.sha256(str(i % 50).encode()).hexdigest()) for i in range(300)]
    digest = lambda r: {x.k: (x.fingerprint, x.n) for x in D.ranged_digest(spark.createDataFrame(r, "k string, h string"), "k", "h").collect()}
    assert digest(rows) == digest(rows[::-1]) and digest(rows)["a"][1] == 300
    assert digest(rows) != digest(rows[1:]) and digest(rows + rows) != digest(rows) and digest(rows)["a"] == digest([("b", h) for _, h in rows])["b"]


def test_plain_text_wins_ties_of_kinds(spark):
    rows = [(1, 1, "table"), (1, 2, "paragraph"), (2, 1, "list"), (2, 2, "table"), (3, 1, "paragraph"), (3, 2, "code"), (3, 3, "code")]
    got = D.dominant_type(spark.createDataFrame(rows, "d int, ordinal int, kind string"), "d").collect()
    assert {r.d: r.kind for r in got} == {1: "paragraph", 2: "list", 3: "code"}


def test_children_are_placed_and_childless_parents_stay(spark):
    parents = spark.createDataFrame([(1,), (2,)], "p int")
    bridge = spark.createDataFrame([(1, 10), (1, 11), (1, 99)], "p int, c int")
    children = spark.createDataFrame([(10, 5), (11, 7)], "c int, score int")
    got = P.ordered_children(parents, bridge, children, "p", "c", [F.desc("score")], ["score"]).collect()
    assert sorted((r.p, r.place, r.c) for r in got) == [(1, 1, 11), (1, 2, 10), (2, 0, None)]


def test_registry_search_returns_the_last_of_over_900_pages(spark, tmp_path):
    import duckdb

    from tests.helpers import same
    from tidemark.plans import tasks

    k = (F.col("id") * 10 + 1).alias("o_orderkey")
    date = F.timestamp_seconds(F.lit(883612800) + F.col("id") % 997 * 3600).cast("timestamp_ntz").alias("o_orderdate")
    spark.range(20011).select(k, F.lit("O").alias("o_orderstatus"), F.lit("3-MEDIUM").alias("o_orderpriority"), date).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    df = tasks.search(spark, str(tmp_path))
    assert df.first().total == 20011 and df.count() == 11
    same(df, con.execute(tasks.SEARCH_SQL))
