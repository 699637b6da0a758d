"""Chunks, filters, signals, grounding, streams and workbench rules on small fixtures, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import chunking as C
from tidemark.operators import claims as K
from tidemark.operators import documents as D
from tidemark.operators import news as N
from tidemark.operators import retrieval as R
from tidemark.operators import workbench as W
from tidemark.streaming import events as S


def test_packing_keeps_its_promises():
    rng = random.Random(1)
    for _ in range(600):
        p = C.Policy(least=30, target=40, cap=rng.choice([40, 50, 70]), overlap=rng.choice([0, 7, 20]))
        tokens = [rng.choice([1, 3, 5, 9, 20, 45, 80]) for _ in range(rng.randint(1, 25))]
        lead, overlap = rng.choice([0, 4, 30]), rng.random() < 0.7
        ranges = C.pack(tokens, lead, p, overlap)
        weight = lambda a, b, tokens=tokens, lead=lead: lead + sum(tokens[a:b])
        assert ranges[0][0] == 0 and ranges[-1][1] == len(tokens)
        for a, b in ranges:
            assert a < b and (weight(a, b) <= p.cap or b - a == 1)  # only a lone piece may pass the cap
        for (a, b), (c, d) in zip(ranges, ranges[1:], strict=False):
            assert a <= c <= b < d  # in order, nothing left out, something new in each
            if not overlap:
                assert c == b and weight(a, d if d - b == 1 else b + 1) > p.cap  # closed by the cap alone
                continue
            assert weight(a, b) >= p.target or weight(a, b + 1) > p.cap  # no range closes early
            assert c == b or sum(tokens[c:b]) >= p.overlap or c == a  # what is shared holds the overlap
            assert c == b or sum(tokens[c + 1 : b]) < p.overlap  # and not a piece more
            if c == b and p.overlap and a < b:  # none is shared where it leaves no room
                back = next((x for x in range(b - 1, a - 1, -1) if sum(tokens[x:b]) >= p.overlap), a)
                assert weight(back, b + 1) > p.cap
        if overlap and len(ranges) > 1:
            (a, b), (c, d) = ranges[-2:]
            assert weight(c, d) >= p.least or weight(a, d) > p.cap  # a short rest that fits has been merged


def test_packing_of_worked_cases():
    p = C.Policy(least=30, target=40, cap=70, overlap=7)
    assert C.pack([], 3, p) == [] and C.pack([900], 3, p) == [(0, 1)]
    assert C.pack([20, 20, 20, 20], 0, p) == [(0, 2), (1, 3), (2, 4)]  # 40, then 20 shared and 20 new
    assert C.pack([39, 39], 0, p) == [(0, 1), (1, 2)]  # 78 passes the cap, and a shared 39 leaves no room
    assert C.pack([30, 10, 5], 0, p) == [(0, 3)]  # the rest of 10 + 5 is short and 45 is within the cap
    assert C.pack([30, 40, 5], 0, p) == [(0, 2), (1, 3)]  # 75 would pass the cap, 40 + 5 reaches the target
    assert C.pack([50, 15, 10], 0, p) == [(0, 1), (0, 2), (1, 3)]  # 50 is shared and 65 is within the cap; then 15 is shared
    assert C.pack([30, 30, 30], 10, p, overlap=False) == [(0, 2), (2, 3)]


def test_chunks_of_structured_documents(spark):
    code = "```\nx = 1\n\ny = 2\n```"
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | v{i} |" for i in range(40))
    docs = [
        (1, "# Top\nFirst one; second one\n\n## Sub\n增长。二季度；\n" + code + "\n" + table),
        (2, None),
        (3, "# Only a heading"),
        (4, "word " * 90 + "\n\n" + "\n".join(f"other{n} " * 30 for n in range(20))),
    ]
    p = C.Policy(least=30, target=40, cap=70, overlap=7, parent=150)
    blocks = D.markdown_blocks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id")
    rows = C.chunk(blocks, "doc_id", p).collect()
    texts = {(r.doc_id, r.ordinal): r.text for r in blocks.collect()}
    assert {r.doc_id for r in rows} == {1, 4}
    parents = {r.chunk_id: r for r in rows if r.role == "parent"}
    assert len({r.chunk_id for r in rows}) == len(rows)
    for r in rows:
        assert (r.role == "parent") == (r.child == 0) and (r.parent_id is None) == (r.child == 0)
        if r.parent_id:
            assert parents[r.parent_id].section == r.section
        for s in r.spans:
            part, whole = r.content[s.start : s.end], texts[r.doc_id, s.block]
            assert re.sub(r"\s+", "", part) in re.sub(r"\s+", "", whole) or r.chunk_type == "TABLE"
    mine = [r for r in rows if r.doc_id == 1]
    assert [r.content for r in mine if r.child and r.section == 1] == ["Top\n\nFirst one; second one"]
    prose = next(r for r in mine if "增长" in r.content and r.child)
    assert prose.content == "Top > Sub\n\n增长。二季度；" and prose.chunk_type == "TEXT"
    coded = [r for r in mine if r.chunk_type == "CODE"]
    assert [r.content for r in coded] == ["Top > Sub\n\nx = 1\ny = 2"]
    tables = sorted((r for r in mine if r.chunk_type == "TABLE" and r.child), key=lambda r: r.child)
    assert len(tables) > 1 and all("| a | b |\n|" in r.content and r.content.count("| a | b |") == 1 for r in tables)
    assert sum(len(re.findall(r"\| v\d+ \|", r.content)) for r in tables) == 40
    again = C.chunk(blocks, "doc_id", p).collect()
    assert {r.chunk_id for r in again} == {r.chunk_id for r in rows}
    assert C.chunk(blocks.limit(0), "doc_id", p).count() == 0


def test_paragraph_spans(spark):
    cases = ["a\nb\n\n  c  \n\n\n d\n", "", "\n \n", None, "x", "é\n\t\n ü  y "]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    for r in df.select("t", W.paragraph_spans(F.col("t")).alias("p")).collect():
        want = [m.group(0) for m in re.finditer(r"\S(?:.|\n(?!\s*\n|\s*\Z))*", r.t or "")]
        got = [r.t[x.start : x.end] for x in r.p or []]
        assert got == [w.rstrip() for w in want], r.t


def test_document_filters_before_statistics(spark):
    docs = spark.sql("""SELECT * FROM VALUES (1, 'A', timestamp'2024-01-31 23:59:00', false), (2, 'A', null, false), (3, 'B', timestamp'2024-01-10', null),
    (4, 'A', timestamp'2024-02-01', false), (5, 'A', timestamp'2024-01-01', true) AS t(doc_id, document_type, published_at, requires_verification)""")
    ids = lambda **k: [r.doc_id for r in R.allowed_documents(docs, **k).orderBy("doc_id").collect()]
    assert ids() == [1, 2, 3, 4, 5] and ids(types=["A"]) == [1, 2, 4, 5] and ids(types=[]) == []
    assert ids(since="2024-01-01", until="2024-01-31") == [1, 3, 5] and ids(verified_only=True) == [1, 2, 3, 4]
    assert ids(types=["A"], since="2024-01-01", until="2024-01-31", verified_only=True) == [1]


def test_signals(spark):
    reranked = spark.createDataFrame([(1, i) for i in range(4)] + [(2, 9)], "query_id long, doc_id long")
    returned = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "query_id long, parent_id string")
    got = {r.query_id: (r.duplicate_rate, r.source_diversity) for r in R.retrieval_signals(reranked, returned).collect()}
    assert got == {1: (0.25, 2 / 3), 2: (1.0, 0.0)}


def test_grounded_folds_width_and_case(spark):
    chunks = spark.createDataFrame([(1, "The ＡＢＣ Straße grew 5 ％ here")], "chunk_id long, text string")
    rows = [
        (1, 0, 1, 0, 28, ["abc", "STRASSE", None, " "], 0.9),
        (1, 1, 1, 0, 28, ["abc"], 0.9),
        (2, 0, 1, 0, 28, ["missing"], 0.9),
        (3, 0, 1, 0, 99, ["abc"], 0.9),
        (4, 0, 1, 0, 28, ["abc"], 0.4),
        (5, 0, 7, 0, 28, ["abc"], 0.9),
        (6, 0, 1, 11, 28, ["abc"], 0.9),
        (7, 0, 1, 5, 5, [], 0.9),
    ]
    claims = spark.createDataFrame(rows, "claim_id long, ordinal int, chunk_id long, start int, end int, parts array<string>, confidence double")
    assert [(r.claim_id, r.ordinal) for r in K.grounded(claims, chunks).collect()] == [(1, 0)]


def test_links_inside_words_and_unspaced_text(spark):
    events = spark.createDataFrame([(1, "今日白酒板块上涨"), (2, "Understand"), (3, None), (4, "nothing")], "event_id long, text string")
    rows = [("S", "白酒", 2, 1, "a"), ("T", "ERST", 1, 0, "b"), ("T", "stand", 3, 1, "c"), ("U", "", 3, 0, "d"), ("V", None, 3, 0, "e")]
    ents = spark.createDataFrame(rows, "sector_id string, term string, confidence int, ordinal int, reason string")
    got = sorted((r.event_id, r.sector_id, r.confidence, r.reason) for r in N.sector_links(events, ents).collect())
    assert got == [(1, "S", 2, "a"), (2, "T", 3, "c")]


def test_table_sentences_keep_every_column(spark):
    wide = [str(i) for i in range(1500)]
    df = spark.createDataFrame([(wide, wide), (["h"], ["r"])], "h array<string>, r array<string>")
    long_, short = (r.s for r in df.select(D.table_sentence(F.lit("t"), F.lit("u"), F.col("h"), F.col("r")).alias("s")).collect())
    assert "1499 1499。" in long_ and short.endswith("r：。")


def test_streams_resume_and_upsert(spark, tmp_path):
    src = tmp_path / "in"
    row = lambda i, user, minute: (i, f"2024-01-01 00:{minute:02d}:00", user, "view", 1.0, "{}")
    add = lambda rows: spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(src))
    add([row(1, 7, 0), row(2, 8, 1)])
    run = lambda: S.run_to_end(S.progress_bus(S.event_stream(spark, str(src)), 2), "update", key="user_id", folder=f"file://{tmp_path}/bus")
    assert {r.user_id: (r.kept, r.last_id) for r in run().collect()} == {7: (1, 1), 8: (1, 2)}
    add([row(3, 7, 2), row(4, 7, 3)])
    assert {r.user_id: (r.kept, r.first_id, r.last_id) for r in run().collect()} == {7: (2, 3, 4), 8: (1, 2, 2)}
    assert {r.user_id for r in run().collect()} == {7, 8}


def test_guards_and_counts(spark):
    ctx = "kind string, provider_id string, classification_version string, source_version string, n_fields long"
    base = spark.createDataFrame([("a", "p", "v", "s", 2), ("b", "p", "v", "s", 2), ("c", "", "", "s", 2), ("e", "p", "v", "s", 0)], ctx)
    other = spark.createDataFrame([("a", "p", "v", "s", 2), ("b", "p", "w", "s", 2), ("c", "", "", "s", 2), ("e", "p", "v", "t", 1)], ctx)
    kinds = spark.createDataFrame([(k,) for k in "abcde"], "kind string")
    st = W.kind_status(base, other, kinds)
    got = {r.kind: (r.status, r.warnings) for r in st.collect()}
    assert got == {
        "a": ("COMPARABLE", []),
        "b": ("INCOMPATIBLE", ["CLASSIFICATION_MISMATCH"]),
        "c": ("INCOMPATIBLE", ["CLASSIFICATION_MISMATCH"]),
        "d": ("UNAVAILABLE", ["SNAPSHOT_MISSING"]),
        "e": ("COMPARABLE", ["SOURCE_VERSION_DIFF", "FIELD_SCHEMA_UNKNOWN:BASE"]),
    }
    c = "kind string, sector_id string"
    counts = W.membership_counts(spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "9")], c), spark.createDataFrame([("a", "2"), ("e", "3"), ("d", "9")], c), st).first()
    assert tuple(counts) == (1, 1, 1, 3)
    pairs = spark.createDataFrame(
        [(1, 1, "p", "p", "m", "m", "READY", "READY"), (1, 2, "p", "p", "m", "m", "READY", None), (1, 2, "p", "p", "m", "m", "READY", "RUNNING"), (1, 2, "p", "q", "m", "m", "READY", "FAILED"), (1, 2, None, None, "m", "m", "READY", "FAILED")],
        "base_id int, compare_id int, base_provider string, compare_provider string, base_mode string, compare_mode string, base_status string, compare_status string",
    )
    assert [r.guard for r in W.pair_guard(pairs).collect()] == ["SAME_RUN", "NOT_FOUND", "NOT_FINISHED", "DIFFERENT_SOURCE", "OK"]


@pytest.mark.parametrize("needle,want", [("  ", [1, 2, 3]), ("STEEL", [1]), ("x", [])])
def test_needles(spark, needle, want):
    df = spark.createDataFrame([(1, "Stainless steel", "a"), (2, None, None), (3, "b", "c")], "i int, x string, y string")
    assert [r.i for r in df.filter(W.contains_needle(needle, "x", "y")).orderBy("i").collect()] == want


def test_lifecycle_rules(spark):
    held = spark.createDataFrame([(1, "a"), (2, "b")], "k int, d string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (3, "c")], "k int, d string")
    assert {r.k: r.outcome for r in W.stage_records(held, new, ["k"], "d").collect()} == {1: "UNCHANGED", 2: "CONFLICT", 3: "STAGED"}
    versions = spark.createDataFrame([("a", 1), ("a", 2)], "k string, version long")
    asked = spark.createDataFrame([("a", 1, 2), ("a", 2, 2), ("a", 3, 1), ("b", 4, 0), ("b", 5, None)], "k string, request_id int, expected int")
    got = {r.request_id: (r.outcome, r.version) for r in W.expected_append(versions, asked, "k").collect()}
    assert got == {1: ("APPENDED", 3), 2: ("STALE", None), 3: ("STALE", None), 4: ("APPENDED", 1), 5: ("STALE", None)}
    tasks = spark.createDataFrame([("PENDING", "RUNNING"), ("PENDING", "SUCCEEDED"), ("SUCCEEDED", "RUNNING"), (None, "RUNNING")], "status string, wanted string")
    assert [(r.status, r.allowed) for r in W.transitioned(tasks).collect()] == [("RUNNING", True), ("PENDING", False), ("SUCCEEDED", False), (None, False)]
