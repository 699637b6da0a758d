"""Operators on small cases, against plain Python."""

import random
from datetime import date
from decimal import Decimal
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import time as TM
from tidemark.operators import claims as C
from tidemark.operators import documents as D
from tidemark.operators import market as M
from tidemark.operators import news as N
from tidemark.operators import retrieval as R
from tidemark.operators import runs as U
from tidemark.streaming import events as S


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_breadth(spark):
    df = spark.createDataFrame([(3, 1), (0, 0), (0, 5)], "a int, d int").select(M.breadth_ratio(F.col("a"), F.col("d")).alias("r"))
    assert [r.r for r in df.collect()] == [0.75, 0.5, 0.0]


def test_composite_score_matches_plain(spark):
    rows = [("r", "K", f"s{i}", float(p), None if t is None else float(t), float(b)) for i, (p, t, b) in enumerate([(1, 5, 0.5), (-4, None, 0.9), (0.5, 2, 0.1), (3, 9, 0.5)])]
    u = spark.createDataFrame(rows, "run_id string, kind string, sector_id string, pct_change double, turnover_rate double, breadth_ratio double")
    hot = spark.createDataFrame([("s2",), ("s2",)], "sector_id string")
    got = {r.sector_id: r for r in M.composite_scores(u, hot, ["run_id", "kind"]).collect()}
    dims = [[abs(r[3]) for r in rows], [r[4] or 0 for r in rows], [abs(r[5] - 0.5) for r in rows]]
    for i, r in enumerate(rows):
        want = sum((v[i] - min(v)) / (max(v) - min(v)) * w for v, w in zip(dims, (0.45, 0.25, 0.2), strict=True)) + (0.1 if r[2] == "s2" else 0)
        assert got[r[2]].score == pytest.approx(want)
    assert got["s1"].reasons == ["movement"] and got["s2"].reasons == ["news"] and got["s3"].reasons == ["movement", "turnover"]


def test_composite_score_of_equals_and_missing_dimension(spark):
    u = spark.createDataFrame([("r", "K", "a", 1.0, 1.0, 0.5), ("r", "K", "b", 1.0, 1.0, 0.5)], "run_id string, kind string, sector_id string, pct_change double, turnover_rate double, breadth_ratio double")
    none = spark.createDataFrame([], "sector_id string")
    out = M.composite_scores(u, none, ["run_id", "kind"], ("pct_change",)).collect()
    assert [r.score for r in out] == pytest.approx([0.45, 0.45])


def test_masking_and_fields(spark):
    df = spark.createDataFrame([("u", 1.0, None), ("u", None, None)], "k string, a double, b double")
    assert M.available_fields(df, ["k"], ["a", "b"]).first().available == ["a"]
    shown = df.withColumn("f", F.array(F.lit("a"))).select(M.masked(F.col("a"), "a", F.col("f")).alias("a"), M.masked(F.lit(5), "b", F.col("f")).alias("b")).first()
    assert (shown.a, shown.b) == (1.0, None)


def test_as_of_rule_order(spark):
    df = spark.createDataFrame([(None, 11), (None, 10), (11, 9), (10, 10), (5, None)], "p long, o long")
    got = [r.u for r in df.select(N.use_at(F.col("p"), F.col("o"), F.lit(10)).alias("u")).collect()]
    assert got == ["EXCLUDED", "BACKGROUND", "EXCLUDED", "EVIDENCE", "EVIDENCE"]


def test_urls(spark):
    urls = ["HTTPS://A.Com/X#f", "https://a.com:443/", "https://u@a.com/", "http://a.com/", "javascript:x", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = df.select(N.canonical_url(F.col("u")).alias("c"), N.allowed_url(F.col("u"), ["a.com"]).alias("a"), N.safe_url(F.col("u")).alias("s")).collect()
    assert got[0].c == "https://a.com/X" and [r.a for r in got] == [False, True, False, False, False, False]
    assert [r.s is not None for r in got] == [True, True, True, True, False, False]


def test_similar_titles_follow_arrival_order(spark):
    rng = random.Random(1)
    docs = [(i, f"h{rng.randint(0, 6)}", "".join(rng.choice("ab") for _ in range(rng.randint(3, 9)))) for i in range(60)]
    df = spark.createDataFrame([(1, *d) for d in docs], "b int, doc_id long, content_hash string, title string")
    leaders, want = [], {}
    for i, h, t in docs:
        want[i] = next((j for j, g, s in leaders if g == h or SequenceMatcher(None, t, s).ratio() >= 0.8), i)
        if want[i] == i:
            leaders.append((i, h, t))
    assert {r.doc_id: r.leader for r in N.similar_title_clusters(df, ["b"]).collect()} == want


def test_similar_titles_over_the_whole_table(spark, sf_dir, monkeypatch):
    from tidemark.operators import titles
    from tidemark.plans.news import similar_titles
    from tidemark.sources.tables import news_documents

    monkeypatch.setattr(titles, "ROUND", 50)
    docs = news_documents(spark, sf_dir).select("doc_id", "content_hash", N.normalized_title(F.col("title")).alias("norm")).orderBy("doc_id").collect()
    leaders, want = [], {}
    for i, h, t in docs:
        want[i] = next((j for j, g, s in leaders if g == h or SequenceMatcher(None, t or "", s).ratio() >= 0.8), i)
        if want[i] == i:
            leaders.append((i, h, t or ""))
    assert {r.doc_id: r.leader for r in similar_titles(spark, sf_dir).collect()} == want
    assert any(i % 97 != j % 97 for i, j in want.items())


def test_title_bounds_lose_no_pair():
    from tidemark.operators.titles import Titles, candidates

    rng = random.Random(2)
    a, b = (["".join(rng.choice("aeno中é") for _ in range(rng.choice([0, 1, 5, 12, 63, 64, 65, 90]))) for _ in range(60)] for _ in range(2))
    b[:20] = [s[:9] + s[10:] for s in a[:20]]
    want = {(i, j) for i, s in enumerate(a) for j, t in enumerate(b) if SequenceMatcher(None, s, t).ratio() >= 0.8}
    assert want and want <= set(zip(*(x.tolist() for x in candidates(Titles(a), Titles(b), 0.8))))


def test_status_fold(spark):
    cases = {(): "UNAVAILABLE", ("FAILED",): "FAILED", ("EMPTY", "SUCCESS"): "SUCCESS", ("FAILED", "SUCCESS"): "PARTIAL"}
    for statuses, want in cases.items():
        arr = F.array(*map(F.lit, statuses)) if statuses else F.array().cast("array<string>")
        assert one(spark, N.folded_status(arr)) == want


def test_sector_links_prefer_confidence(spark):
    events = spark.createDataFrame([(1, "Alpha beta of the X"), (2, "gamma"), (3, None)], "event_id long, text string")
    ents = spark.createDataFrame([("S", "alpha", 1, 2, "term"), ("S", "of the", 3, 0, "code"), ("T", "alph", 2, 1, "name")], "sector_id string, term string, confidence int, ordinal int, reason string")
    assert [(r.event_id, r.sector_id, r.confidence, r.reason) for r in N.sector_links(events, ents).orderBy("sector_id").collect()] == [(1, "S", 3, "code"), (1, "T", 2, "name")]  # inside a longer word, too


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, N.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, N.insert_ignore(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "C")]


def test_text_functions(spark):
    assert one(spark, X.approx_tokens(F.lit("中文 ab cd。x"))) == 4
    assert one(spark, X.bigrams(F.lit("a b ca"))) == ["ab", "bc", "ca"]
    assert one(spark, X.bigrams(F.lit("  "))) == [] and one(spark, X.bigrams(F.lit(" z "))) == ["z"]
    assert one(spark, X.sentences(F.lit("一。 二！x. y\nz;"))) == ["一。", "二！", "x. y", "z;"]
    assert one(spark, X.search_tokens(F.lit("Ab 中国人 c"))) == ["ab", "中国", "国人", "c"]
    assert one(spark, X.numbers(F.lit("a-1.5 +2 3"))) == [Decimal("-1.5"), Decimal(2), Decimal(3)]
    assert one(spark, X.coverage(F.lit("abc"), F.lit("xabc"))) == 1.0
    assert one(spark, X.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(3.0), F.lit(4.0)))) == pytest.approx(1.0)
    assert one(spark, X.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_intervals(spark):
    d = lambda s: F.lit(s).cast("date")
    assert one(spark, TM.overlaps(d("2024-01-01"), d("2024-01-05"), d("2024-01-05"), d("2024-01-09"))) is True
    assert one(spark, TM.overlaps(d(None), d(None), d("2024-01-05"), d("2024-01-09"))) is True
    assert one(spark, TM.disjoint(d(None), d(None), d("2024-01-05"), d("2024-01-09"))) is False
    assert one(spark, TM.matches(d(None), d(None), d("2024-01-05"), d("2024-01-09"))) is False


def test_comparable_groups_match_transitive_overlap(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for bucket in range(12):
        for _ in range(rng.randint(1, 8)):
            start = rng.randint(1, 25)
            known = rng.random() > (0.2 if bucket % 3 == 0 else 0)
            rows.append((n, bucket, date(2024, 1, start) if known else None, date(2024, 1, min(31, start + rng.randint(0, 3))) if known else None))
            n += 1
    df = spark.createDataFrame(rows, "claim_id long, k int, start date, end date")
    got = {r.claim_id: (r.k, r.component) for r in C.comparable_groups(df, ["k"]).collect()}
    for a in rows:
        reach, todo = {a[0]}, [a]
        while todo:
            x = todo.pop()
            for b in rows:
                if b[1] == x[1] and b[0] not in reach and (None in (x[2], b[2]) or (x[2] <= b[3] and b[2] <= x[3])):
                    reach.add(b[0])
                    todo.append(b)
        assert {i for i, g in got.items() if g == got[a[0]]} == reach


def test_diverse_selection_rules(spark):
    rows = [("q", i, "d" if i < 6 else "e", "s", [f"g{i}", f"h{i}"] if i != 7 else ["g6", "h6"], i) for i in range(9)]
    df = spark.createDataFrame(rows, "query_id string, doc_id long, parent_id string, section string, grams array<string>, position int")
    assert [r.doc_id for r in R.diverse(df).orderBy("rank").collect()] == [0, 1, 2, 3, 6, 8]


def test_packing_matches_plain(spark):
    rng = random.Random(5)
    for _ in range(8):
        sents = [" ".join("w" for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 30))]
        df = spark.createDataFrame([(sents,)], "s array<string>")
        got = [(c["first"], c["last"], c["tokens"]) for c in df.select(R.pack_sentences(F.col("s"), 100, 20).alias("c")).first().c]
        want, cur = [], []
        for i, s in enumerate(sents, 1):
            n = len(s.split())
            if cur and sum(x for _, x in cur) + n > 100:
                want.append((cur[0][0], cur[-1][0], sum(x for _, x in cur)))
                tail = []
                for x in reversed(cur):
                    if sum(y for _, y in tail) + x[1] > 20:
                        break
                    tail.insert(0, x)
                cur = tail if sum(x for _, x in tail) + n <= 100 else []
            cur.append((i, n))
        if cur:
            want.append((cur[0][0], cur[-1][0], sum(x for _, x in cur)))
        assert got == want


def test_documents(spark):
    df = spark.createDataFrame([("a.pdf", b"%PDF-1"), ("a.md", b"%PDF-1"), ("a.xyz", b"1"), ("a.txt", b""), ("b.txt", b"hi"), ("c.txt", None)], "n string, c binary")
    assert [r.x for r in df.select(D.sniffed(F.col("n"), F.col("c")).alias("x")).collect()] == ["ok", "MAGIC_MISMATCH", "UNSUPPORTED", "EMPTY", "ok", "EMPTY"]
    files = spark.createDataFrame([("﻿a\r\nb".encode("utf-8"),), ("中文".encode("gb18030"),), (b"\xff\x81\xff",), (None,)], "content binary")
    got = D.decode_ladder(files).collect()
    assert got[0].text == "a\nb" and got[1].text == "中文" and got[3].text == "" and got[2].encoding == "latin-1" and got[2].warning
    md = spark.createDataFrame([(1, "# A\ntext\n\n## B\n- x\n| a | b |\n```\ncode\n```\n> q"), (2, None)], "k int, text string")
    blocks = [(b.kind, b.path, b.text) for b in D.markdown_blocks(md, "k").orderBy("ordinal").collect()]
    assert blocks == [("heading", "A", "A"), ("paragraph", "A", "text"), ("heading", "A > B", "B"), ("list", "A > B", "x"), ("table", "A > B", "| a | b |"), ("code", "A > B", "code"), ("quote", "A > B", "> q")]
    page = spark.createDataFrame([("<p>no</p><article>" + "<p>word</p>" * 30 + "<script>x</script></article>",), ("<article>short</article>",), (None,)], "html string")
    a = D.article_text(page).collect()
    assert a[0].article == "\n".join(["word"] * 30) and not a[1].found and a[2].article is None


def test_entity_fold(spark):
    df = spark.createDataFrame([("Ａ b　C",), (None,)], "t string")
    assert [r.k for r in D.folded_entity(df, "t", "k").collect()] == ["abc", None]


def test_admission_and_lease(spark):
    df = spark.createDataFrame([("r", i, a) for i, a in enumerate([5, 6, 4, 1])], "k string, ordinal long, amount long")
    assert [(r.admitted, r.used) for r in U.admitted(df, "k", 10).orderBy("ordinal").collect()] == [(True, 5), (False, 5), (True, 9), (True, 10)]
    jobs = spark.createDataFrame([("RUNNING", "x", 5), ("RUNNING", "x", 50), ("PENDING", None, None), ("SUCCEEDED", None, None)], "status string, lease_owner string, lease_until_us long")
    assert [tuple(r) for r in U.leased(jobs, 10, "me", 7).collect()] == [("RETRY_WAITING", "me", 17), ("RUNNING", "x", 50), ("PENDING", "me", 17), ("SUCCEEDED", None, None)]


def test_compare_reasons(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, v int")
    other = spark.createDataFrame([("a", 5), ("c", 1), ("d", 9)], "k string, v int")
    got = {r.k: (r.membership, r.delta_v, r.why_v) for r in U.compare(base, other, ["k"], ["v"]).collect()}
    assert got == {"a": ("BOTH", 4, ""), "b": ("ONLY_BASE", None, "SECTOR_MISSING"), "c": ("BOTH", None, "VALUE_MISSING"), "d": ("ONLY_COMPARE", None, "SECTOR_MISSING")}


def test_paging_clamps(spark):
    df = spark.range(45)
    assert [r.id for r in U.paged(df, [F.asc("id")], 20, 9).collect()] == list(range(40, 45))
    assert U.paged(df.limit(0), [F.asc("id")], 20, 3).count() == 0


def test_stream_outbox_is_idempotent(spark, tmp_path):
    batch = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "event_id long, v string")
    for _ in range(2):
        S.outbox_sink(batch, 0, str(tmp_path))
    assert spark.read.parquet(str(tmp_path)).count() == 2
