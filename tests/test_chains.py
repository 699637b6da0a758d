"""Revision chains, payloads, feeds, claim classes and cache keys on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import claims as C
from tidemark.operators import payloads as P
from tidemark.operators import records as R
from tidemark.operators import revisions as V
from tidemark.operators import workbench as W


def walked(saves):
    """Saves one by one, as a store would take them."""
    at, out = {}, {}
    for key, place, expected in sorted(set(saves), key=lambda s: (s[0], s[1], -1 if s[2] is None else s[2])):
        made = 0 if expected is None else expected + 1
        ok = at.get(key, -1) == made - 1
        if ok:
            at[key] = made
        out[key, place, expected] = made if ok else None
    return out


@pytest.mark.parametrize("width", [1, 7, 65_536])
def test_chains_equal_a_walk(spark, width):
    rng = random.Random(width)
    saves = [(k, n, rng.choice([None] + [max(0, n // 4 - rng.randrange(3))] * 5)) for k in ("a", "b", "hot", "hot2") for n in range(60 if k != "hot" else 400)]
    saves += [("tie", 5, None), ("tie", 5, 0), ("tie", 5, 1), ("tie", 6, 0), ("none", 1, 3), ("a", 0, None)] + saves[:20]
    df = spark.createDataFrame(saves, "k string, n long, expected long").withColumn("revision_note", F.lit("x"))
    got = {(r.k, r.n, r.expected): r.revision for r in V.chained(df, "k", "n", width=width).collect()}
    want = walked(saves)
    assert got == want
    assert max(v for v in want.values() if v is not None) >= 3


def test_chains_of_odd_rows(spark):
    schema = "k string, n long, expected long"
    assert V.chained(spark.createDataFrame([], schema), "k", "n").count() == 0
    out = V.chained(spark.createDataFrame([(None, 1, None), ("a", None, None), ("a", 2, None)], schema), "k", "n").collect()
    assert sorted((r.k or "", r.n or 0, r.accepted) for r in out) == [("", 1, False), ("a", 0, False), ("a", 2, True)]


def test_payloads(spark):
    rows = [(1, "x", 1, '{"b": 1, "a": [1, {"z": 0, "y": null}]}'), (1, "x", 2, '{"b":'), (1, "x", 3, None), (2, "x", 1, '{ "a" : [1,{"y":null,"z":0}], "b":1 }'), (2, "y", 1, "")]
    good, bad = P.split_payloads(spark.createDataFrame(rows, "run int, kind string, saved int, payload string"))
    assert sorted((r.run, r.saved) for r in bad.collect()) == [(1, 2), (2, 1)]
    last = P.newest(good, ["run", "kind"], "saved")
    digests = {r.run: r.d for r in last.select("run", P.canonical_digest("payload").alias("d")).collect()}
    assert digests[1] == digests[2]
    assert [r.run for r in P.listed(last, ["run"], 1).collect()] == [1]
    for limit in (0, -1):
        with pytest.raises(ValueError):
            P.listed(last, ["run"], limit)


FEED = """<?xml version="1.0"?><rss><channel><title>t</title>
<item><guid>g1</guid><title> A &amp; B </title><link>HTTPS://News.Example.com/Path?q=1#top</link><pubDate>Mon, 01 Jan 2024 08:00:00 +0800</pubDate></item>
<item><guid>g2</guid><title>broken<link>x</link></item>
<item><title>no zone</title><link>https://e.com/2</link><pubDate>Mon, 01 Jan 2024 08:00:00</pubDate></item>
<item><title>no link</title><link> </link></item>
<item id="5"><title></title><link>https://e.com/5</link></item>
</channel></rss>"""


def test_feed_items_batch_and_stream(spark, tmp_path):
    (tmp_path / "feeds").mkdir()
    (tmp_path / "feeds" / "one.xml").write_text(FEED)
    (tmp_path / "feeds" / "empty.xml").write_text("")
    path = str(tmp_path / "feeds")
    batch = sorted(map(tuple, R.feed_items(R.rss_items(spark, path)).collect()), key=str)
    by_problem = {}
    for item_id, title, link, published, _, problem in batch:
        by_problem.setdefault(problem, []).append((item_id, title, link, published))
    assert sorted(by_problem[None]) == [("g1", "A & B", "https://news.example.com/Path?q=1", 1704067200000000), ("https://e.com/5", "", "https://e.com/5", None)]
    assert {k: len(v) for k, v in by_problem.items() if k} == {"MALFORMED": 1, "BAD_DATE": 1, "NO_LINK": 1}
    stream = R.feed_items(R.rss_items(spark, path, stream=True))
    query = stream.writeStream.format("memory").queryName("feed_test").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("feed_test").collect()), key=str) == batch


def test_classes_stand_for_pairs_of_claims(spark):
    rng = random.Random(5)
    texts = ["the plan was kept", "the plan was not kept", "the plan was kept late", None]
    rows = [(i, rng.randrange(3), rng.choice(texts), rng.choice("AB"), rng.randrange(2), rng.choice([1.0, None])) for i in range(120)]
    claims = spark.createDataFrame(rows, "claim_id long, subject int, text string, stance string, version_id int, relevance double")
    attributes = ["subject", "text", "stance", "version_id", "relevance"]
    classes = C.claim_classes(claims, attributes)
    named = C.class_members(claims, classes, attributes)
    assert named.count() == 120 and {r.class_id for r in named.collect()} == {r.claim_id for r in classes.collect()}
    by_class = {(r.claim_id_l, r.claim_id_r): r.n_l * r.n_r for r in C.claim_pairs(classes, ["subject"]).collect()}
    class_of = {r.claim_id: r.class_id for r in named.collect()}
    counted = {}
    for r in C.claim_pairs(claims, ["subject"]).collect():
        pair = tuple(sorted((class_of[r.claim_id_l], class_of[r.claim_id_r])))
        counted[pair] = counted.get(pair, 0) + 1
    assert by_class == counted
    verdicts = {(r.text_l, r.text_r): r.relation for r in W.text_verdicts(classes, ["subject"]).collect()}
    assert len(verdicts) == 9 and verdicts[texts[0], texts[1]] == verdicts[texts[1], texts[2]] == "CONTRADICTION" and verdicts[texts[0], texts[2]] == "ENTAILMENT"


def test_generation_and_keys(spark):
    entries = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "e string")
    one = lambda df: R.corpus_generation(df, "e").collect()[0][0]
    assert one(entries) == one(entries.orderBy(F.desc("e")).repartition(3)) != one(entries.distinct())
    assert one(entries.limit(0)).startswith("corpus_")
    parts = {p: F.lit("v") for p in R.KEY_PARTS}
    made = lambda **changes: spark.range(1).select(*R.seven_part_key(**{**parts, **changes})).collect()[0]
    base = made()
    assert base[0].startswith("rk_") and base[1] is None
    assert len({made(**{p: F.lit("w")})[0] for p in R.KEY_PARTS} | {base[0]}) == 8
    assert tuple(made(nli_model_version=F.lit(""))) == (None, "nli_model_version")
    assert tuple(made(reranker_model_version=F.lit(None).cast("string"))) == (None, "reranker_model_version")
    with pytest.raises(ValueError):
        R.seven_part_key(query_fingerprint=F.lit("q"))
