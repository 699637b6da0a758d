"""The pipeline's stages on a small table, each against its operator's contract."""

import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_text_operators import brute_near, check_mix
from tidemark.llm import minhash, registry
from tidemark.llm import sentencepiece_codec as sp


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert [name for name, _ in P.STAGES] == ["language_id", "quality", "near_duplicates", "mixing", "sentencepiece"]
    stage = dict(P.STAGES)
    spoken = stage["language_id"](spark, docs, sf_dir)
    assert spoken.columns == P.COLUMNS and spoken.count() >= 0.97 * docs.count()
    good = P.materialize(stage["quality"](spark, spoken, sf_dir), "t-good")
    kept = {r.doc_id for r in good.collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert len([i for i in clean if i in kept]) >= 0.9 * len(clean)
    rows = [tuple(r) for r in good.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    want = {i for i, (_, c) in brute_near(rows, 80).items() if c == i}
    once = P.materialize(stage["near_duplicates"](spark, good, sf_dir), "t-once")
    assert sorted(r.doc_id for r in once.collect()) == sorted(want)
    mixed = P.materialize(stage["mixing"](spark, once, sf_dir), "t-mixed")
    from tidemark.llm import mixing

    plan = mixing.mix(once).collect()
    check_mix([tuple(r) for r in once.select("doc_id", "text", "lang", "source", "n_chars").collect()], plan, None)
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {r.doc_id: r.copies for r in plan if r.copies}
    v = sp.Vocabulary.load()
    texts = {r.doc_id: r.text for r in mixed.collect()}
    out = stage["sentencepiece"](spark, mixed, sf_dir)
    assert out.count() == mixed.count()
    assert all(r.decoded == texts[r.doc_id] for r in sp.decode(out, v).collect())


def test_run_gives_the_last_stage(spark, sf_dir):
    assert P.run(spark, sf_dir).columns == ["doc_id", "lang", "source", "n_pieces", "piece_ids"]


def test_near_duplicate_stage_leaves_other_results_alone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    open_ = minhash.near_duplicates(docs)
    vectors = registry.QUERIES["op4_cover_tree"](spark, sf_dir)
    stage = dict(P.STAGES)["near_duplicates"]
    assert stage(spark, docs, sf_dir).count() == sum(r.kept for r in open_.collect())
    assert vectors.count() > 0


def test_near_duplicate_stage_judges_texts_of_a_repeated_id(spark, sf_dir):
    same = " ".join(f"w{k}" for k in range(40))
    rows = [(3, same, "a"), (5, same + " x", "b"), (5, "a text of its own, like no other one here", "c"), (5, "a text of its own, like no other one here", "d"), (6, None, "e"), (6, "", "f"), (None, same, "g"), (7, "x", "h")]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("component_id", F.lit(1))
    got = sorted((r.doc_id or 0, r.text or "") for r in dict(P.STAGES)["near_duplicates"](spark, docs, sf_dir).collect())
    assert got == sorted([(3, same), (5, rows[2][1]), (6, ""), (0, same), (7, "x")])


def test_stages_on_empty_and_odd_documents(spark, sf_dir):
    odd = [(1, None, None, None, None), (2, "", None, None, 0), (3, "12 !!", "en", "s", 5), (4, "word " * 100000, "en", "s", 500000), (4, "word " * 100000, "en", "s", 500000), (5, "der und die", "de", None, 11)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"score": F.lit(1), "copies": F.lit(1), "piece_ids": F.lit(1)})
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf_dir)
        assert len(out.collect()) >= 0 and "doc_id" in out.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name


def shuffled(spark):
    """Bytes that the session has written to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    each = sc.statusStore().executorList(True)
    return sum(each.apply(k).totalShuffleWrite() for k in range(each.size()))


@contextmanager
def no_small_tables(spark):
    """As with large tables, nothing is broadcast but what a query broadcasts itself."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def unlike(n):
    """n texts unlike each other, and a near copy of every hundredth."""
    rng = random.Random(11)
    rows = [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(60)), "en", f"s{i % 3}", 0) for i in range(n)]
    return rows + [(n + i, rows[i][1] + " x", "en", "s0", 0) for i in range(0, n, 100)]


def test_near_duplicates_shuffle_what_meets_another(spark):
    rows = unlike(2000)
    docs = P.materialize(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "t-unlike")
    with no_small_tables(spark):
        before = shuffled(spark)
        got = minhash.near_duplicates(docs).collect()
        moved = shuffled(spark) - before
    assert {r.doc_id: r.component_id for r in got} == {r[0]: r[0] % 2000 for r in rows}
    assert moved < 2 * 4 * minhash.Settings().hashes * len(rows)  # two signatures a document


@pytest.mark.parametrize("few", [True, False])
def test_mixing_stage_shuffles_texts_only_under_a_large_plan(spark, monkeypatch, few):
    rows = unlike(2000)
    docs = P.materialize(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "t-unlike")
    if not few:
        monkeypatch.setattr(P, "BROADCAST_IDS", 0)
    with no_small_tables(spark):
        before = shuffled(spark)
        got = dict(P.STAGES)["mixing"](spark, docs, "").groupBy("doc_id", "text").count().collect()
        moved = shuffled(spark) - before
    from tidemark.llm import mixing

    text = {r[0]: r[1] for r in rows}
    assert {(r.doc_id, r.text): r["count"] for r in got} == {(r.doc_id, text[r.doc_id]): r.copies for r in mixing.mix(docs).collect() if r.copies}
    # the test's own count by text shuffles the texts once
    assert (moved < 1.5 * sum(map(len, text.values()))) == few
