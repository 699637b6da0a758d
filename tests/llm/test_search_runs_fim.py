"""Nearest neighbours, periodic runs and fill-in-middle on small fixtures, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fim, periodic_runs, registry, rotated_codes

# Nearest neighbours


def brute_nearest(vectors, queries, k):
    out = []
    for query_id, q in queries:
        away = sorted((float(np.sqrt(((np.array(v) - np.array(q)) ** 2).sum())), vec_id) for vec_id, v in vectors if vec_id != query_id and len(v) == len(q))
        out += [(query_id, rank, vec_id, round(d, 9)) for rank, (d, vec_id) in enumerate(away[:k], 1)]
    return sorted(out)


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    heads = rng.standard_normal((12, dim)) * 3
    return [(i, (heads[rng.integers(12)] + rng.standard_normal(dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize(("dim", "seed"), [(16, 1), (40, 2)])
def test_nearest_match_brute_force(spark, dim, seed):
    rows = clustered(1500, dim, seed)
    rows += [(2000 + i, rows[0][1]) for i in range(300)]  # a large group of copies: ties go to smaller ids
    rows += [(3000 + i, (np.random.default_rng(seed).standard_normal(dim)).tolist()) for i in range(40)]
    queries = [r for r in rows if r[0] % 100 == 0]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit("clash")).withColumn("v", F.lit(1))
    s = rotated_codes.Settings(block=256)
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in rotated_codes.search(df, df.filter("vec_id % 100 = 0"), s).collect())
    want = brute_nearest(rows, queries, 10)
    assert len(got) == len(want)
    assert len(set(got) & set(want)) / len(want) >= 0.999


def test_estimates_stay_within_bounds():
    s = rotated_codes.Settings()
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 32))
    turn = rotated_codes.rotation(32, s)
    assert np.allclose(turn @ turn.T, np.eye(32), atol=1e-5)
    codes = rotated_codes.encode(x, turn)
    assert codes.signs.nbytes == 400 * turn.shape[1] // 8
    estimate, off = rotated_codes.bounds(codes, x[:50], turn, s)
    true = ((x[:50, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    assert (np.abs(estimate - true) <= off).mean() >= 0.9999  # the bound holds
    assert np.abs((estimate - true).mean()) < 0.5  # no bias
    assert (np.abs(estimate - true) <= off / 2.5).mean() < 0.99  # and is not idle


def test_nearest_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 1.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.5]), (7, [1.0, 1.0]), (9, []), (10, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in rotated_codes.search(df, df).collect())
    assert [r[:3] for r in got] == [(1, 1, 7), (1, 2, 7), (1, 3, 10), (7, 1, 1), (7, 2, 10), (10, 1, 7), (10, 2, 7), (10, 3, 1)]
    assert rotated_codes.search(df.limit(0), df).count() == 0
    assert rotated_codes.search(df, df.limit(0)).count() == 0


# Periodic runs


def brute_runs(w, times=4, least=6):
    found = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, times * p):
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted([(i, n, p) for (i, n), p in found.items()], key=lambda r: (r[0], r[2]))


def random_words(rng):
    k, words = rng.choice([1, 2, 3, 5]), []
    if rng.random() < 0.4:
        return [str(rng.randint(0, k)) for _ in range(rng.randint(0, 60))]
    while len(words) < rng.randint(0, 150):
        base = [str(rng.randint(0, k)) for _ in range(rng.randint(1, 9))]
        words += [base[t % len(base)] for t in range(rng.randint(1, len(base) * 7))]
    return words


@pytest.mark.parametrize(("times", "least"), [(4, 6), (2, 2), (3, 5)])
def test_runs_match_brute_force(times, least):
    rng = random.Random(times)
    for _ in range(300):
        texts = [" ".join(random_words(rng)).encode() for _ in range(rng.randint(1, 6))]
        words, runs = periodic_runs.batch_runs(texts, periodic_runs.Settings(times, least))
        for w, r in zip(words, runs, strict=True):
            assert r == brute_runs(w, times, least), w


def test_long_common_lengths():
    rng = random.Random(3)
    part = [str(rng.randint(0, 50)) for _ in range(700)]
    w = part + part + ["x"] + part * 5 + ["y"] * 3
    _, runs = periodic_runs.batch_runs([" ".join(w).encode(), b"", " ".join(part * 4).encode()])
    assert runs == [[(1401, 3500, 700)], [], [(0, 2800, 700)]]


def test_runs_of_very_long_texts():
    for text, run in ((b"a " * 60000, (0, 60000, 1)), (b"a b " * 30000, (0, 60000, 2))):
        assert periodic_runs.batch_runs([text])[1] == [[run]]


def test_runs_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a a a a a a"), (4, "a a a a a a"), (None, "x " * 5), (5, "ä b ä b ä b ä b ä b ä b z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash")).withColumn("collapsed", F.lit(0))
    got = sorted(((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.find_runs(df).collect()), key=repr)
    assert got == sorted([(1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 6, 1)], "a"), (4, [(0, 6, 1)], "a"), (0, [], "x x x x x"), (5, [(0, 6, 1)], "ä b z")], key=repr)
    assert periodic_runs.find_runs(df.limit(0)).count() == 0


def test_planted_tails(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 37))) for i in range(200)] + [(300, None), (None, "a b")]
    got = {r.doc_id: r.text for r in periodic_runs.planted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    changed = 0
    for i, text in rows:
        h = zlib.crc32(str(i).encode())
        w = text.split() if text else []
        if i is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(w[k] if k < a else w[a + (k - a) % p] for k in range(n))
            changed += 1
        assert got[i] == text
    assert changed > 10


# Fill in middle


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_fim(doc_id, text):
    units = UNIT.findall(text or "")
    n, digest = len(units), hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text or ""
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle_matches_plain_rule_and_restores(spark):
    rng = random.Random(1)
    alphabet = ["a", "ß", "語", "😀", " ", "\n", "\t", "\x0b", " ", "<", "P", ">", "<S", "M>"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [(500, None), (501, "  \n "), (502, "x <P> y"), (503, "wort " * 100_000), (504, "one"), (504, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("output", F.lit(1))
    made = fim.restore(fim.fill_in_middle(df).withColumn("restored", F.lit(3))).collect()
    assert len(made) == len(rows) and {r.form for r in made} == {"plain", "psm", "spm"}
    texts = dict(rows)
    for r in made:
        text = texts[r.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(r.doc_id, text)
        assert r.restored == (text or "") and r.restored_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
        raw = ((text or "").encode(), fim.SENTINELS)
        assert b"".join(raw[p.buffer][p.start : p.start + p.size] for p in r.pieces).decode() == r.output
    assert fim.fill_in_middle(df.limit(0)).count() == 0
    assert fim.fill_in_middle(df, output=False).filter("output is not null").count() == 0
    assert fim.fill_in_middle(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).count() == 1


def test_piece_tables_cut_anywhere():
    table = fim.PieceTable.of(b"abcdef").cut(2, 4)
    again = table.cut(0, 3, 6)
    assert [bytes(v) for v in table.views()] == [b"ab", b"cd", b"ef"] and again.bytes() == b"abcdef"
    assert [bytes(v) for v in again.views()] == [b"", b"ab", b"c", b"d", b"ef", b""]
    for form in fim.ORDERS:
        arranged = table.arrange(form)
        assert arranged.restore(form).bytes() == b"abcdef" and fim.rebuilt(arranged.bytes(), form).bytes() == b"abcdef"
    with pytest.raises(ValueError, match="substring|subsection|sentinel"):
        fim.parse(b"no sentinel", "psm")


# The registered queries that SQL cannot express, held to their contracts


def documents(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def held(i, parts, rest):
    return zlib.crc32(str(i).encode()) % parts == rest


def test_op1_contract(spark, sf_dir):
    docs, rows = documents(spark, sf_dir), registry.QUERIES["op1_quality"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    right = []
    for r in rows:
        assert r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.held_out and r.doc_id in labels:
            right.append(r.predicted == labels[r.doc_id])
    assert sum(right) >= 0.85 * len(right)


def test_op5_contract(spark, sf_dir):
    docs, rows = documents(spark, sf_dir), registry.QUERIES["op5_ogg"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        raw = (docs[r.doc_id].text or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_bytes > r.payload_bytes and len(r.media_sha256) == 64 and r.feature


def test_op7_contract(spark, sf_dir):
    rows = registry.QUERIES["op7_sentencepiece"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents(spark, sf_dir))


def test_op8_contract(spark, sf_dir):
    docs, rows = documents(spark, sf_dir), registry.QUERIES["op8_mixing"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    size = {i: len((d.text or "").encode().split()) for i, d in docs.items()}
    by = {}
    for r in rows:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"]
        by.setdefault(docs[r.doc_id].source, []).append(r)
    open_, targets = sorted(by, key=lambda s: (s is None, s)), {}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(open_)}
    left = 1.5 * sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sum(r["size"] for r in by[s])]
        if not over:
            targets |= share
            break
        for s in over:
            targets[s] = 2 * sum(r["size"] for r in by[s])
            left -= targets[s]
            open_.remove(s)
        if not open_:
            break
    for s, of in by.items():
        assert all(r.source_size == sum(x["size"] for x in of) for r in of)
        assert all(abs(r.target - targets[s]) < 1e-6 * targets[s] + 1e-6 for r in of)
        assert abs(sum(r.taken for r in of) - targets[s]) <= 2 * max(r["size"] for r in of)
    again = {r.doc_id: r.taken for r in registry.QUERIES["op8_mixing"](spark, sf_dir).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_op9_contract(spark, sf_dir):
    docs, rows = documents(spark, sf_dir), registry.QUERIES["op9_language_id"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    known, right = {d.lang for d in docs.values()}, []
    for r in rows:
        assert r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 and r.lang_pred in known | {"und"}
        if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und":
            right.append(r.lang_pred == docs[r.doc_id].lang)
    assert sum(right) >= 0.9 * len(right)
