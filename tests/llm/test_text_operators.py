"""Language ID, quality, mixing, SentencePiece, MinHash on small fixtures, against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id, minhash, mixing, quality, textnum
from tidemark.llm import sentencepiece_codec as sp
from tidemark.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["score", "predicted", "lang_pred", "component_id", "bands", "size", "target", "piece_ids", "path_score", "copies", "digest", "id_", "own", "part"]


def clash(df):
    """df with columns of names that the operators use themselves."""
    return df.withColumns({c: F.lit("x") for c in CLASHING})


def texts(seed=0, n=120):
    rng = random.Random(seed)
    words = {"en": ["the", "and", "water", "house", "thing", "with"], "de": ["und", "der", "schön", "wasser", "größe", "nicht"]}
    return [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(3, 30))), lang, f"s{i % 4}", 0) for i, lang in ((i, "en" if i % 2 else "de") for i in range(n))]


def odd_docs(spark, base):
    rows = [*base, (1000, None, None, None, None), (1001, "", "en", "s1", 0), (1002, "12 !!", "en", "s1", 0), (1003, "wasser " * 40000, "de", "s1", 0), (1004, "x" * 300000, "en", None, 0), (2, base[2][1], "de", "s2", 0), (2, base[2][1], "de", "s2", 0)]
    return spark.createDataFrame(rows, DOCS)


def test_components_match_union_find(spark):
    rng = random.Random(2)
    for edges in ([(i, i + 1) for i in range(40)], [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)], [(0, i) for i in range(1, 30)], [(None, 1), (3, 3)], []):
        df = spark.createDataFrame(edges, "a long, b long")
        up = {}

        def root(v, up=up):
            while up.get(v, v) != v:
                v = up[v]
            return v

        for a, b in edges:
            if a is not None and b is not None and a != b:
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
                up.setdefault(min(p, q), min(p, q))
        assert {r.id: r.component for r in connected_components(df).collect()} == {v: root(v) for v in up}


def test_language_id_learns_and_defines_edge_cases(spark):
    base = texts()
    docs = clash(odd_docs(spark, base))
    model = language_id.train(docs.filter("doc_id < 90"))
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, *_ in base)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.identify(docs, model).count() == docs.count()


def test_language_id_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None, "s", 3)], DOCS)
    model = language_id.train(docs)
    assert [(r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()] == [("und", 0.0)]
    assert language_id.identify(docs.limit(0), language_id.train(docs.limit(0))).count() == 0


def test_ftrl_is_sparse():
    rng = np.random.default_rng(0)
    s = language_id.Settings(bits=6, l1=1.0, epochs=4)
    rows = []
    for i in range(200):
        x = rng.uniform(0.1, 1, 8)
        idx = np.sort(rng.choice(np.arange(2, 64), 7, replace=False))
        rows.append((np.concatenate(([i % 2], idx)), x, i % 2))
    w, _ = language_id._ftrl(rows, 2, s)
    assert (w == 0).mean() > 0.3 and w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0]


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(4000, 3))
    p = language_id._softmax(z)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert language_id._temperature(z * 5, y) == pytest.approx(5, rel=0.15)
    assert language_id._temperature(z[:0], y[:0]) == 1.0


def test_quality_learns_and_defines_edge_cases(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        good = rng.random() < 0.7
        words = [rng.choice(["plain", "words", "here", "fine"]) + ("" if good else "***") for _ in range(rng.randint(8, 40))]
        rows.append((i, " ".join(words), None, None, int(good)))
    docs = spark.createDataFrame([r[:4] + (0,) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[4], 0) for r in rows] + [(5, None, 0), (None, 1, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(quality.labelled(docs, labels))
    truth = {r[0]: r[4] for r in rows}
    held = quality.score(docs, model).withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).filter("h").collect()
    assert len(held) > 40 and all(r.predicted == truth[r.doc_id] for r in held)
    odd = clash(odd_docs(spark, texts(1, 4)))
    got = quality.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality.score(odd.limit(0), quality.train(quality.labelled(docs.limit(0), labels))).count() == 0


def test_pieces_hold_the_whole_text():
    for text in ("", "a", "ab cd " * 50, "x" * 99, " " * 40, "ab\n" * 33):
        assert "".join(textnum.pieces(text, 20)) == text


def test_features_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(7)
    for sep in (" ", "\n", " \n "):
        text = " " + sep.join(rng.choice(["aa", "bb bb", "word", "été"]) for _ in range(500)) + "\n"
        count = lambda: (np.bincount(np.concatenate(list(quality.feature_rows(text, 12, (3, 4)))), minlength=4096), language_id._gram_counts(text, 12, (1, 2, 3)))  # noqa: E731, B023
        with monkeypatch.context() as m:
            whole = count()
            for size in (64, 9):
                m.setattr(quality, "pieces", lambda t, size=size: textnum.pieces(t, size))
                m.setattr(language_id, "pieces", lambda t, size=size: textnum.pieces(t, size))
                assert all((a == b).all() for a, b in zip(whole, count(), strict=True))
    monkeypatch.setattr(language_id, "pieces", lambda t: textnum.pieces(t, 16))
    assert "".join(language_id.folded("x" * 100)) == " " + "x" * 100 + " "  # a run without white space gets none


def slow_mix(h):
    m = 2**64 - 1
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & m
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & m
    return h ^ (h >> 31)


def slow_quality_rows(text, bits, orders):
    """The rows of feature_rows in plain Python, but for words, which are hashed alone."""
    words, rows = (text or "").split(), []
    code = [int(textnum.word_hashes(np.array([ord(c) for c in w], np.uint32), np.zeros(len(w), bool))[0]) for w in words]
    back = [next((k for k in range(1, 5) if i >= k and words[i] == words[i - k]), 0) for i in range(len(words))]
    for i, w in enumerate(words):
        pattern = back[i] * 25 + (back[i - 1] * 5 if i > 0 else 0) + (back[i - 2] if i > 1 else 0)
        rows += [code[i] >> (64 - bits), slow_mix(2 * back[i]) >> (64 - bits), slow_mix(2 * pattern + 1) >> (64 - bits)]
        for n in orders:
            for at in range(len(w) + 3 - n):
                h = n
                for c in (" " + w + " ")[at : at + n]:
                    h = (h * 0x100000001B3 + ord(c)) & (2**64 - 1)
                rows.append(slow_mix(h) >> (64 - bits))
    return rows


def test_quality_scores_match_brute_force(spark):
    rng = random.Random(3)
    base = [(i, " ".join(rng.choice(["good", "fine", "text"]) for _ in range(rng.randint(1, 20))) if i % 2 else " ".join(["bad"] * rng.randint(2, 9)), i % 2) for i in range(80)]
    s = quality.Settings(bits=10)
    model = quality.train(spark.createDataFrame(base, "doc_id long, text string, label int"), s)
    odd = [(900, None), (901, ""), (902, "  \n"), (903, "x"), (904, "été ÉTÉ  a\tb"), (905, "ab " * 300)]
    docs = clash(spark.createDataFrame([r[:2] for r in base] + odd, "doc_id long, text string"))
    margin = model.embedding @ (model.output[:, 1] - model.output[:, 0])
    for r in quality.score(docs, model, s).collect():
        rows = slow_quality_rows(r.text, s.bits, s.orders)
        want = 1 / (1 + np.exp(-(sum(margin[x] for x in rows) / max(1, len(rows)) + model.bias[1] - model.bias[0])))
        assert r.score == pytest.approx(want) and r.predicted == int(want >= quality.THRESHOLD)


def test_language_scores_match_brute_force(spark):
    s = language_id.Settings(bits=11)
    base = texts(4, 60)
    model = language_id.train(spark.createDataFrame(base, DOCS), s)
    m, frequency, n = 2**64 - 1, defaultdict(int), 0

    def grams(text):
        out, t = defaultdict(int), " " + " ".join(text.lower().split()) + " "
        for at in range(len(t)):
            h = 0
            for k in range(1, 4):
                if at + k <= len(t):
                    h = (h * 0x100000001B3 + ord(t[at + k - 1]) + k) & m
                    out[((h * 0x9E3779B97F4A7C15) & m) >> (64 - s.bits)] += 1
        return out

    for _, t, *_ in base:
        n += 1
        for g in grams(t):
            frequency[g] += 1
    for g in range(1 << s.bits):
        assert model.idf[g] == pytest.approx(np.log((1 + n) / (1 + frequency[g])) + 1)
    docs = spark.createDataFrame([(i, t) for i, t, *_ in base[:20]] + [(900, "der the"), (901, "Ünd  THE\n"), (902, "?! 1"), (903, None)], "doc_id long, text string").withColumn("id", F.lit(3))
    for r in language_id.identify(docs, model, s).collect():
        assert r.id == 3
        if not any(map(str.isalpha, r.text or "")):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        x = {g: (1 + np.log(c)) * model.idf[g] for g, c in grams(r.text).items()}
        norm = np.sqrt(sum(v * v for v in x.values()))
        z = sum(v / norm * model.weights[g] for g, v in x.items()) + model.bias
        p = np.exp(z / model.temperature - (z / model.temperature).max())
        p /= p.sum()
        assert r.lang_pred == model.classes[int(p.argmax())] and r.score == pytest.approx(p.max())


def test_document_frequencies_are_summed_in_two_levels(spark, monkeypatch):
    docs = spark.createDataFrame(texts(5, 90), DOCS).repartition(9)
    s = language_id.Settings(bits=10)
    whole = language_id.document_frequencies(docs, s)
    monkeypatch.setattr(language_id, "MEET", 2)
    split = language_id.document_frequencies(docs, s)
    assert (whole[0] == split[0]).all() and whole[1] == split[1] == 90



def check_mix(docs, out, sources):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in docs}
    of = {i: s for i, _, _, s, _ in docs}
    total = sum(size.values())
    order = sorted((s for s in set(of.values()) if s is not None)) + ([None] if None in of.values() else [])
    have = {s: sum(size[i] for i in of if of[i] == s) for s in order}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, list(order), 1.5 * total
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * unit > 2 * have[s]]
        if not over:
            target |= {s: weight[s] * unit for s in free}
            break
        for s in over:
            target[s] = 2.0 * have[s]
            left -= target[s]
            free.remove(s)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in out:
        assert r.size == size[r.doc_id] and r.source_size == have[of[r.doc_id]]
        assert r.target == pytest.approx(target[of[r.doc_id]]) and r.taken in (0, r.size, 2 * r.size)
        taken[of[r.doc_id]] += r.taken
        largest[of[r.doc_id]] = max(largest[of[r.doc_id]], r.size)
    for s in order:
        assert abs(taken[s] - target[s]) <= largest[s] + 1e-6


def test_mixing_meets_targets(spark):
    docs = [d for d in texts(5, 900)]
    docs = [(i, t, la, ["a", "b", "c", "d", "é", None][min(5, i % 11)], n) for i, t, la, _, n in docs] + [(2000, "", "en", "z", 0), (2001, None, "en", "z", 0)]
    df = clash(spark.createDataFrame(docs, DOCS))
    first = mixing.mix(df).collect()
    check_mix(docs, first, None)
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in first}


def test_mixing_edges(spark):
    df = odd_docs(spark, texts(6, 10))
    out = mixing.mix(df).collect()
    assert len(out) == df.count()
    twice = [r.taken for r in out if r.doc_id == 2]
    assert len(twice) == 3 and len(set(twice)) == 1
    assert mixing.mix(df.limit(0)).count() == 0


def test_pivotal_rounding_is_unbiased(spark):
    units = spark.range(6000).selectExpr("cast(id % 300 as string) as source", "id as key", "id % 17 + 1 as size", "0.3D as p", "20L as n")
    up = mixing.pivotal_round(units, 20, group=4)
    rows = up.join(units, "key").selectExpr("sum(up * size) / sum(size) as share", "count(*) as n").first()
    assert rows.n == 6000 and rows.share == pytest.approx(0.3, abs=0.02)


def test_sentencepiece_equals_library_and_round_trips(spark):
    import sentencepiece

    rng = random.Random(1)
    odd = ["", " ", "   ", "  a  b ", "Hello  world\n\tx", "ﬁ Ａ 日本語 😀", "a" * 5000, "the" * 40, None, "▁x", "\n\n"]
    odd += ["".join(rng.choice("abetnhsi oAZ é日\n\t.,!_-= ") for _ in range(rng.randint(0, 50))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").withColumns({"piece_ids": F.lit("x"), "decoded": F.lit(1)})
    v = sp.Vocabulary.load()
    lib = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    score = [lib.get_score(i) for i in range(lib.get_piece_size())]
    fused = {r.doc_id: r.decoded for r in sp.encode(df, v, decoded="decoded").collect()}
    for r in sp.decode(sp.encode(df, v), v).collect():
        text = r.text or ""
        assert fused[r.doc_id] == r.decoded
        if all(not lib.is_byte(i) for i in r.piece_ids):
            assert r.path_score == sum(score[i] for i in r.piece_ids)
        assert r.piece_ids == lib.encode(text) and r.decoded == text.replace("▁", " ") == lib.decode(r.piece_ids).replace("▁", " ")
    assert sp.encode(df.limit(0), v).count() == 0


def test_unigram_viterbi_matches_brute_force():
    rng = random.Random(4)
    chars = "▁ab"
    pieces = [(p, i, -rng.random() * len(p) * 3) for i, p in enumerate(sorted({"▁", "a", "b"} | {"".join(rng.choice(chars) for _ in range(rng.randint(2, 4))) for _ in range(14)}))]
    v = sp.Vocabulary(pieces, [], 99, "unigram")
    e = sp.Encoder(v)
    words = sorted({"▁" + "".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(40)})

    def best(w):
        if not w:
            return 0.0
        return max((v.scores[w[:n]] + best(w[n:]) for n in range(1, len(w) + 1) if w[:n] in v.scores), default=float("-inf"))

    names = {i: p for p, i, _ in pieces}
    for w in words:
        ids, score = next(e.encode([w]))
        got = [names[i] for i in ids]
        assert "".join(got) == w and sum(v.scores[p] for p in got) == pytest.approx(score) == pytest.approx(best(w))
    alone, e.computed = e.computed, 0
    assert [ids for ids, _ in e.encode(words)] == [next(e.encode([w]))[0] for w in words] and e.computed < 2 * alone
    assert sp.shared_prefixes(["ab", "abc", "b", "ba"]) == [0, 2, 0, 1] and sp.shared_prefixes([]) == []
    e.computed = 0
    list(e.encode(words))
    assert e.computed < sum(map(len, words))  # prefixes were shared


def brute_near(docs, percent):
    sets = {}
    for i, t, *_ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    low = {i: i for i in sets}

    def root(v):
        while low[v] != v:
            v = low[v]
        return v

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            c = len(sets[a] & sets[b])
            if c and 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                p, q = root(a), root(b)
                low[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_docs(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared = [word() for _ in range(60)]
    rows, i = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 7)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = word()
            rows.append((i, " ".join(w).upper() if rng.random() < 0.3 else "  ".join(w), None, None, 0))
            i += 1
    for _ in range(40):  # a passage that many share, without links
        rows.append((i, " ".join([*shared, *(word() for _ in range(rng.randint(10, 90)))]), None, None, 0))
        i += 1
    chain = [word() for _ in range(100)]
    for k in range(25):  # a chain whose ends are no longer alike
        rows.append((i, " ".join(chain[k : k + 70]), None, None, 0))
        i += 1
    return rows + [(i, None, None, None, 0), (i + 1, "", None, None, 0), (i + 2, " \t\n", None, None, 0), (i + 3, "one two", None, None, 0), (i + 4, "ONE  two", None, None, 0), (i + 5, "É x", None, None, 0), (i + 6, "é x", None, None, 0)]


@pytest.mark.parametrize("percent,block", [(85, 256), (80, 4)])
def test_minhash_matches_brute_force(spark, percent, block):
    docs = near_docs(percent)
    df = clash(spark.createDataFrame(docs, DOCS))
    got = {r.doc_id: r for r in minhash.near_duplicates(df, minhash.Settings(percent=percent, block=block, fan=3 if block == 4 else 256)).collect()}
    want = brute_near(docs, percent)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_minhash_rows_that_share_an_id_share_a_component(spark):
    base = [f"w{k}" for k in range(40)]
    other = [f"v{k}" for k in range(40)]
    rows = [(3, " ".join(base)), (5, " ".join(base)), (5, " ".join(other)), (9, " ".join([*other, "x"])), (7, " ".join([*base, "y"])), (8, "none alike")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(df).collect()}
    assert got == {(3, 3), (5, 3), (9, 3), (7, 3), (8, 8)}


def test_minhash_edges(spark):
    df = odd_docs(spark, texts(9, 6)).unionByName(spark.createDataFrame([(None, "a b c", None, None, 0)], DOCS))
    out = minhash.near_duplicates(df).collect()
    assert len(out) == df.count() and all(r.kept for r in out if r.doc_id is None)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_sequential_pruning_keeps_what_it_should():
    s = minhash.Settings(percent=85)
    steps = minhash.least_matches(s)
    assert steps[-1][0] == s.hashes and all(0 < m < n * 0.85 for n, m in steps)
    rng = np.random.default_rng(0)
    left = rng.integers(0, 2**32, (4000, s.hashes), dtype=np.uint32)
    for similarity, least, most in ((0.85, 0.999, 1.0), (0.4, 0.0, 0.01)):
        same = rng.random(left.shape) < similarity
        kept = len(minhash._survivors(left, np.where(same, left, left + 1), steps)) / len(left)
        assert least <= kept <= most
