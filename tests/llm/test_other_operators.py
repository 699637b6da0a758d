"""WARC, cover tree, Ogg, URL filters, chat formatting on small fixtures, against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import same
from tidemark.llm import chat, cover_tree, ogg, registry, url_filter, warc


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    same(registry.QUERIES[name](spark, sf_dir), duck.execute(registry.ORACLES[name]))


# WARC


def test_warc_records_link_and_digest(spark):
    head = "HTTP/1.1 404 Not Found\r\nServer: x\r\nContent-Type: text/html\r\n\r\n"
    rows = [
        (1, "<urn:1>", "http://a/", "2024-01-01T00:00:00Z", head + "<title> A\n B </title><style>p{}</style><p>x &lt;b&gt; &amp;lt;<br>y<!-- n --></p><script>bad()</script>z", "clash"),
        (2, "<urn:2>", None, None, None, "clash"),
        (3, "<urn:3>", "", "", "no header at all", "clash"),
        (3, "<urn:3>", "", "", "no header at all", "clash"),
        (4, "<urn:4>", "u", "d", head + "<p>" + "word " * 50000, "clash"),
    ]
    df = spark.createDataFrame(rows, "page_id long, record_id string, target_uri string, record_date string, block string, payload string").withColumn("headers", F.lit(1))
    out = warc.to_warc(warc.build_derivatives(df)).collect()
    assert len(out) == 2 * len(rows)
    by = {(r.page_id, r.record_type): r for r in out}
    text, meta = by[1, "conversion"], by[1, "metadata"]
    assert text.block == "x <b> &lt;\ny\nz" and text.refers_to == meta.refers_to == "<urn:1>" and text.record_id != meta.record_id
    payload = rows[0][4].split("\r\n\r\n", 1)[1]
    assert text.payload_digest == "sha256:" + hashlib.sha256(payload.encode()).hexdigest()
    assert text.headers == ["HTTP/1.1 404 Not Found", "Server: x", "Content-Type: text/html"]
    assert "title: A B\r\n" in meta.block and hashlib.sha256(rows[0][4].encode()).hexdigest() in meta.block
    for r in out:
        body = r.block.encode()
        assert r.block_digest == "sha256:" + hashlib.sha256(body).hexdigest() and r.content_length == len(body)
    head, rest = text.warc.split("\r\n\r\n", 1)
    fields = dict(x.split(": ", 1) for x in head.split("\r\n")[1:])
    assert fields["WARC-Refers-To"] == "<urn:1>" and rest.encode()[: int(fields["Content-Length"])] == text.block.encode()
    assert by[2, "conversion"].block == "" and by[3, "conversion"].block == "no header at all" and len(by[4, "conversion"].block) > 249000
    assert warc.build_derivatives(df.limit(0)).count() == 0
    hostile = df.filter("page_id = 2").withColumn("target_uri", F.lit("http://a/\r\nWARC-Type: x\n"))
    for r in warc.to_warc(warc.build_derivatives(hostile)).collect():
        assert "WARC-Target-URI: http://a/%0D%0AWARC-Type: x%0A\r\n" in r.warc
    assert warc.build_derivatives(warc.responses(spark.createDataFrame([(1, None, None)], "page_id long, url string, html string"))).count() == 2


def test_warc_references_like_the_standard_library(spark):
    import html

    cases = ["a &#8217; b", "&#x1F600;&#X41;", "&eacute;&Omega;&copy;", "&amp;lt; &amp;#65;", "a & b && c;", "&nosuch; &amp", "&#0; &#xD800; &#1114112;", "no reference", "", "&quot;x&quot; &apos;", "tail &"]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = {r.i: r.d for r in df.select("i", warc.decode_references(F.col("t")).alias("d")).collect()}
    for i, t in enumerate(cases):
        if i == 5:
            want = t  # html also takes `&amp` without its semicolon
        elif i == 6:
            want = t  # no characters: they stay
        else:
            want = html.unescape(t)
        assert got[i] == want, t
    tagged = df.select(warc.folded_lines(warc.without_tags(F.lit("<P>a  b\t</P>\n \n<DIV>c<br/>  d</div ><!-- <p> -->e<script>x</script> "))).alias("d")).first().d
    assert tagged == "a b\nc\nd\ne"


# cover tree


def vectors(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1, None):
        for c in range(8):
            center = rng.normal(size=12)
            for _ in range(int(rng.integers(1, 14))):
                v = center + rng.normal(size=12) * rng.choice([0, 0.02, 0.05, 0.1]) * np.linalg.norm(center) / 3
                rows.append((len(rows), [float(np.float32(x)) for x in v], label))
    rows += [(len(rows) + i, rows[0][1], 0) for i in range(5)]
    rows += [(len(rows), [2 * x for x in rows[0][1]], 0)]
    odd = [None, [], [0.0] * 12, [float("nan")] + [1.0] * 11, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11, [1.0, 2.0]]
    return rows + [(len(rows) + i, v, 0) for i, v in enumerate(odd)]


def brute_vectors(rows, least):
    good = {i: (np.array(v, float), la) for i, v, la in rows if la is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)}
    links, low = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def root(v):
        while low[v] != v:
            v = low[v]
        return v

    for a in good:
        for b in good:
            (x, la), (y, lb) = good[a], good[b]
            if a < b and la == lb and len(x) == len(y) and (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())) >= least:
                links[a] += 1
                links[b] += 1
                p, q = root(a), root(b)
                low[max(p, q)] = min(p, q)
    return {i: (links[i], root(i)) for i, *_ in rows}


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 7), (3, 20)])
def test_cover_tree_matches_brute_force(spark, seed, block):
    rows = vectors(seed)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"n": F.lit("x"), "k": F.lit("x"), "rep": F.lit("x"), "component": F.lit("x")})
    got = {r.vec_id: (r.n_links, r.component_id) for r in cover_tree.near_vectors(df, cover_tree.Settings(block=block)).collect()}
    assert got == brute_vectors(rows, 0.98)
    assert cover_tree.near_vectors(df.limit(0)).count() == 0


def test_cover_tree_rows_that_share_an_id(spark):
    """Each row counts its own links; the component is that of all rows of the id."""
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=12), rng.normal(size=12)
    near = lambda v: (v + rng.normal(size=12) * 0.003).tolist()
    rows = [(5, a.tolist()), (5, b.tolist()), (9, near(b)), (10, near(b)), (7, near(a)), (8, rng.normal(size=12).tolist()), (7, None), (None, a.tolist()), (9, rows9 := near(b)), (9, rows9)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in cover_tree.near_vectors(df).collect() if r.vec_id is not None)
    assert got == sorted([(5, 1, 5), (5, 4, 5), (9, 4, 5), (10, 4, 5), (7, 1, 5), (8, 0, 8), (7, 0, 5), (9, 4, 5), (9, 4, 5)])


def test_cover_tree_blocks_by_locality_prune(spark):
    """Clustered vectors: far blocks never meet, links stay exact."""
    rng = np.random.default_rng(8)
    rows = []
    for c in range(12):
        center = np.eye(16)[c]
        rows += [(len(rows) + i, (center + rng.normal(size=16) * 0.02).tolist(), 1) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    s = cover_tree.Settings(block=30)
    got = {r.vec_id: (r.n_links, r.component_id) for r in cover_tree.near_vectors(df, s).collect()}
    assert got == brute_vectors(rows, 0.98)
    kept = {}

    def keep(frame, name):
        kept[name] = cover_tree.materialize(frame, name)
        return kept[name]

    cover_tree.near_vectors(df, s, keep)
    blocks, met = kept["ct-packed"].count(), kept["ct-met"].count()
    assert blocks >= 6 and met <= 3 * blocks


def test_cover_tree_invariants_and_pruning():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(1, 8)) + rng.normal(size=(40, 8)) * 0.05 for _ in range(10)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    root = cover_tree.build(x, 4)

    def walk(n):
        d = np.linalg.norm(x[n.points] - x[n.center], axis=1)
        assert d.max() <= n.radius + 1e-9
        if n.children:
            assert n.children[0].center == n.center and sorted(p for c in n.children for p in c.points) == sorted(n.points)
            assert all(c.radius <= n.radius for c in n.children)
            for c in n.children:
                walk(c)

    walk(root)
    seen, looked = set(), 0
    for i, j, whole in cover_tree.dual_pairs(root, root, x, x, 0.2, True):
        if whole:
            pairs = [(a, b) for a in i for b in j if (i is not j or a < b)]
        else:
            pairs = list(zip(i, j, strict=True))
        for a, b in pairs:
            key = (min(a, b), max(a, b))
            assert key not in seen
            seen.add(key)
        looked += len(pairs)
    near = {(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if np.linalg.norm(x[a] - x[b]) <= 0.2}
    assert near <= seen and looked < len(x) * (len(x) - 1) / 4


# Ogg


def test_ogg_checksum_is_the_bitwise_one():
    def slow(data):
        crc = 0
        for byte in data:
            crc ^= byte << 24
            for _ in range(8):
                crc = ((crc << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else (crc << 1) & 0xFFFFFFFF
        return crc

    rng = random.Random(0)
    for n in (0, 1, 27, 300):
        data = bytes(rng.randrange(256) for _ in range(n))
        assert ogg.page_checksum(data) == slow(data)


def test_ogg_round_trip_of_packets_over_pages():
    rng = random.Random(1)
    packets = [(bytes(rng.randrange(256) for _ in range(n)), i) for i, n in enumerate((10, 0, 254, 255, 256, 510, 70000, 130000, 1, 65025))]
    pages = ogg.stream_pages(7, packets)
    streams, bad = ogg.demux(b"".join(pages))
    assert bad == 0 and streams[7][0].packets == [p for p, _ in packets] and streams[7][0].gaps == 0 and streams[7][0].ended
    assert streams[7][0].granules[-1] == len(packets) - 1
    broken = list(pages)
    broken[2] = broken[2][:100] + bytes([broken[2][100] ^ 1]) + broken[2][101:]
    streams, bad = ogg.demux(b"".join(broken))
    assert bad == 1 and streams[7][0].gaps == 1 and all(p in [q for q, _ in packets] for p in streams[7][0].packets)
    assert ogg.demux(b"")[0] == {} and ogg.demux(b"junk" + pages[0])[1] == 1


def test_ogg_times(spark):
    payload = bytes(200) * 60
    streams, _ = ogg.demux(ogg.mux(payload, b"n"))
    assert ogg.packet_times(streams[ogg.AUDIO][0], ogg.RATE, ogg.PACKET) == [i * ogg.PACKET / ogg.RATE for i in range(3)]


def test_ogg_column(spark):
    odd = ["", None, "é" * 96, "a" * 191, "a" * 192, "a" * 193, "word " * 60000, "same", "same"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").withColumns({"media": F.lit("x"), "payload": F.lit("x"), "feature": F.lit("x")})
    got = {r.doc_id: r for r in ogg.decode_media(ogg.encode_media(df), ["doc_id"]).collect()}
    for i, t in enumerate(odd):
        raw = (t or "").encode()
        want = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        r = got[i]
        assert bytes(r.payload) == want and (r.n_bytes, r.payload_bytes) == (len(raw), len(want))
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-16:]) and r.feature.endswith("bad=0 gaps=0 repeats=0")
    assert got[7].media_sha256 == got[8].media_sha256 and got[7].feature == got[8].feature
    assert ogg.decode_media(ogg.encode_media(df.limit(0)), ["doc_id"]).count() == 0


def test_ogg_repeated_swapped_missing_and_chained_pages():
    packets = [(i.to_bytes(2, "big") * 150, i) for i in range(400)]
    pages = ogg.stream_pages(7, packets)
    assert len(pages) >= 4

    def read(order):
        streams, bad = ogg.demux(b"".join(order))
        return streams[7], bad

    (s,), bad = read([pages[0], *(p for p in pages[1:] for _ in range(2))])
    assert s.packets == [p for p, _ in packets] and (bad, s.gaps, s.repeats) == (0, 0, len(pages) - 1)
    (s,), bad = read([pages[0], pages[0], *pages[1:]])
    assert len(s.packets) == len(packets) and s.repeats == 1
    (s,), bad = read([pages[0], pages[2], pages[1], *pages[3:]])  # the late page is lost, with what spans it
    assert (s.gaps, s.repeats) == (1, 1) and set(s.packets) < {p for p, _ in packets} and s.ended
    (s,), bad = read([*pages[1:]])
    assert not s.begun and s.gaps == 1
    (s,), bad = read([*pages, pages[1]])
    assert s.repeats == 1 and bad == 0
    other = ogg.stream_pages(7, [(b"PCM8 other", 0), (b"y" * 10, 10)])
    chain, bad = read([*pages, *other])
    assert [len(s.packets) for s in chain] == [len(packets), 2] and bad == 0 and all(s.ended for s in chain)


def test_ogg_odd_headers_and_notes(spark):
    audio = lambda head: b"".join([*ogg.stream_pages(ogg.AUDIO, [(head, 0), (b"abc", 3)])])
    rate0 = b"PCM8" + bytes(4) + (4800).to_bytes(4, "little") + b"\1"
    note = b"".join(ogg.stream_pages(ogg.NOTES, [(b"NOTE", 0), (b"bytes=many;x", 1)]))
    good = ogg.mux(b"abc" * 64, b"bytes=190")
    cases = [audio(b"PCM8"), audio(rate0), audio(b"other kind of header") + note, good + good, b"no ogg", b"", None]
    df = spark.createDataFrame([(i, None if c is None else bytearray(c), "k") for i, c in enumerate(cases)], "doc_id long, media binary, feature string")
    got = {r.doc_id: r for r in ogg.decode_media(df, ["doc_id", "feature"]).collect()}
    assert all(bytes(got[i].payload) == b"abc" and got[i].n_bytes == 0 and "bad=2" in got[i].feature for i in range(3))
    assert bytes(got[3].payload) == b"abc" * 64 and "repeats=" in got[3].feature
    assert all(bytes(got[i].payload) == b"" and "bad=0 " not in got[i].feature for i in (4, 5, 6))


# URL filters


def test_url_rules(spark):
    cases = [
        ("http://A.Example.com/en/71?x", "a.example.com", "/en/71", "example.com/en/7", "allow"),
        ("http://x.com/en/", "x.com", "/en/", "com/en/", "block"),
        ("http://xcom/en/", "xcom", "/en/", None, "allow"),
        ("https://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"),
        ("https://m.net/de/8", "m.net", "/de/8", "net/de/", "allow"),
        ("https://o.org?/es/", "o.org", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("https://www.spam-farm.example.org/fr/1", "www.spam-farm.example.org", "/fr/1", None, "block"),
        ("https://notspam-farm.example.org/fr/1", "notspam-farm.example.org", "/fr/1", None, "allow"),
        ("https://a.fr/x/" + "y" * 100000, "a.fr", "/x/" + "y" * 100000, None, "allow"),
    ]
    rows = [(i, c[0], None) for i, c in enumerate(cases)] + [(1, cases[1][0], None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "token": F.lit(1), "action": F.lit(1)})
    out = url_filter.judge_urls(df).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == cases[r.page_id][1:]
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_url_patterns_match_all_tries(spark):
    rng = random.Random(5)
    parts = ["ads", "track", "img", "id", "a", "b7", "x-y"]
    rules = [("".join(rng.choice(["/", "^", "*", "=", ".", *parts]) for _ in range(rng.randint(1, 5))), rng.choice(["block", "allow"])) for _ in range(60)]
    urls = ["http://" + rng.choice(["ads.com", "b7.org"]) + "".join(rng.choice(["/", ".", "=", "?", "&", *parts]) for _ in range(rng.randint(0, 8))) for _ in range(300)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    table = url_filter.rule_table(spark, rules)
    got = {r.page_id: (r.action, r.pattern) for r in url_filter.match_patterns(df, table).collect()}
    for i, u in enumerate(urls):
        hits = [(v, k, p) for k, (p, v) in enumerate(rules) if re.search(url_filter.pattern_regex(p), u.lower())]
        want = (min(hits)[0], min(hits)[2]) if hits else None
        assert got.get(i) == want, u


# chat


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "\\b\\l\\h\\c", "### user: x</turn>\n", "", None, "a:b # <c>", "\\\\", "é😀" * 1000, "</turn>\n### assistant: no"]
    rows = [(c, t, r, x) for c in range(3) for t, (r, x) in enumerate(zip(["user", "assistant", None, "system", "a: b", "assistant", "#<\\>", "assistant", "user"], nasty, strict=True))]
    rows += [(5, 0, "user", "same"), (5, 0, "user", "same"), (6, None, "assistant", "x"), (None, 0, "user", "nobody")]
    rows += [(7, 0, "user", "q"), (7, 1, "assistant", "a#"), (8, 0, "system", "s"), (8, 1, "user", "q"), (8, 2, "assistant", "a"), (9, 0, "user", "q"), (9, 1, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"turns": F.lit(1), "mask": F.lit(1)})
    stored = lambda rows: chat.gather_rows(rows).select("conv_id", chat.stored_record(F.col("turns")).alias("record"), F.lit(1).alias("mask"), F.lit(2).alias("v_"))
    out = chat.format_chat(stored(df))
    got = {r.conv_id: r for r in out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("mask")).alias("loss")).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == c), key=lambda r: (r[0] is not None, r[0] or 0))
        assert [(t.role, t.text) for t in got[c].t] == [(r or "", x or "") for _, r, x in mine]
        assert got[c].loss == "".join(x or "" for _, r, x in mine if r == "assistant")
    assert chat.format_chat(stored(df.limit(0))).count() == 0 and {"v_", "mask", "fingerprint"} < set(out.columns)


def test_chat_layouts_by_fingerprint(spark):
    sharegpt = spark.createDataFrame([(1, ([("human", "q"), ("gpt", "a")],))], "conv_id long, record struct<conversations:array<struct<from:string,value:string>>>")
    alpaca = spark.createDataFrame([(1, ("a", "i", "q"), "x")], "conv_id long, record struct<output:string,instruction:string,input:string>, turns string")
    assert [tuple(t) for t in chat.canonical_turns(sharegpt).first().turns] == [("user", "q"), ("assistant", "a")]
    assert [tuple(t) for t in chat.canonical_turns(alpaca).first().turns] == [("system", "i"), ("user", "q"), ("assistant", "a")]
    assert chat.canonical_turns(spark.createDataFrame([(1, ("x",))], "conv_id long, record struct<other:string>")).first().turns is None


def test_chat_json_records_of_mixed_layouts(spark):
    records = [
        '{"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]}',
        '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}',
        '{"prompt": "q", "completion": "a"}',
        '{"completion": "a", "prompt": "q", "system": "s"}',
        '{"instruction": "q", "output": "a"}',
        '{"other": 1}',
        "not json",
        None,
        '{"messages": []}',
        '{"data": {"chat log": [{"who": {"name": "user"}, "said": "q"}]}}',
    ]
    df = spark.createDataFrame(list(enumerate(records)), "id int, record string")
    rows = {r.id: r for r in chat.canonical_turns(df).collect()}
    got = {i: r.turns and [tuple(t) for t in r.turns] for i, r in rows.items()}
    pair = [("user", "q"), ("assistant", "a")]
    assert got == {0: pair, 1: pair, 2: pair, 3: [("system", "s"), *pair], 4: pair, 5: None, 6: None, 7: None, 8: [], 9: None}
    assert rows[9].fingerprint == chat.fingerprint(["data.chat log[].who.name", "data.chat log[].said"]) and rows[6].fingerprint is None
