"""Periodic runs of words, found as maximal pairs in the LCP-interval tree of a document.

A pair of places (i, j) is maximal when the words there agree for l words, and neither the words before
nor those behind agree. With p = j - i and l >= 3p the stretch [i, j + l) is p-periodic over at least
four periods and no neighbour extends it: it is a run as it stands, and every run gives the pair of its
first place and the place a period later. A stretch is also found at multiples of its period; the
smallest one is the run's.

Pairs come from the bottom-up traversal of the LCP-interval tree: an interval of depth l joins the
places of its children, small into large, and two places of different children with different left
words are a maximal pair of length l. Only distances up to l / 3 count. Within such a window the places
of an interval lie a period apart inside one run, so at most its first place has another left word than
the rest. The lists of the left-word classes are therefore kept interleaved by place: the window of a
place meets at most two classes, and one look on either side tells whether any pair is there.

Suffix and LCP arrays are made by numpy for all documents of a batch: prefix doubling over word numbers,
LCPs compared only at irreducible places and carried on from there. Places that cannot have a partner
within the distance bound (by the next place of their five words and their largest LCP) are no leaves.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, text_table


@dataclass(frozen=True)
class Settings:
    """times: least length in periods, at least 2. least: least length in words."""

    times: int = 4
    least: int = 6


class Places:
    """Sorted places of an interval in short blocks."""

    def __init__(self, place: int) -> None:
        self.blocks: list[list[int]] = [[place]]
        self.first = [place]
        self.n = 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, place: int) -> None:
        b = max(0, bisect_right(self.first, place) - 1)
        block = self.blocks[b]
        insort(block, place)
        self.first[b] = block[0]
        self.n += 1
        if len(block) > 1024:
            self.blocks[b : b + 1] = [block[:512], block[512:]]
            self.first[b : b + 1] = [block[0], block[512]]

    def since(self, place: int) -> Iterator[int]:
        """Places from place on, in order."""
        b = max(0, bisect_right(self.first, place) - 1)
        at = bisect_left(self.blocks[b], place)
        while b < len(self.blocks):
            yield from self.blocks[b][at:] if at else self.blocks[b]
            b, at = b + 1, 0


def maximal_pairs(leaves: list[int], lcp: list[int], left: list[int], s: Settings, shortest: int) -> Iterator[tuple[int, int, int]]:
    """(i, distance, length) of the maximal pairs whose distance p satisfies length >= (times - 1) p.

    leaves: places in suffix order; lcp[k]: common length of leaves k - 1 and k; left: the class of the word before each place.
    """
    part = s.times - 1

    def join(a: Places, b: Places, depth: int) -> Places:
        if a.n < b.n:
            a, b = b, a
        reach = depth // part
        for x in b:
            own = left[x]
            for y in a.since(x + 1):  # those to the right share a class: the first look decides
                if y - x > reach or left[y] == own:
                    break
                found.append((x, y - x, depth))
            for y in a.since(x - reach):  # to the left only the run's first place can differ
                if y < x and left[y] != own:
                    found.append((y, x - y, depth))
                break
        for x in b:
            a.add(x)
        return a

    found: list[tuple[int, int, int]] = []
    stack: list[tuple[int, Places]] = []
    for k in range(1, len(leaves) + 1):
        depth = lcp[k] if k < len(leaves) else 0
        places = None
        while stack and stack[-1][0] > depth:
            at, held = stack.pop()
            places = join(held, places if places is not None else Places(leaves[k - 1]), at)
        if depth < shortest:
            stack.clear()
            yield from found
            found.clear()
            continue
        places = places if places is not None else Places(leaves[k - 1])
        if stack and stack[-1][0] == depth:
            stack[-1] = (depth, join(stack[-1][1], places, depth))
        else:
            stack.append((depth, places))
    yield from found


def suffix_order(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The rank of every place's suffix within all of them, documents in order; each document ends in a word of its own."""
    n = len(words)
    key = doc.astype(np.int64) * (int(words.max(initial=0)) + 2) + words + 1
    order = np.argsort(key, kind="stable")
    fresh = np.append(True, key[order[1:]] != key[order[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    open_ = order[~(fresh & np.append(fresh[1:], True))]
    h = 1
    while len(open_):
        key = rank[open_] * (n + 1) + rank[open_ + h] + 1  # an open suffix has not met its end, so open + h is in the document
        by = np.argsort(key, kind="stable")
        a, key = open_[by], key[by]
        old = rank[a]
        at = np.arange(len(a))
        first = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), at, 0))
        fresh = np.append(True, key[1:] != key[:-1])
        rank[a] = old + np.maximum.accumulate(np.where(fresh, at, 0)) - first
        open_ = a[~(fresh & np.append(fresh[1:], True))]
        h *= 2
    return rank


def common_lengths(words: np.ndarray, doc: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """lcp[r]: words that the suffixes of rank r - 1 and r share, 0 over documents.

    A place whose left word equals that of its predecessor in suffix order has one word less in common
    than the place before it; only the others are compared.
    """
    n = len(words)
    place = np.empty(n, np.int64)
    place[rank] = np.arange(n)
    before = np.full(n, -1)
    before[place[1:]] = place[:-1]
    paired = before >= 0
    paired[paired] &= doc[before[paired]] == doc[np.flatnonzero(paired)]
    i = np.flatnonzero(paired)
    j = before[i]
    inner = (i > 0) & (j > 0)
    carried = inner & (words[i - 1] == words[j - 1]) & (doc[i - 1] == doc[i]) & (doc[j - 1] == doc[j])
    length = np.zeros(n, np.int64)
    a, b, step = i[~carried], j[~carried], 0
    while len(a):
        same = words[a + step] == words[b + step]
        length[a[~same]] = step
        a, b, step = a[same], b[same], step + 1
        if step >= 64 and len(a) < 64:
            break
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        at, wide = step, 64
        while True:
            end = min(at + wide, n - max(x, y))
            differ = np.flatnonzero(words[x + at : x + end] != words[y + at : y + end])
            if len(differ):
                length[x] = at + int(differ[0])
                break
            at, wide = end, wide * 2
    start = ~paired
    start[i[~carried]] = True
    origin = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    length[i] = length[origin[i]] - (i - origin[i])
    lcp = np.zeros(n + 1, np.int64)
    lcp[rank[i]] = length[i]
    return lcp


def _repeats(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per place, the distance to the nearest other place of its k words in the document (n where there is none), by 64-bit hash (a collision only keeps a place); and which places have one."""
    n = len(words)
    gap = np.full(n, n, np.int64)
    if n <= k:
        return gap, np.zeros(n, bool)
    w = words.astype(np.uint64)
    m = n - k + 1
    h = doc[:m].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for d in range(k):
        h = (h ^ w[d : m + d]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    a, b = order[:-1][same], order[1:][same]
    gap[a] = b - a
    gap[b] = np.minimum(gap[b], b - a)
    return gap, gap < n


def batch_runs(texts: list[bytes], s: Settings = Settings()) -> tuple[list[list[bytes]], list[list[tuple[int, int, int]]]]:
    """The words of each text, and its runs as (start, length, period) by start, then period."""
    part = s.times - 1
    # a pair of length l and distance p <= l / part makes a run of p + l words
    shortest = next(d for d in count(1) if d // part >= 1 and d + d // part >= s.least)
    number: dict[bytes, int] = defaultdict(count().__next__)
    words = [t.split() for t in texts]  # of bytes: at ASCII white space, as the contracts define words
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    size = np.array([len(w) for w in words], np.int64)
    some = np.flatnonzero(size >= s.least)
    if not len(some):
        return words, out
    # every document ends in a word of its own, numbered behind all others
    flat = np.concatenate([np.append(np.fromiter(map(number.__getitem__, words[d]), np.int64, size[d]), -1 - d) for d in some.tolist()])
    flat = np.where(flat < 0, len(number) - 1 - flat, flat)
    doc = np.repeat(some, size[some] + 1)
    k = min(shortest, 8)
    gap, met = _repeats(flat, doc, k)
    # a run's places have their k words again within a third of a streak of such places
    edge = np.flatnonzero(np.diff(met.astype(np.int8), prepend=0, append=0))
    streak = np.zeros(len(flat), np.int64)
    streak[met] = np.repeat(edge[1::2] - edge[::2], edge[1::2] - edge[::2])
    live = np.unique(doc[met & (gap <= (streak + k - 1) // part)])
    if not len(live):
        return words, out
    inside = np.isin(doc, live)
    flat, doc, gap = flat[inside], doc[inside], gap[inside]
    rank = suffix_order(flat, doc)
    lcp = common_lengths(flat, doc, rank)
    most = np.maximum(lcp[rank], lcp[rank + 1])
    leaf = (most >= shortest) & (gap <= most // part)
    ranks = np.sort(rank[leaf])
    if not len(ranks):
        return words, out
    place = np.empty(len(flat), np.int64)
    place[rank] = np.arange(len(flat))
    between = np.minimum.reduceat(lcp, ranks + 1)[:-1] if len(ranks) > 1 else np.zeros(0, np.int64)
    left = np.append(-1, flat[:-1]).tolist()  # the first place of a document has the end of another before it
    begin = np.searchsorted(doc, np.arange(len(texts)))
    found: dict[tuple[int, int], int] = {}
    for i, p, depth in maximal_pairs(place[ranks].tolist(), [0, *between.tolist()], left, s, shortest):
        if p + depth >= s.least:
            found[i, p + depth] = min(p, found.get((i, p + depth), p))
    for (i, length), p in found.items():
        d = int(doc[i])
        out[d].append((i - int(begin[d]), length, p))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return words, out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains behind its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return b" ".join([words[k] for k in np.flatnonzero(kept).tolist()])


def find_runs(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, runs (array of start, length, period in words, by start, then period) and collapsed text of docs(doc_id, text).

    Null, empty and wordless texts have no runs and collapse to an empty text. Rows are judged one by
    one: repeated ids or rows give repeated results, a null doc_id is kept. A text is one task's work
    at n log n in its words, whole whatever its length. An empty table gives no rows; other columns are ignored.
    """
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text")]
            words, runs = batch_runs(texts, s)
            every = np.array([r for of in runs for r in of], np.int64).reshape(-1, 3)
            struct = pa.StructArray.from_arrays([pa.array(every[:, k]) for k in range(3)], ["start", "length", "period"])
            offsets = pa.array(np.append(0, np.cumsum([len(of) for of in runs])).astype(np.int32))
            left = pa.array([collapsed(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, struct).cast(kinds), left], ["doc_id", "runs", "collapsed"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def planted(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with the contract's tails: in one document of ten by crc32, the words from a on repeat the first p of them. Other texts stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words, g = F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.floor(h / 10)
    marked = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), g.alias("g")).withColumn("n", F.size("w").cast("long"))
    marked = marked.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    marked = marked.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = "transform(sequence(a, n - 1), i -> element_at(w, cast(a + (i - a) % p as int) + 1))"
    text = F.array_join(F.concat(F.expr("slice(w, 1, cast(a as int))"), F.expr(tail)), " ")
    return marked.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = find_runs(planted(text_table(spark, sf_dir)))
    longer = "aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))"
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    best = found.withColumn("best", F.expr(longer))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_sql() -> str:
    """Places that have their five words again at a distance, joined to stretches; crc32 bit by bit. For small tables."""
    return r"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_prepend(CAST(ascii(c) AS BIGINT), list_transform(range(8), lambda z: CAST(-1 AS BIGINT)))))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END), CAST(4294967295 AS BIGINT)) AS h FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
q AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_concat(w[1:a], list_transform(range(a, n), lambda i: w[a + (i - a) % p + 1])) END AS w FROM q),
k AS (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS word FROM d),
f AS (SELECT doc_id, i, word, CASE WHEN lead(word, 4) OVER o IS NOT NULL THEN hash(word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o) END AS five FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS p FROM f x JOIN f y ON x.doc_id = y.doc_id AND x.five = y.five AND x.i < y.i),
s AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM m),
r AS (SELECT doc_id, p AS period, min(i) AS start, count(*) + 4 + p AS length FROM s GROUP BY doc_id, p, island HAVING count(*) + 4 + p >= greatest(6, 4 * p)),
u AS (SELECT doc_id, start, length, min(period) AS period FROM r GROUP BY doc_id, start, length),
e AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
  list(struct_pack(start, length, period) ORDER BY CAST(length AS DOUBLE) / period DESC, start, period)[1] AS best FROM u GROUP BY doc_id),
gone AS (SELECT DISTINCT u.doc_id, unnest(range(u.start + u.period, u.start + u.length)) AS i FROM u),
kept AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.i) AS text FROM k ANTI JOIN gone ON k.doc_id = gone.doc_id AND k.i = gone.i GROUP BY k.doc_id)
SELECT d.doc_id, CAST(coalesce(e.n_runs, 0) AS BIGINT) AS n_runs, CAST(e.best.start AS BIGINT) AS start, CAST(e.best.length AS BIGINT) AS length, CAST(e.best.period AS BIGINT) AS period,
  CAST(e.best.length * 1000 // e.best.period AS BIGINT) AS exponent_milli, sha256(coalesce(e.lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN e ON e.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id"""
