"""MinHash near-duplicates with sequential Bayesian verification, and components of the exact links.

1. One pass over the texts gives per document the set size, a signature and a digest of its word
   sequence. Documents with equal digests are one class and go on as its smallest doc_id.
2. Signatures are cut into bands; documents that agree on a band share a bucket. In each bucket every
   document meets the bucket's smallest: no pairs within a bucket are emitted.
3. Candidate pairs are compared signature batch by signature batch. After each batch a pair is
   dropped when the posterior probability that its similarity reaches the threshold (uniform prior)
   is below `miss`. Survivors are verified on their full shingle sets.
4. Buckets that still hold several components are searched exactly: their documents are dealt into
   blocks, blocks meet pairwise in tasks of bounded size, and pairs of different components
   that pass the same batches and the exact check become links; tasks emit documents and a spanning
   forest of links, not pairs.

With bands of 5 rows and 38 bands a pair at similarity 0.85 escapes all buckets with probability
2e-10, one at 0.8 with 3e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_IDS, materialize, only_ids, text_table
from tidemark.llm.components import Keep, connected_components
from tidemark.llm.textnum import U, mix, word_hashes

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


@dataclass(frozen=True)
class Settings:
    """percent: links need 100 x intersection >= percent x union. width: words of a shingle. miss: posterior below which a pair is dropped. block: documents of a bucket that one task compares with as many others. fan: members that share one copy of their hub's set."""

    percent: int = 80
    width: int = 5
    bands: int = 38
    rows: int = 5
    miss: float = 1e-6
    block: int = 1024
    fan: int = 256
    seed: int = 3

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def shingles(text: str | None, width: int) -> tuple[np.ndarray, bytes]:
    """(sorted distinct 64-bit hashes of the whole text's shingles, digest of its lower-cased word sequence). Fewer words than width: the sequence is one shingle; none: none."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    data = np.frombuffer(raw, np.uint8)
    w = word_hashes(data, _IS_SPACE[data])
    digest = hashlib.md5(b" ".join(raw.split())).digest() if len(w) else b""
    if not len(w):
        return w, digest
    n = max(1, len(w) - width + 1)
    h = np.full(n, min(len(w), width), U)
    for k in range(min(len(w), width)):
        h = mix(h * U(0x9E3779B97F4A7C15) + w[k : k + n])
    return np.unique(h), digest


def _multipliers(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(s.seed)
    return r.integers(1, 2**63, s.hashes, dtype=np.int64).astype(U) * U(2) + U(1), r.integers(0, 2**63, s.hashes, dtype=np.int64).astype(U)


def signature(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set, 32 bits each."""
    out = np.full(len(a), 2**32 - 1, U)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096]
        out = np.minimum(out, ((a[:, None] * part[None, :] + b[:, None]) >> U(32)).min(axis=1))
    return out.astype(np.uint32)


def band_keys(sig: np.ndarray, s: Settings) -> np.ndarray:
    """One 64-bit bucket key a band."""
    rows = sig.reshape(s.bands, s.rows).astype(U)
    h = np.arange(1, s.bands + 1, dtype=U)
    for k in range(s.rows):
        h = mix(h * U(0x9E3779B97F4A7C15) + rows[:, k])
    return h.view(np.int64)


def least_matches(s: Settings) -> list[tuple[int, int]]:
    """(signature values compared, fewest matches to go on) after each batch of `bands` values.

    The posterior of the similarity after m matches in n is Beta(m + 1, n - m + 1); a pair goes on
    while its probability at or above the threshold is at least miss.
    """
    t = s.percent / 100
    x = np.linspace(0, 1, 20001)[1:-1]
    upper = x >= t
    out = []
    for n in range(s.bands, s.hashes + 1, s.bands):
        for m in range(n + 1):
            density = np.exp(m * np.log(x) + (n - m) * np.log1p(-x) + lgamma(n + 2) - lgamma(m + 1) - lgamma(n - m + 1))
            if density[upper].sum() >= s.miss * density.sum():
                out.append((n, m))
                break
    return out


def sketch(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, n_shingles, digest, sig, bands) of every row."""
    a, b = _multipliers(s)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                rows = []
                for i, text in zip(part["doc_id"], part["text"], strict=True):
                    h, digest = shingles(text, s.width)
                    sig = signature(h, a, b) if len(h) else None
                    rows.append((i, len(h), digest, None if sig is None else sig.tobytes(), None if sig is None else band_keys(sig, s)))
                yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "digest", "sig", "bands"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_shingles long, digest binary, sig binary, bands array<long>")


def _survivors(left: np.ndarray, right: np.ndarray, table_: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two signature arrays go on after every batch."""
    alive, matches, done = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for n, least in table_:
        matches = matches + (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
        good = matches >= least
        alive, matches, done = alive[good], matches[good], n
    return alive


def beside_hubs(pairs: DataFrame, load: DataFrame, s: Settings) -> DataFrame:
    """(a, part, own, b, x) of pairs(a, b) and load(doc_id, x): the members b of each hub a in parts of about s.fan, behind a row per part (own, b = a) that carries the hub's own x.

    A hub's x travels once a part, not once a pair, and no part depends on how many members a hub
    has. Parts are sorted inside their partition, so a task reads them as a stream.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / s.fan).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b", F.lit(s.seed)), "parts").cast("int").alias("part"), "b")
    members = dealt.join(load.toDF("b", "x"), "b").select("a", "part", F.lit(False).alias("own"), "b", "x")
    hubs = dealt.select("a", "part").distinct().join(load.toDF("a", "x"), "a").select("a", "part", F.lit(True).alias("own"), F.col("a").alias("b"), "x")
    return members.union(hubs).repartition("a", "part").sortWithinPartitions("a", "part", ~F.col("own"), "b")


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list[int], list[int], list[bytes], list[bytes]]]:
    """(a, b, x of a, x of b) of the pairs that beside_hubs deals, batch by batch; a repeated doc_id has several x, and a pair comes once for each."""
    now, hub = None, []
    for batch in batches:
        left, right, x, y = [], [], [], []
        for a, part, own, b, value in batch.itertuples(index=False, name=None):
            if (a, part) != now:
                now, hub = (a, part), []
            if own:
                hub.append(value)
                continue
            for h in hub:
                left.append(a)
                right.append(b)
                x.append(h)
                y.append(value)
        if left:
            yield left, right, x, y


def bayes_verify(pairs: DataFrame, sketches: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) that survive the sequential comparison of their signatures."""
    steps = least_matches(s)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for a, b, x, y in _met(batches):
            left, right = (np.frombuffer(b"".join(z), np.uint32).reshape(len(a), s.hashes) for z in (x, y))
            yield pd.DataFrame({"a": a, "b": b}).iloc[_survivors(left, right, steps)]

    return beside_hubs(pairs, sketches.select("doc_id", "sig"), s).mapInPandas(run, "a long, b long").distinct()


def _size_fits(a: np.ndarray, b: int, s: Settings) -> np.ndarray:
    """Whether sets of sizes a and b can reach the threshold at all."""
    return (a * 100 >= b * s.percent) & (b * 100 >= a * s.percent)


def _open_pairs(pdf: pd.DataFrame, s: Settings, steps: list[tuple[int, int]]) -> np.ndarray:
    """A mask over (documents of block lo, documents of block hi): pairs of different components that survive the batches and agree on no earlier band (there they have met before)."""
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(len(pdf), s.hashes)
    keys = np.stack([band_keys(x, s) for x in sig])
    hit = keys == pdf["bucket"].to_numpy()[:, None]
    band = int(hit.sum(axis=0).argmax())
    ids, comp, k, n = (pdf[c].to_numpy() for c in ("doc_id", "comp", "k", "n_shingles"))
    lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
    mask = np.zeros((len(pdf), len(pdf)), bool)
    here = hit[:, band]  # another text of a repeated doc_id need not be in this bucket
    rows, columns = np.flatnonzero((k == lo) & here), np.flatnonzero((k == hi) & here)
    for r in rows:
        fit = (comp[columns] != comp[r]) & _size_fits(n[columns], n[r], s)
        if lo == hi:
            fit &= ids[columns] > ids[r]
        others = columns[fit]
        others = others[_survivors(np.broadcast_to(sig[r], (len(others), s.hashes)), sig[others], steps)]
        mask[r, others[~(keys[others, :band] == keys[r, :band]).any(axis=1)]] = True
    return mask


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, over the elements that several of the sets hold, a slice of them at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    again = count[code] > 1
    number = np.cumsum(count > 1) - 1
    owner, code = owner[again], number[code[again]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((len(sets), len(sets)), np.float32)  # counts below 2**24 are exact
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, 1024):
        at, to = np.searchsorted(code, (first, first + 1024))
        part = np.zeros((len(sets), 1024), np.float32)
        part[owner[at:to], code[at:to] - first] = 1
        out += part @ part.T
    return out


def _forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs."""
    up: dict[int, int] = {}

    def root(v: int) -> int:
        while up.get(v, v) != v:
            up[v] = up.get(up[v], up[v])
            v = up[v]
        return v

    out = []
    for a, b in pairs:
        p, q = root(a), root(b)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((a, b))
    return out


def block_links(members: DataFrame, sketches: DataFrame, docs: DataFrame, s: Settings, keep: Keep = materialize) -> DataFrame:
    """Links (a, b) between different components inside buckets: a spanning forest per task of all that there are.

    members(bucket, n, doc_id, comp): a bucket's documents are dealt by hash into n / block blocks,
    every two of which meet in one task. A first pass over signatures finds the documents with a
    surviving partner; a second gets the full shingle sets of only those and checks the survivors.
    What leaves a task is bounded by the documents that enter it, never by their pairs.
    """
    blocks = F.ceil(F.col("n") / s.block).cast("int")
    dealt = members.withColumn("k", F.pmod(F.xxhash64("doc_id", "bucket"), blocks).cast("int"))
    met = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.withColumns({"lo": F.least("k", "j"), "hi": F.greatest("k", "j")}).select("bucket", "lo", "hi", "k", "doc_id", "comp")
    steps = least_matches(s)
    names = ["bucket", "lo", "hi", "k", "doc_id", "comp"]

    def involved(pdf: pd.DataFrame) -> pd.DataFrame:
        mask = _open_pairs(pdf, s, steps)
        return pdf.loc[mask.any(axis=0) | mask.any(axis=1), names]

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        mask = _open_pairs(pdf, s, steps)
        sets = [np.frombuffer(h, U) for h in pdf["h"]]
        size, common, ids = np.array([len(x) for x in sets]), _common(sets), pdf["doc_id"].to_numpy()
        i, j = np.nonzero(mask)
        shared = common[i, j].astype(np.int64)
        good = (shared > 0) & (100 * shared >= s.percent * (size[i] + size[j] - shared))
        i, j = i[good], j[good]
        return pd.DataFrame(_forest([(int(ids[x]), int(ids[y])) for x, y in zip(i, j, strict=True)]), columns=["a", "b"], dtype="int64")

    schema = "bucket long, lo int, hi int, k int, doc_id long, comp long"
    first = met.join(sketches, "doc_id").groupBy("bucket", "lo", "hi").applyInPandas(involved, schema)
    first = keep(first, "mh-involved")
    sets = shingle_sets(first.select("doc_id"), docs, s, "mh-rest", keep)
    second = first.join(sketches, "doc_id").join(sets, "doc_id").groupBy("bucket", "lo", "hi").applyInPandas(linked, "a long, b long")
    return keep(second.distinct(), "mh-rest-links")


def shingle_sets(ids: DataFrame, docs: DataFrame, s: Settings, name: str, keep: Keep = materialize) -> DataFrame:
    """(doc_id, h: the full shingle set as packed 64-bit hashes) of the documents in ids."""
    ids = keep(ids.distinct(), f"{name}-ids")
    n = ids.count()

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                yield pd.DataFrame({"doc_id": part["doc_id"], "h": [shingles(t, s.width)[0].tobytes() for t in part["text"]]})

    return keep(only_ids(docs.select("doc_id", "text"), ids, "doc_id", n).mapInPandas(sets, "doc_id long, h binary"), f"{name}-sets")


def exact_links(pairs: DataFrame, docs: DataFrame, s: Settings, name: str, keep: Keep = materialize) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold. Only documents in a pair are read into sets."""
    got = shingle_sets(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), docs, s, name, keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for a, b, x, y in _met(batches):
            good = [_reach(np.frombuffer(i, U), np.frombuffer(j, U), s) for i, j in zip(x, y, strict=True)]
            yield pd.DataFrame({"a": a, "b": b})[good]

    return keep(beside_hubs(pairs, got, s).mapInPandas(run, "a long, b long").distinct(), f"{name}-links")


def _reach(left: np.ndarray, right: np.ndarray, s: Settings) -> bool:
    """Whether two sorted sets reach the threshold."""
    small, large = sorted((left, right), key=len)
    if not len(small) or 100 * len(small) < s.percent * len(large):
        return False
    common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return common > 0 and 100 * common >= s.percent * (len(left) + len(right) - common)


def near_duplicates(docs: DataFrame, s: Settings = Settings(), keep: Keep = materialize) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs(doc_id, text).

    component_id is the smallest doc_id reachable over links, kept whether it is the row's own. Null,
    empty and wordless texts have no shingles and link with nothing. Rows that share a doc_id share a
    component: a link of any of them counts. Rows with a null doc_id are left alone, with a null
    component and kept. Other columns are ignored, so clashing names do no harm. keep writes the steps;
    the result reads some of them, so a caller deletes them only after use.
    """
    made = keep(sketch(docs, s), "mh-sketch")
    # classes of equal word sequences
    heads = made.filter("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("head"), F.count("*").alias("n"))
    heads = keep(heads.filter("n > 1").select("digest", "head"), "mh-heads")
    copies = made.select("doc_id", "digest").join(heads, "digest").filter("doc_id <> head")
    copies = keep(copies.select("doc_id", "digest", "head").distinct(), "mh-copies")
    gone = F.broadcast(copies) if copies.count() <= BROADCAST_IDS // 4 else copies
    base = made.filter("n_shingles > 0 and doc_id is not null").join(gone.select("doc_id", "digest"), ["doc_id", "digest"], "left_anti")
    # what the buckets of several documents hold; few buckets are, so the steps below read these rows, not all bands
    bands = keep(base.select("doc_id", F.explode("bands").alias("bucket")), "mh-bands")
    hubs = bands.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    shared = keep(bands.join(hubs, "bucket").select("bucket", "hub", "n", "doc_id"), "mh-shared")
    # signatures of documents that meet another; those of no others are compared, so no others travel
    met = keep(shared.select("doc_id").distinct(), "mh-met")
    sketches = made.select("doc_id", "n_shingles", "sig").filter("sig is not null")
    sketches = keep(only_ids(sketches, met, "doc_id", met.count()), "mh-sketches")
    # candidates: every document of a bucket with the bucket's smallest
    stars = keep(shared.filter("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct(), "mh-pairs")
    passed = keep(bayes_verify(stars, sketches, s), "mh-stars")
    links = exact_links(passed, docs, s, "mh-star", keep).union(copies.select(F.col("head").alias("a"), F.col("doc_id").alias("b")))
    found = keep(connected_components(links, keep), "mh-components")
    # the rest of the buckets that still hold several components, without their smallest
    members = shared.filter("n > 2 and doc_id <> hub").join(found.toDF("doc_id", "component"), "doc_id", "left").select("bucket", "n", "doc_id", F.coalesce("component", "doc_id").alias("comp"))
    members = keep(members, "mh-members")
    mixed = keep(members.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("bucket"), "mh-mixed")
    if not mixed.isEmpty():
        extra = block_links(members.join(mixed, "bucket"), sketches, docs, s, keep)
        if not extra.isEmpty():
            found = keep(connected_components(links.union(extra), keep), "mh-components")
    out = made.select("doc_id", "n_shingles").join(found.toDF("doc_id", "component"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(text_table(spark, sf_dir), Settings(percent=85))


def op3_sql() -> str:
    """All links by a join on shingles, components by recursion; for small tables."""
    return r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 OR ws IS NULL THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
u AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(v, t) AS (SELECT a, b FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.t = e.a),
m AS (SELECT v, min(t) AS t FROM r GROUP BY v)
SELECT n.doc_id, n.n AS n_shingles, coalesce(least(m.t, n.doc_id), n.doc_id) AS component_id, coalesce(least(m.t, n.doc_id), n.doc_id) = n.doc_id AS kept FROM n LEFT JOIN m ON m.v = n.doc_id"""
