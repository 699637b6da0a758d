"""Exact threshold pairs of vectors by dual traversal of cover trees.

Unit vectors at cosine c are sqrt(2 - 2c) apart, so a cosine threshold is a distance threshold.
Vectors of a label are dealt by locality: to the nearest of a few pivots, a coarse cover level of a
bounded sample, and by hash into blocks of bounded size where a pivot has many. A block becomes a
cover tree: nested levels whose radii halve, every point within the radius of its node, a node itself
among its children. Two trees (or one with itself) are walked together; a pair of nodes is dropped
when the distance of their points exceeds the threshold plus both covering radii. Leaf pairs are
checked by cosine in double precision. Blocks whose covering balls are apart never meet; where vectors
have no clusters (all about equally far apart), balls overlap and every two blocks of a label meet.

A block pair yields link counts and a spanning forest of its links, not the pairs: rows that leave a
task are bounded by the rows that enter it, also where thousands of vectors are alike.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, table, uniform
from tidemark.llm.components import Keep, connected_components

#: Distances from dot products of unit vectors are this exact.
SLACK = 1e-7


@dataclass(frozen=True)
class Settings:
    """cosine: threshold. block: expected vectors of a block. leaf: points below which a node is not split. pivots: most pivots of all labels together (the sample has four times as many vectors)."""

    cosine: float = 0.98
    block: int = 2048
    leaf: int = 8
    pivots: int = 1024
    seed: int = 4


@dataclass
class Node:
    """center: a point; radius: the largest distance of a point below to it; points: all those below."""

    center: int
    radius: float
    points: np.ndarray
    children: list[Node]


def _away(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def cover(x: np.ndarray, points: np.ndarray, radius: float, step: int = 64) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(center, its points, their distances): each point goes to the first center within radius, and becomes a center if there is none. Candidates are tried step at a time."""
    out = []
    while len(points):
        candidates = points[:step]
        away = _away(x[points], x[candidates])
        close = away <= radius
        close[np.arange(len(candidates)), np.arange(len(candidates))] = True
        chosen, done = [], np.zeros(len(candidates), bool)
        for k in range(len(candidates)):
            if not done[k]:
                chosen.append(k)
                done |= close[: len(candidates), k]
        close, away = close[:, chosen], away[:, chosen]
        met, owner = close.any(axis=1), close.argmax(axis=1)
        order = np.flatnonzero(met)[np.argsort(owner[met], kind="stable")]
        for at in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1):
            k = owner[at[0]]
            out.append((int(candidates[chosen[k]]), points[at], away[at, k]))
        points = points[~met]
    return out


def build(x: np.ndarray, leaf: int = 8) -> Node:
    """The cover tree of unit vectors x; level radii halve from 2."""

    def split(center: int, points: np.ndarray, away: np.ndarray, radius: float) -> Node:
        reach = float(away.max(initial=0.0))
        if len(points) <= leaf or reach <= SLACK:
            return Node(center, reach, points, [])
        while radius / 2 >= reach:
            radius /= 2
        radius /= 2
        near = (away <= radius) | (points == center)  # the node's own point first, then points not yet covered
        groups = [(center, points[near], away[near]), *cover(x, points[~near], radius)]
        return Node(center, reach, points, [split(*g, radius) for g in groups])

    everyone = np.arange(len(x))
    return split(0, everyone, _away(x, x[:1])[:, 0], 2.0)


def dual_pairs(left: Node, right: Node, x: np.ndarray, y: np.ndarray, limit: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(i, j, whole) that cover every pair of points (of x, of y) at distance limit or less, at most once; with same, both are one tree and each unordered pair comes once.

    whole: every point of i is within limit of every point of j (of a node pair whose balls are so
    near that no pair needs a look; for a node with itself i and j are the same points). Otherwise i and j are pairs, still to be checked.
    """
    single_x = x.astype(np.float32)
    single_y = single_x if same else y.astype(np.float32)
    stack, pi, pj = [(left, right, float(_away(x[left.center], y[right.center])))], [], []
    held = 0
    while stack:
        a, b, gap = stack.pop()
        own = same and a is b
        if own and len(a.points) == 1:
            continue
        if gap + a.radius + b.radius <= limit - SLACK:
            yield a.points, b.points, True
            continue
        if not a.children and not b.children:
            if own:
                i, j = np.triu_indices(len(a.points), 1)
                i, j = a.points[i], b.points[j]
            else:
                i, j = np.repeat(a.points, len(b.points)), np.tile(b.points, len(a.points))
            pi.append(i)
            pj.append(j)
            held += len(i)
            if held > 200_000:
                yield np.concatenate(pi), np.concatenate(pj), False
                pi, pj, held = [], [], 0
            continue
        # the larger node is opened, both where they are of a size
        us = a.children if a.children and (own or not b.children or 2 * a.radius >= b.radius) else [a]
        vs = b.children if b.children and (own or us[0] is a or 2 * b.radius >= a.radius) else [b]
        cu, cv = np.array([u.center for u in us]), np.array([v.center for v in vs])
        bound = limit + 2 * SLACK + np.array([u.radius for u in us], np.float32)[:, None] + np.array([v.radius for v in vs], np.float32)[None, :]
        near = single_x[cu] @ single_y[cv].T >= 1.0 - 1e-5 - bound * bound / 2  # single precision, with room
        if own:
            near = np.triu(near)
        i, j = np.nonzero(near)
        apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x[cu[i]] * y[cv[j]]).sum(axis=1)))
        stack += [(us[p], vs[q], r) for p, q, r in zip(i.tolist(), j.tolist(), apart.tolist(), strict=True) if not (us[p] is vs[q] and same and len(us[p].points) == 1)]
    if pi:
        yield np.concatenate(pi), np.concatenate(pj), False


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


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows with a label and a finite, non-null, non-zero vector, as doubles."""
    v = vectors.select("row", "label", F.col("embedding").cast("array<double>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return v.filter("row is not null and label is not null and v is not null").filter(good)


def _pivots(rows: DataFrame, s: Settings) -> dict[tuple[str, int], np.ndarray]:
    """Pivots, as unit vectors, of each large (label, dim) of rows(label, dim, row, v): a cover of a sample that is drawn by hash, so widely spread points. At most s.pivots in all; labels beyond have none and are dealt by hash alone."""
    large = rows.groupBy("label", "dim").agg(F.count("*").alias("n")).filter(F.col("n") > s.block)
    top = large.orderBy(F.desc("n"), "label", "dim").limit(s.pivots).collect()
    total = sum(r["n"] for r in top)
    wanted = {(r["label"], r["dim"]): min(-(-r["n"] // s.block), s.pivots * r["n"] // total) for r in top}
    wanted = {key: k for key, k in wanted.items() if k > 1}
    if not wanted:
        return {}
    rate = rows.sparkSession.createDataFrame([(r["label"], r["dim"], 4 * wanted[r["label"], r["dim"]] / r["n"]) for r in top if (r["label"], r["dim"]) in wanted], "label string, dim int, rate double")
    sample: dict[tuple[str, int], list] = {key: [] for key in wanted}
    drawn = rows.join(F.broadcast(rate), ["label", "dim"]).filter(uniform("row", s.seed) < F.col("rate"))
    for r in sorted(drawn.select("label", "dim", "row", "v").collect(), key=lambda r: r["row"]):
        sample[r["label"], r["dim"]].append(r["v"])
    out = {}
    for key, vectors in sample.items():
        if len(vectors) > 1:
            x = np.array(vectors)
            x /= np.sqrt((x * x).sum(axis=1))[:, None]
            chosen, away = [0], _away(x, x[:1])[:, 0]
            while len(chosen) < min(wanted[key], len(x)):  # the point farthest from those chosen
                chosen.append(int(away.argmax()))
                away = np.minimum(away, _away(x, x[chosen[-1:]])[:, 0])
            out[key] = x[chosen]
    return out


def _dealt(rows: DataFrame, s: Settings, keep: Keep) -> DataFrame:
    """rows with k: the block, by nearest pivot and, for pivots with more than s.block vectors, by hash."""
    shared = rows.sparkSession.sparkContext.broadcast(_pivots(rows, s))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell = np.zeros(len(batch), np.int64)
            for key, at in batch.groupby(["label", "dim"], sort=False).indices.items():
                pivots = shared.value.get(key)
                if pivots is not None:
                    v = np.stack(batch["v"].to_numpy()[at])
                    cell[at] = (v @ pivots.T).argmax(axis=1)
            yield batch.assign(cell=cell)

    schema = "label string, dim int, row long, v array<double>, n long, cell long"
    placed = keep(rows.select("label", "dim", "row", "v", "n").mapInPandas(nearest, schema), "ct-placed")
    per_cell = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / s.block).alias("blocks"))
    part = F.pmod(F.xxhash64("row", F.lit(s.seed)), "blocks")
    return placed.join(keep(per_cell, "ct-cells"), ["label", "dim", "cell"]).withColumn("k", F.col("cell") * (1 << 32) + part).drop("cell", "blocks")


def _packed_blocks(rows: DataFrame, s: Settings, keep: Keep) -> DataFrame:
    """One row per block of rows(label, dim, k, row, n, v): its ball (c, r) and, packed, its ids, counts, vectors and cover tree, so a tree is built once however many blocks it meets."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf["v"].to_numpy())
        unit = v / np.sqrt((v * v).sum(axis=1))[:, None]
        c = unit.mean(axis=0)
        single = v.astype(np.float32)
        stored = single if (single == v).all() else v
        block = (pdf["row"].to_numpy(), pdf["n"].to_numpy(), stored, build(unit, s.leaf))
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "dim": [pdf["dim"].iloc[0]], "k": [pdf["k"].iloc[0]], "c": [c], "r": [float(np.sqrt(((unit - c) ** 2).sum(axis=1)).max())], "block": [pickle.dumps(block, protocol=5)]})

    return keep(rows.groupBy("label", "dim", "k").applyInPandas(pack, "label string, dim int, k long, c array<double>, r double, block binary"), "ct-packed")


def blocks_met(packed: DataFrame, s: Settings) -> DataFrame:
    """Pairs of blocks (label, dim, lo, hi) of a label whose balls are near enough to hold a link."""
    limit = float(np.sqrt(max(0.0, 2 - 2 * s.cosine))) + 1e-6
    left = packed.select("label", "dim", F.col("k").alias("lo"), "c", "r")
    right = packed.select("label", "dim", F.col("k").alias("hi"), F.col("c").alias("d"), F.col("r").alias("q"))
    apart = F.sqrt(F.aggregate(F.zip_with("c", "d", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    met = left.join(right, ["label", "dim"]).filter((F.col("lo") <= F.col("hi")) & (apart <= F.col("r") + F.col("q") + limit))
    return met.select("label", "dim", "lo", "hi")


def _block_links(met: DataFrame, packed: DataFrame, s: Settings) -> DataFrame:
    """Per pair of blocks: (a, b null, n) link counts of a, copies of the other side counted, and (a, b, 0) links of a spanning forest."""
    limit = float(np.sqrt(max(0.0, 2 - 2 * s.cosine)))
    both = met.join(packed.select("label", "dim", F.col("k").alias("lo"), F.col("block").alias("x")), ["label", "dim", "lo"])
    both = both.join(packed.select("label", "dim", F.col("k").alias("hi"), F.col("block").alias("y")), ["label", "dim", "hi"])

    def unpacked(raw: bytes) -> tuple:
        ids, n, v, root = pickle.loads(raw)
        v = v.astype(np.float64)
        norm = np.sqrt((v * v).sum(axis=1))
        return ids, n, v, norm, v / norm[:, None], root

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        counts, pairs = {}, []

        def count(ids: np.ndarray, weight: np.ndarray) -> None:
            for key, w in zip(ids.tolist(), weight.tolist(), strict=True):
                counts[key] = counts.get(key, 0) + w

        for lo, hi, x, y in pdf[["lo", "hi", "x", "y"]].itertuples(index=False):
            same = lo == hi
            a = unpacked(x)
            b = a if same else unpacked(y)
            for i, j, whole in dual_pairs(a[5], b[5], a[4], b[4], limit, same):
                if whole:  # counts and a star, not the pairs
                    own = same and i is j
                    count(a[0][i], b[1][j].sum() - (b[1][j] if own else np.zeros(len(i), np.int64)))
                    pairs += [(int(a[0][i[0]]), int(p)) for p in b[0][j]]
                    if not own:
                        count(b[0][j], np.full(len(j), a[1][i].sum()))
                        pairs += [(int(b[0][j[0]]), int(p)) for p in a[0][i[1:]]]
                    continue
                cosine = (a[2][i] * b[2][j]).sum(axis=1) / (a[3][i] * b[3][j])
                i, j = i[cosine >= s.cosine], j[cosine >= s.cosine]
                count(a[0][i], b[1][j])
                count(b[0][j], a[1][i])
                pairs += _forest(list(zip(a[0][i].tolist(), b[0][j].tolist(), strict=True)))
        forest = _forest(pairs)
        out = pd.DataFrame({"a": [*counts, *(p[0] for p in forest)], "b": [*([None] * len(counts)), *(p[1] for p in forest)], "n": [*counts.values(), *([0] * len(forest))]})
        return out.astype({"a": "Int64", "b": "Int64", "n": "Int64"})

    return both.groupBy("label", "dim", "lo", "hi").applyInPandas(run, "a long, b long, n long")


def near_vectors(vectors: DataFrame, s: Settings = Settings(), keep: Keep = materialize) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors(vec_id, embedding, label).

    Only vectors of the same non-null label and length can be linked; null, zero and non-finite
    vectors have no links. Equal vectors of a label are one class, compared once and counted as
    often as there are rows. component_id is the smallest vec_id reachable. Rows that share a vec_id
    share a component but are separate vectors: each has its own n_links, which counts rows. Other
    columns are ignored. A null vec_id has no links and is kept. keep writes the steps, some of which the result reads.
    """
    plain = vectors.select("vec_id", "embedding", "label")
    unique = plain.filter("vec_id is not null").groupBy("vec_id").count().filter("count > 1").isEmpty()
    if unique:
        rows = plain.withColumn("row", F.col("vec_id"))
    else:  # written once, so that the numbers stay
        rows = keep(plain.withColumn("row", F.when(F.col("vec_id").isNotNull(), F.monotonically_increasing_id())), "ct-rows")
    good = _usable(rows).withColumns({"dim": F.size("v"), "label": F.col("label").cast("string"), "code": F.xxhash64("v"), "code2": F.sha2(F.to_json("v"), 256)})
    good = keep(good, "ct-vectors")
    same = ["label", "code", "code2"]
    size = good.select("row", *same)
    heads = size.groupBy(*same).agg(F.min("row").alias("rep"), F.count("*").alias("n"))
    several = keep(heads.filter("n > 1"), "ct-several")
    copies = keep(size.join(several, same).select("row", "rep", "n"), "ct-copies")
    first = good.join(copies.filter("row <> rep").select("row"), "row", "left_anti").join(several.select(F.col("rep").alias("row"), "n"), "row", "left")
    first = first.select("label", "dim", "row", "v", F.coalesce("n", F.lit(1)).cast("long").alias("n"))
    packed = _packed_blocks(_dealt(first, s, keep), s, keep)
    made = keep(_block_links(keep(blocks_met(packed, s), "ct-met"), packed, s), "ct-links")
    linked = keep(made.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links")), "ct-counts")
    edges = made.filter("b is not null").select("a", "b").union(copies.select(F.col("rep").alias("a"), F.col("row").alias("b")))
    if not unique:
        name = rows.filter("row is not null").select("row", "vec_id")
        edges = edges.join(name.toDF("a", "x"), "a").join(name.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    component = connected_components(edges, keep)
    out = rows.select("row", "vec_id").join(copies.withColumnRenamed("n", "alike"), "row", "left").withColumns({"rep": F.coalesce("rep", "row"), "alike": F.coalesce("alike", F.lit(1))})
    out = out.join(linked, "rep", "left").join(component.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    root = F.coalesce("component", "vec_id")
    return out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("alike") - 1).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(root == F.col("vec_id"), F.lit(True)).alias("kept"))


def op4_cover_tree(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_sql() -> str:
    """All pairs of a label; components by recursion; for small tables."""
    return """WITH RECURSIVE g AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r(v, t) AS (SELECT a, b FROM l UNION SELECT r.v, l.b FROM r JOIN l ON r.t = l.a),
m AS (SELECT v, min(t) AS t FROM r GROUP BY v),
c AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, coalesce(least(m.t, e.vec_id), e.vec_id) AS component_id, coalesce(least(m.t, e.vec_id), e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN m ON m.v = e.vec_id LEFT JOIN c ON c.a = e.vec_id"""
