"""Nearest neighbours by randomly rotated one-bit codes.

A vector's residual to a list centre, of unit length, is rotated at random into more dimensions and
only the signs are kept: packed bits, the residual's norm and one correction scalar, the cosine between
the rotated vector and its signs. For a query rotated alike, (signs . query) / correction estimates their
inner product without bias, and the error is of the size sqrt(1 - c^2) / c / sqrt(bits): times `width` it
is a bound that practically no pair exceeds. Distances follow from norms and inner products.

Vectors are dealt to the nearest of a few list centres, fitted on a bounded sample, every row indexed, and
packed into blocks of bounded size. A query first searches its own list, which gives a distance that its
tenth neighbour does not exceed, then the other lists whose balls reach within that distance. In a
block, only vectors whose lower bound is within the best distance so far are compared in double
precision. A block yields at most k rows a query, also where thousands of vectors are alike.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, table
from tidemark.llm.components import Keep


@dataclass(frozen=True)
class Settings:
    """k: neighbours. bits: bits of a code for each dimension. width: error bounds in standard deviations.
    block: expected vectors of a block, and queries of a batch. lists: most list centres of a length. sample: most vectors that fit the centres, in all. seed: of rotations and sample."""

    k: int = 10
    bits: int = 4
    width: float = 4.5
    block: int = 8192
    lists: int = 1024
    sample: int = 16384
    seed: int = 11


def rotation(dim: int, s: Settings) -> np.ndarray:
    """dim rows of orthonormal random directions in a multiple of 64 dimensions, at least s.bits * dim."""
    wide = -(-s.bits * dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng([s.seed, dim]).standard_normal((wide, dim)))
    return (q * np.sign(np.diag(r))).T.astype(np.float32)


@dataclass
class Codes:
    """Packed signs, correction scalar and norm of residuals."""

    signs: np.ndarray
    correction: np.ndarray
    norm: np.ndarray


def encode(residuals: np.ndarray, turn: np.ndarray) -> Codes:
    norm = np.sqrt((residuals * residuals).sum(axis=1))
    turned = (residuals / np.where(norm > 0, norm, 1.0)[:, None]).astype(np.float32) @ turn
    correction = np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1])
    return Codes(np.packbits(turned >= 0, axis=1), np.where(norm > 0, correction, 1.0), norm)


def bounds(codes: Codes, queries: np.ndarray, turn: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances from each query residual (rows) to each coded one, estimated, and how far they may be off."""
    wide = turn.shape[1]
    length = np.sqrt((queries * queries).sum(axis=1))
    signs = np.unpackbits(codes.signs, axis=1, count=wide).astype(np.float32) * 2 - 1
    inner = ((queries.astype(np.float32) @ turn) @ signs.T) / np.sqrt(wide) / codes.correction[None, :]
    scale = 2 * codes.norm
    estimate = (length * length)[:, None] + (codes.norm * codes.norm)[None, :] - scale[None, :] * inner
    spread = np.sqrt(np.maximum(0.0, 1 - codes.correction**2)) / codes.correction / np.sqrt(wide - 1)
    slack = 1e-5 * (length[:, None] + codes.norm[None, :]) ** 2  # single precision
    return estimate, s.width * length[:, None] * (scale * spread)[None, :] + slack


def search_block(ids: np.ndarray, vectors: np.ndarray, codes: Codes, centre: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, limit: np.ndarray, turn: np.ndarray, s: Settings) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, distances) of at most k rows of a block a query: those that may be among its nearest, ties to smaller ids. limit: distance that a query's k-th neighbour is known not to exceed."""
    step = max(1, 4_000_000 // max(1, len(ids)))

    def exact(at: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.sqrt(((vectors[at].astype(np.float64) - q) ** 2).sum(axis=1))

    for begin in range(0, len(queries), step):
        part = queries[begin : begin + step]
        estimate, off = bounds(codes, part - centre, turn, s)
        low = estimate - off
        for r, q in enumerate(part):
            own = ids == query_ids[begin + r]
            best = limit[begin + r] * (1 + 1e-12)
            few = min(len(ids), s.k + int(own.sum()))
            first = np.argpartition(estimate[r], few - 1)[:few]
            first = first[~own[first]]
            if len(first) >= s.k:
                best = min(best, float(np.partition(exact(first, q), s.k - 1)[s.k - 1]))
            at = np.flatnonzero((low[r] <= best * best + 1e-12) & ~own)
            away = exact(at, q)
            order = np.lexsort((ids[at], away))[: s.k]
            order = order[away[order] <= best]
            if len(order):
                yield begin + r, ids[at[order]], away[order]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, v) of the rows with an id and a finite, non-null, non-zero vector, as doubles."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return v.filter("vec_id is not null and v is not null").filter(good).select("vec_id", F.size("v").alias("dim"), "v")


def centres(rows: DataFrame, s: Settings, rounds: int = 4) -> dict[int, np.ndarray]:
    """List centres a vector length: means of a sample drawn by hash, at most s.sample vectors in all, after a few rounds of k-means; as many as there are blocks, at most s.lists and a sixteenth of the sample. Lengths without a sample have the origin."""
    counted = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(64).collect()}
    total = sum(counted.values())
    if not total:
        return {}
    rate = min(1.0, s.sample / total / 1.1)
    drawn = rows.filter(F.col("dim").isin(list(counted))).filter(F.pmod(F.xxhash64("vec_id", F.lit(s.seed)), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1).limit(s.sample)
    sample: dict[int, list] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r["vec_id"], r["v"])):
        sample.setdefault(r["dim"], []).append(r["v"])
    out = {}
    for dim, vectors in sample.items():
        x = np.array(vectors)
        n = max(1, min(s.lists, -(-counted[dim] // s.block), len(x) // 16))
        c = x[np.random.default_rng(s.seed).choice(len(x), n, replace=False)]
        for _ in range(rounds):
            near = nearest(x, c)
            c = np.stack([x[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(n)])
        out[dim] = c
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)).argmin(axis=1)


def index(rows: DataFrame, fitted, s: Settings, keep: Keep) -> tuple[DataFrame, DataFrame]:
    """Blocks (dim, list, part, block) of all rows and lists (dim, list, n, radius). fitted: broadcast centres."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, away = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for dim, at in batch.groupby("dim", sort=False).indices.items():
                x = np.stack(batch["v"].to_numpy()[at])
                c = fitted.value.get(dim, np.zeros((1, dim)))
                cell[at] = nearest(x, c)
                away[at] = np.sqrt(((x - c[cell[at]]) ** 2).sum(axis=1))
            yield batch.assign(list=cell, away=away)

    dealt = keep(rows.mapInPandas(deal, "vec_id long, dim int, v array<double>, list long, away double"), "rc-dealt")
    lists = keep(dealt.groupBy("dim", "list").agg(F.count("*").alias("n"), F.max("away").alias("radius")), "rc-lists")
    part = F.pmod(F.xxhash64("vec_id", F.lit(s.seed)), F.ceil(F.col("n") / s.block))
    cut = dealt.join(F.broadcast(lists.select("dim", "list", "n")), ["dim", "list"]).withColumn("part", part)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        dim, cell = int(pdf["dim"].iloc[0]), int(pdf["list"].iloc[0])
        x = np.stack(pdf["v"].to_numpy())
        c = fitted.value.get(dim, np.zeros((1, dim)))[cell]
        single = x.astype(np.float32)
        block = (pdf["vec_id"].to_numpy(), single if (single == x).all() else x, encode(x - c, rotation(dim, s)), c)
        return pd.DataFrame({"dim": [dim], "list": [cell], "part": [pdf["part"].iloc[0]], "block": [pickle.dumps(block, protocol=5)]})

    blocks = keep(cut.select("dim", "list", "part", "vec_id", "v").groupBy("dim", "list", "part").applyInPandas(pack, "dim int, list long, part long, block binary"), "rc-blocks")
    return blocks, lists


def visits(blocks: DataFrame, asked: DataFrame, s: Settings, keep: Keep) -> DataFrame:
    """(query_id, vec_id, score) from each block of the lists that asked(dim, list, query_id, q, bound) names: at most k a query and block. Blocks meet batches of queries by key, so a list of many blocks is spread."""
    batches = asked.groupBy("dim", "list").agg(F.ceil(F.count("*") / s.block).alias("batches"))
    sets = asked.join(batches, ["dim", "list"]).withColumn("batch", F.pmod(F.xxhash64("query_id", F.lit(s.seed)), "batches"))

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        packed = (pdf["query_id"].to_numpy(), np.stack(pdf["q"].to_numpy()), pdf["bound"].to_numpy(np.float64))
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "list": [pdf["list"].iloc[0]], "batch": [pdf["batch"].iloc[0]], "asked": [pickle.dumps(packed, protocol=5)]})

    sets = sets.select("dim", "list", "batch", "query_id", "q", "bound").groupBy("dim", "list", "batch").applyInPandas(gather, "dim int, list long, batch long, asked binary")
    sets = keep(sets, "rc-asked")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for dim, block, asked in pdf[["dim", "block", "asked"]].itertuples(index=False):
            ids, vectors, codes, centre = pickle.loads(block)
            query_ids, queries, limit = pickle.loads(asked)
            for r, found, away in search_block(ids, vectors, codes, centre, query_ids, queries, limit, rotation(dim, s), s):
                out.append((np.full(len(found), query_ids[r]), found, away))
        cols = [np.concatenate([o[k] for o in out]) if out else np.zeros(0) for k in range(3)]
        return pd.DataFrame({"query_id": cols[0].astype(np.int64), "vec_id": cols[1].astype(np.int64), "score": cols[2].astype(np.float64)})

    met = blocks.select("dim", "list", "part").join(sets.select("dim", "list", "batch"), ["dim", "list"])
    both = met.join(blocks, ["dim", "list", "part"]).join(sets, ["dim", "list", "batch"])
    return both.groupBy("dim", "list", "part", "batch").applyInPandas(run, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, queries: DataFrame, s: Settings = Settings(), keep: Keep = materialize) -> DataFrame:
    """(query_id, rank, vec_id, score): the s.k nearest rows of vectors(vec_id, embedding) to each row of queries(vec_id, embedding), by Euclidean distance in double precision, ties to the smaller vec_id.

    A row with the query's own vec_id is no candidate. Vectors that are null or zero or hold a null or
    non-finite component take no part on either side, nor do null ids; vectors of another length than
    the query's are no candidates. Of queries that share a vec_id the smallest vector is asked; candidates
    that share one are rows of their own. Queries with fewer candidates get all of them, empty tables
    none. Other columns are ignored. keep writes the steps, some of which the result reads.
    """
    rows = usable(vectors)
    spark = rows.sparkSession
    fitted = spark.sparkContext.broadcast(centres(rows, s))
    blocks, lists = index(rows, fitted, s, keep)
    balls = [(r["dim"], r["list"], r["radius"]) for r in lists.collect()]  # at most s.lists a length
    reach = spark.sparkContext.broadcast({dim: sorted((cell, radius) for d, cell, radius in balls if d == dim) for dim in {b[0] for b in balls}})

    def routes(batches: Iterator[pd.DataFrame], home: bool) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for dim, at in batch.groupby("dim", sort=False).indices.items():
                known = reach.value.get(dim)
                if not known:
                    continue
                cells, radius = np.array([c for c, _ in known]), np.array([r for _, r in known])
                q = np.stack(batch["q"].to_numpy()[at])
                away = np.sqrt(((q[:, None, :] - fitted.value.get(dim, np.zeros((1, dim)))[cells][None, :, :]) ** 2).sum(axis=2))
                first = np.zeros(away.shape, bool)
                first[np.arange(len(q)), away.argmin(axis=1)] = True
                go = first if home else ~first & (away - radius[None, :] <= batch["bound"].to_numpy()[at][:, None] * (1 + 1e-9) + 1e-9)
                r, c = np.nonzero(go)
                made.append(batch.iloc[at[r]].assign(list=cells[c]))
            if made:
                yield pd.concat(made)

    schema = "dim int, query_id long, q array<double>, bound double, list long"
    asked = usable(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("v", "dim")).alias("m"))
    asked = keep(asked.select(F.col("m.dim").alias("dim"), "query_id", F.col("m.v").alias("q"), F.lit(float("inf")).alias("bound")), "rc-queries")
    at_home = keep(visits(blocks, keep(asked.mapInPandas(lambda b: routes(b, True), schema), "rc-near"), s, keep), "rc-home")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    tenth = at_home.withColumn("rank", rank).filter(F.col("rank") <= s.k).groupBy("query_id").agg(F.max("score").alias("far"), F.count("*").alias("n"))
    bounded = asked.join(tenth.filter(F.col("n") == s.k), "query_id", "left").select("dim", "query_id", "q", F.coalesce("far", "bound").alias("bound"))
    abroad = visits(blocks, keep(bounded.mapInPandas(lambda b: routes(b, False), schema), "rc-abroad"), s, keep)
    found = keep(at_home.unionByName(abroad), "rc-found")
    return found.withColumn("rank", rank).filter(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")


def op11_rotated_codes(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 100 = 0"))


def op11_sql() -> str:
    """Every query against all rows; for small tables."""
    return """WITH g AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_distance(a.v, b.v) AS score FROM g a JOIN g b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
