"""Retrieval operators: BM25, dense ranks, rank fusion, rerank, diverse selection, quality metrics, packing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import bigrams, search_tokens
from tidemark.operators.search import bm25, dense, top

#: List sizes, the rank constant of fusion.
DENSE_K, BM25_K, FUSED_K, RETURN_K, PER_DOCUMENT, RRF_K = 40, 40, 50, 12, 4, 60


def corpus_statistics(docs: DataFrame, part: str) -> tuple[DataFrame, DataFrame]:
    """(documents and mean length per part, documents of each term per part) of docs(part, doc_id, tokens)."""
    size = docs.groupBy(part).agg(F.count("*").alias("n_docs"), (F.sum(F.size("tokens")).cast("double") / F.count("*").cast("double")).alias("avgdl"))
    df = docs.select(part, F.explode_outer(F.array_distinct("tokens")).alias("term")).filter("term is not null").groupBy(part, "term").agg(F.count("*").alias("df"))
    return size, df


def fuse(lists: list[DataFrame], k: int = RRF_K, limit: int = FUSED_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, doc_id, rank): the sum of 1 / (k + rank), best first."""
    every = lists[0].select("query_id", "doc_id", "rank")
    for more in lists[1:]:
        every = every.unionByName(more.select("query_id", "doc_id", "rank"))
    fused = every.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (F.lit(float(k)) + F.col("rank"))).alias("score"))
    return top(fused, "query_id", "score", limit, "rank")


def hybrid(docs: DataFrame, queries: DataFrame, part: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dense, lexical and fused lists of docs(part, doc_id, text, v) for queries(part, query_id, text, q). A null v or q is in no dense list."""
    first, second = dense_list(docs, queries, part), lexical_list(docs, queries, part)
    return first, second, fuse([first, second])


def dense_list(docs: DataFrame, queries: DataFrame, part: str) -> DataFrame:
    return dense(docs.select(part, "doc_id", "v"), queries.select(part, "query_id", "q"), part, DENSE_K)


def lexical_list(docs: DataFrame, queries: DataFrame, part: str) -> DataFrame:
    return bm25(docs.select(part, "doc_id", "text"), queries.select(part, "query_id", "text"), part, BM25_K, search_tokens(F.col("text")))


def chosen(rows: list[tuple], limit: int = RETURN_K, per_document: int = PER_DOCUMENT, overlap: float = 0.8) -> list[int]:
    """A greedy walk of rows (parent_id, section, set of grams) in order: the places of those kept.

    A row is skipped when its parent already has per_document rows, or when a kept row of the same
    parent and section covers it; the walk stops at limit.
    """
    kept, count, out = [], {}, []
    for place, (mine, within, grams) in enumerate(rows):
        if len(out) == limit:
            break
        if count.get(mine, 0) >= per_document:
            continue
        repeat = False
        for parent, section, other in kept:
            if parent == mine and section == within:
                short, long_ = (grams, other) if len(grams) <= len(other) else (other, grams)
                if short and len(short & long_) / len(short) >= overlap:
                    repeat = True
                    break
        if repeat:
            continue
        kept.append((mine, within, grams))
        count[mine] = count.get(mine, 0) + 1
        out.append(place)
    return out


def diverse(ranked: DataFrame, limit: int = RETURN_K, per_document: int = PER_DOCUMENT, overlap: float = 0.8) -> DataFrame:
    """What a greedy walk (chosen) keeps of ranked(query_id, doc_id, parent_id, section, grams, position), with rank.

    What is skipped depends on what was kept, so a query's list (FUSED_K rows at most) is walked in one
    task; queries run in parallel.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        at = chosen([(p, s, set(g)) for p, s, g in zip(pdf["parent_id"], pdf["section"], pdf["grams"], strict=True)], limit, per_document, overlap)
        return pdf[["query_id", "doc_id"]].iloc[at].assign(rank=range(1, len(at) + 1))

    schema = T.StructType([ranked.schema["query_id"], ranked.schema["doc_id"], T.StructField("rank", T.IntegerType())])
    return ranked.select("query_id", "doc_id", "parent_id", "section", "grams", "position").groupBy("query_id").applyInPandas(walk, schema)


def bigram_sums(rows: DataFrame, key: str, text: str, dims: int) -> DataFrame:
    """(key, index, v): a bigram's SHA-256 gives the index (first four bytes modulo dims) and the sign (parity of the fifth); sums of signs, also those of 0. An empty text is the first axis."""
    grams = rows.select(key, F.explode_outer(bigrams(F.col(text))).alias("g"))
    h = F.sha2("g", 256)
    index = F.when(F.col("g").isNull(), 0).otherwise(F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dims)
    sign = F.when(F.col("g").isNull() | (F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0), 1).otherwise(-1)
    return grams.select(key, index.alias("index"), sign.alias("s")).groupBy(key, "index").agg(F.sum("s").alias("v"))


def hash_embedding(rows: DataFrame, key: str, text: str, dims: int) -> DataFrame:
    """Sparse rows (key, index, value) of hashed bigram embeddings (bigram_sums) with unit length; a text whose bigrams all cancel has none."""
    summed = bigram_sums(rows, key, text, dims).filter("v <> 0")
    norm = F.sqrt(F.sum((F.col("v") * F.col("v")).cast("double")).over(Window.partitionBy(key)))
    return summed.select(key, "index", (F.col("v").cast("double") / norm).alias("value"))


def pack_sentences(sentence_list: Column, target: int, overlap: int) -> Column:
    """Chunks of consecutive sentences: array of struct(first, last, tokens), sentence numbers from 1.

    A chunk takes sentences while it stays within target tokens (one always fits); the next begins
    with the trailing sentences of the last that hold at most overlap tokens. One fold over the array.
    """
    item = "struct<first:int,last:int,tokens:int>"
    counts = F.transform(sentence_list, lambda s, i: F.struct((i + 1).alias("i"), _tokens(s).alias("n")))
    zero = F.struct(F.array().cast(f"array<{item}>").alias("done"), F.lit(0).alias("first"), F.lit(0).alias("tokens"), F.array().cast("array<struct<i:int,n:int>>").alias("tail"))

    def trailing(tail: Column) -> Column:
        back = F.aggregate(
            F.reverse(tail),
            F.struct(F.lit(0).alias("sum"), F.array().cast("array<struct<i:int,n:int>>").alias("keep")),
            lambda a, x: F.when(a["sum"] + x["n"] <= overlap, F.struct((a["sum"] + x["n"]).alias("sum"), F.concat(F.array(x), a["keep"]).alias("keep"))).otherwise(F.struct(F.lit(overlap + 1).alias("sum"), a["keep"].alias("keep"))),
        )
        return back["keep"]

    def step(a: Column, x: Column) -> Column:
        fits = (F.size(a["tail"]) == 0) | (a["tokens"] + x["n"] <= target)
        more = F.struct(a["done"].alias("done"), F.when(F.size(a["tail"]) == 0, x["i"]).otherwise(a["first"]).alias("first"), (a["tokens"] + x["n"]).alias("tokens"), F.concat(a["tail"], F.array(x)).alias("tail"))
        closed = F.concat(a["done"], F.array(F.struct(a["first"].alias("first"), (x["i"] - 1).alias("last"), a["tokens"].alias("tokens"))))
        carry = trailing(a["tail"])
        carried = F.aggregate(carry, F.lit(0), lambda s, y: s + y["n"])
        room = carried + x["n"] <= target
        begin = F.when(room & (F.size(carry) > 0), carry[0]["i"]).otherwise(x["i"])
        tail = F.when(room, F.concat(carry, F.array(x))).otherwise(F.array(x))
        new = F.struct(closed.alias("done"), begin.alias("first"), F.when(room, carried + x["n"]).otherwise(x["n"]).alias("tokens"), tail.alias("tail"))
        return F.when(fits, more).otherwise(new)

    def finish(a: Column) -> Column:
        last = F.struct(a["first"].alias("first"), F.element_at(a["tail"], -1)["i"].alias("last"), a["tokens"].alias("tokens"))
        return F.when(F.size(a["tail"]) == 0, a["done"]).otherwise(F.concat(a["done"], F.array(last)))

    return F.aggregate(counts, zero, step, finish)


def _tokens(text: Column) -> Column:
    from tidemark.functions.text import approx_tokens

    return approx_tokens(text).cast("int")


def active_only(hits: DataFrame, versions: DataFrame, key: str) -> DataFrame:
    """Hits whose version is known, active and of a document that is not deleted."""
    return hits.join(versions.filter("status = 'ACTIVE' and deleted_at is null").select(key), key, "left_semi")


def parent_texts(chunks: DataFrame, depth: int = 3) -> DataFrame:
    """chunks(chunk_id, parent_id, version, text) with ancestors: the texts of up to depth parents of the same version, nearest first; the chain ends at a missing parent or one of another version."""
    out = chunks.select("chunk_id", "version", F.col("parent_id").alias("next"), F.array().cast("array<string>").alias("ancestors"))
    up = chunks.select(F.col("chunk_id").alias("next"), F.col("version").alias("v"), F.col("parent_id").alias("p"), F.col("text").alias("t"))
    for _ in range(depth):
        out = out.join(up, "next", "left")
        same = F.col("v") == F.col("version")
        out = out.select("chunk_id", "version", F.when(same, F.col("p")).alias("next"), F.when(same, F.array_append("ancestors", F.col("t"))).otherwise(F.col("ancestors")).alias("ancestors"))
    return out.select("chunk_id", "ancestors")


def allowed_documents(docs: DataFrame, types: list[str] | None = None, since: str | None = None, until: str | None = None, verified_only: bool = False) -> DataFrame:
    """The documents a search may see: of one of types, published on a day in [since, until] (a document without a time is outside any window), and needing no verification where verified_only. docs(document_type, published_at, requires_verification); None does not filter.

    It filters before statistics are taken, so ranks are those of what may be seen.
    """
    keep = F.lit(True)
    if types is not None:
        keep = keep & F.col("document_type").isin(types)
    if since is not None:
        keep = keep & (F.to_date("published_at") >= F.lit(since).cast("date"))
    if until is not None:
        keep = keep & (F.to_date("published_at") <= F.lit(until).cast("date"))
    if verified_only:
        keep = keep & ~F.coalesce(F.col("requires_verification"), F.lit(False))
    return docs.filter(F.coalesce(keep, F.lit(False)))


def retrieval_signals(reranked: DataFrame, returned: DataFrame) -> DataFrame:
    """Per query of reranked(query_id): rows reranked and returned, the share that selection dropped, and distinct documents per row returned(query_id, parent_id); 0 where nothing is returned."""
    before = reranked.groupBy("query_id").agg(F.count("*").alias("reranked"))
    after = returned.groupBy("query_id").agg(F.count("*").alias("returned"), F.countDistinct("parent_id").alias("parents"))
    j = before.join(after, "query_id", "left").withColumns({"returned": F.coalesce("returned", F.lit(0)), "parents": F.coalesce("parents", F.lit(0))})
    diversity = F.when(F.col("returned") > 0, F.col("parents") / F.col("returned")).otherwise(0.0)
    return j.select("query_id", "reranked", "returned", ((F.col("reranked") - F.col("returned")) / F.col("reranked")).alias("duplicate_rate"), diversity.alias("source_diversity"))


def duplicate_ratio(results: DataFrame, k: int = RETURN_K) -> DataFrame:
    """Per query of results(query_id, rank, content_hash): the share of the first k that repeats the content of another one."""
    n = F.count("*")
    return results.filter(F.col("rank") <= k).groupBy("query_id").agg(((n - F.countDistinct("content_hash")) / n).alias("duplicate_ratio"))
