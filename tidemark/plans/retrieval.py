"""Retrieval queries over documents, embeddings and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import chunking as C
from tidemark.operators import documents as D
from tidemark.operators import retrieval as R
from tidemark.operators import search as S
from tidemark.sources.steps import written
from tidemark.sources.tables import NEWS_SQL, news_documents, read, spread


def _texts(spark, sf_dir):
    """Every document, without its vector: what lexical steps read."""
    return spread(read(spark, sf_dir, "documents"), "doc_id").select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang"), "source")


def _asked_texts(docs):
    """The documents whose id is divisible by 20, as questions with their whole text."""
    return docs.filter("doc_id % 20 = 0").select("lang", F.col("doc_id").alias("query_id"), "text")


def _corpus(spark, sf_dir):
    """Every document without its text; v is null where it has no vector. A search sees the documents of its language."""
    docs = _texts(spark, sf_dir).select("doc_id", "lang")
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    return docs.join(vectors, "doc_id", "left")


def _asked(docs):
    """The documents whose id is divisible by 20, as questions with their vector."""
    return docs.filter("doc_id % 20 = 0").select("lang", F.col("doc_id").alias("query_id"), F.col("v").alias("q"))


def _queries(spark, sf_dir):
    return _asked(_corpus(spark, sf_dir))


_BASE = r"""corpus AS (SELECT doc_id, text, coalesce(lang, '') AS lang, source, embedding AS v, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS tokens FROM documents LEFT JOIN embeddings ON doc_id = vec_id),
q AS (SELECT lang, doc_id AS query_id, text AS qtext, tokens AS qtokens, v AS qv FROM corpus WHERE doc_id % 20 = 0)"""
_DENSE = """densed AS (SELECT query_id, doc_id, list_cosine_similarity(CAST(v AS DOUBLE[]), CAST(qv AS DOUBLE[])) AS score FROM corpus JOIN q USING (lang) WHERE v IS NOT NULL AND qv IS NOT NULL),
dlist AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INT) AS rank FROM densed QUALIFY rank <= 40)"""
_BM25 = """asked AS (SELECT lang, query_id, term, count(*) AS asked FROM (SELECT lang, query_id, unnest(qtokens) AS term FROM q) GROUP BY ALL),
sz AS (SELECT lang, count(*) AS n_docs, CAST(sum(len(tokens)) AS DOUBLE) / count(*) AS avgdl FROM corpus GROUP BY 1),
tf AS (SELECT lang, doc_id, dl, term, count(*) AS tf FROM (SELECT lang, doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM corpus) GROUP BY ALL),
df AS (SELECT lang, term, count(*) AS df FROM tf GROUP BY 1, 2),
lex AS (SELECT query_id, doc_id, sum(asked * ln(CAST(1 AS DOUBLE) + (n_docs - df + 0.5) / (df + 0.5)) * (tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl)))) AS score FROM tf JOIN asked USING (lang, term) JOIN df USING (lang, term) JOIN sz USING (lang) GROUP BY 1, 2),
llist AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INT) AS rank FROM lex WHERE score > 0 QUALIFY rank <= 40)"""
_FUSED = """fsum AS (SELECT query_id, doc_id, sum(CAST(1.0 AS DOUBLE) / (60 + rank)) AS score FROM (SELECT query_id, doc_id, rank FROM dlist UNION ALL SELECT query_id, doc_id, rank FROM llist) GROUP BY 1, 2),
fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INT) AS rank FROM fsum QUALIFY rank <= 50)"""
_ALL = f"WITH {_BASE}, {_DENSE}, {_BM25}, {_FUSED}"
_R9 = lambda df: df.withColumn("score", F.round("score", 6))


def _dense(spark, sf_dir):
    return R.dense_list(_corpus(spark, sf_dir), _queries(spark, sf_dir), "lang")


def _lexical(spark, sf_dir):
    docs = _texts(spark, sf_dir)
    return R.lexical_list(docs, _asked_texts(docs), "lang")


def _fused(spark, sf_dir):
    return R.fuse([_dense(spark, sf_dir), _lexical(spark, sf_dir)])


def dense_rank(spark, sf_dir):
    return _R9(_dense(spark, sf_dir))


def bm25_rank(spark, sf_dir):
    return _R9(_lexical(spark, sf_dir))


def hybrid_search(spark, sf_dir):
    return _R9(_fused(spark, sf_dir))


def corpus_statistics(spark, sf_dir):
    docs = _texts(spark, sf_dir).select("lang", "doc_id", X.search_tokens(F.col("text")).alias("tokens"))
    size, df = R.corpus_statistics(docs, "lang")
    terms = df.groupBy("lang").agg(F.count("*").alias("terms"), F.max("df").alias("max_df"))
    return size.join(terms, "lang").withColumn("avgdl", F.round("avgdl", 6))


STATS_SQL = f"WITH {_BASE}, {_BM25} SELECT lang, n_docs, round(avgdl, 6) AS avgdl, terms, max_df FROM sz JOIN (SELECT lang, count(*) AS terms, max(df) AS max_df FROM df GROUP BY 1) USING (lang)"


def _reranked(spark, sf_dir, chosen=None):
    """The fused lists in order of bigram overlap, with the documents' bigrams, which are taken once a document; chosen: what selection keeps of a list."""
    fused = _fused(spark, sf_dir).select("query_id", "doc_id")
    grams = written(_texts(spark, sf_dir).select("doc_id", F.col("source").alias("parent_id"), F.col("lang").alias("section"), S.gram_strings(F.coalesce("text", F.lit(""))).alias("grams")), "rag-grams")
    return S.overlaps(fused, grams, chosen)


def rerank(spark, sf_dir):
    return _R9(_reranked(spark, sf_dir)).select("query_id", "doc_id", "score", "position")


_GRAMS = lambda t: f"list_distinct(list_transform(range(1, greatest(length({t}), 2)), lambda i: substr({t}, i, 2)))"
RERANK_SQL = rf"""{_ALL}, plain AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\s+', '', 'g') AS t FROM corpus),
grams AS MATERIALIZED (SELECT doc_id, CASE WHEN t = '' THEN [] ELSE {_GRAMS("t")} END AS g FROM plain),
s AS (SELECT fused.query_id, fused.doc_id, CASE WHEN len(a.g) = 0 THEN 0.0 ELSE CAST(len(list_intersect(a.g, b.g)) AS DOUBLE) / len(a.g) END AS score FROM fused JOIN grams a ON a.doc_id = fused.query_id JOIN grams b ON b.doc_id = fused.doc_id)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INT) AS position FROM s"""


def diverse_selection(spark, sf_dir):
    return _reranked(spark, sf_dir, R.chosen).filter("kept is not null").select("query_id", "doc_id", F.col("kept").alias("rank"))


def retrieval_metrics(spark, sf_dir):
    """The good documents of a question's language are relevant, in three grades."""
    graded = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id", (F.col("doc_id") % 3 + 1).alias("grade"))
    graded = _texts(spark, sf_dir).select("lang", "doc_id").join(graded, "doc_id")
    m = S.partition_metrics(_fused(spark, sf_dir), graded, _asked_texts(_texts(spark, sf_dir)).select("lang", "query_id"), "lang", R.RETURN_K)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


METRICS_SQL = f"""{_ALL}, truth AS (SELECT query_id, corpus.doc_id, corpus.doc_id % 3 + 1 AS grade FROM corpus JOIN labels ON labels.doc_id = corpus.doc_id AND quality = 1 JOIN q USING (lang)),
got AS (SELECT query_id, count(*) AS hits, min(rank) AS f, sum(grade / log2(rank + 1)) AS dcg FROM fused JOIN truth USING (query_id, doc_id) WHERE rank <= 12 GROUP BY 1),
ideal AS (SELECT query_id, count(*) AS relevant, sum(CASE WHEN i <= 12 THEN grade / log2(i + 1) END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS i FROM truth) GROUP BY 1)
SELECT query_id, round(coalesce(hits, 0) / relevant, 6) AS recall, round(coalesce(CAST(1.0 AS DOUBLE) / f, 0), 6) AS mrr, round(coalesce(dcg / idcg, 0), 6) AS ndcg FROM ideal LEFT JOIN got USING (query_id)"""


def metric_summary(spark, sf_dir):
    """Macro means over queries."""
    return retrieval_metrics(spark, sf_dir).agg(*[F.round(F.avg(c), 5).alias(c) for c in ("recall", "mrr", "ndcg")])


SUMMARY_SQL = f"WITH m AS ({METRICS_SQL}) SELECT round(avg(recall), 5) AS recall, round(avg(mrr), 5) AS mrr, round(avg(ndcg), 5) AS ndcg FROM m"


def token_counts(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", X.approx_tokens(F.col("text")).cast("long").alias("tokens"), F.size(X.sentences(F.col("text"))).cast("long").alias("sentences"), X.content_hash(F.col("text")).alias("hash"))


TOKENS_SQL = r"""SELECT doc_id, len(regexp_extract_all(text, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]')) + len(regexp_extract_all(regexp_replace(text, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]', ' ', 'g'), '\S+')) AS tokens,
len(list_filter(list_transform(regexp_extract_all(text, '[^。！？!?；;\n]*[。！？!?；;]|[^。！？!?；;\n]+'), lambda x: trim(x)), lambda x: x <> '')) AS sentences, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS hash FROM documents"""


def chunk_packing(spark, sf_dir):
    """Chunks of up to 400 tokens of each document's lines, with up to 65 tokens of overlap."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(R.pack_sentences(X.sentences(F.col("text")), 400, 65)).alias("c"))
    return d.select("doc_id", "c.first", "c.last", "c.tokens")


def hash_embedding(spark, sf_dir):
    out = R.hash_embedding(read(spark, sf_dir, "part"), "p_partkey", "p_name", 64)
    return out.withColumn("value", F.round("value", 9))


HASH_SQL = rf"""WITH g AS (SELECT p_partkey, unnest({_GRAMS("t")}) AS g FROM (SELECT p_partkey, regexp_replace(p_name, '\s+', '', 'g') AS t FROM part)),
h AS (SELECT p_partkey, CAST(('0x' || substr(sha256(g), 1, 8)) AS BIGINT) % 64 AS index, CASE WHEN CAST(('0x' || substr(sha256(g), 9, 2)) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS s FROM g),
v AS (SELECT p_partkey, index, sum(s) AS v FROM h GROUP BY 1, 2 HAVING sum(s) <> 0)
SELECT p_partkey, index, round(CAST(v AS DOUBLE) / sqrt(sum(CAST(v * v AS DOUBLE)) OVER (PARTITION BY p_partkey)), 9) AS value FROM v"""


def coverage_pairs(spark, sf_dir):
    """Bigram coverage of consecutive benchmark passages."""
    b = read(spark, sf_dir, "benchmark")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(nxt, "item_id").select("item_id", F.round(X.coverage(F.col("text"), F.col("other")), 9).alias("coverage"))


COVERAGE_SQL = rf"""WITH p AS (SELECT a.item_id, CASE WHEN length(a.text) <= length(b.text) THEN a.text ELSE b.text END AS s, CASE WHEN length(a.text) <= length(b.text) THEN b.text ELSE a.text END AS l FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
t AS (SELECT item_id, regexp_replace(s, '\s+', '', 'g') AS s, regexp_replace(l, '\s+', '', 'g') AS l FROM p)
SELECT item_id, round(CAST(len(list_intersect({_GRAMS("s")}, {_GRAMS("l")})) AS DOUBLE) / len({_GRAMS("s")}), 9) AS coverage FROM t"""


def active_hits(spark, sf_dir):
    """fused hits whose document version (by label row) is active and not toxic (deleted)."""
    hits = _fused(spark, sf_dir).select("query_id", "doc_id", "rank")
    versions = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "ACTIVE").otherwise("SUPERSEDED").alias("status"), F.when(F.col("toxic") == 1, F.lit("2024-01-01")).alias("deleted_at"))
    return R.active_only(hits, versions, "doc_id")


ACTIVE_SQL = f"{_ALL} SELECT query_id, doc_id, rank FROM fused WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic <> 1)"


def parent_chain(spark, sf_dir):
    """Documents as chunks whose parent is the document with half their id, versions by language."""
    c = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") > 0, F.floor(F.col("doc_id") / 2)).alias("parent_id"), F.col("lang").alias("version"), F.substring(F.sha2("text", 256), 1, 8).alias("text"))
    return R.parent_texts(c).select("chunk_id", F.array_join("ancestors", ",").alias("ancestors"))


PARENT_SQL = """WITH c AS (SELECT doc_id AS chunk_id, CASE WHEN doc_id > 0 THEN doc_id // 2 END AS parent_id, lang AS version, substr(sha256(text), 1, 8) AS text FROM documents)
SELECT c.chunk_id, array_to_string(list_filter([CASE WHEN p1.chunk_id IS NOT NULL THEN p1.text END, CASE WHEN p2.chunk_id IS NOT NULL THEN p2.text END, CASE WHEN p3.chunk_id IS NOT NULL THEN p3.text END], lambda x: x IS NOT NULL), ',') AS ancestors
FROM c LEFT JOIN c p1 ON p1.chunk_id = c.parent_id AND p1.version = c.version LEFT JOIN c p2 ON p2.chunk_id = p1.parent_id AND p2.version = c.version LEFT JOIN c p3 ON p3.chunk_id = p2.parent_id AND p3.version = c.version"""


FILTER = {"types": ["PRIMARY", "REPUTABLE_MEDIA"], "since": "2024-01-01", "until": "2024-01-20", "verified_only": True}


def filtered_search(spark, sf_dir):
    """The twelve best documents of each question among those of the allowed types, days and without need of verification; statistics are those of the allowed ones."""
    d = news_documents(spark, sf_dir).select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text", F.col("source_grade").alias("document_type"), F.timestamp_micros("published_us").alias("published_at"), F.col("citation_url").isNull().alias("requires_verification"))
    asked = d.filter("doc_id % 20 = 0").select("lang", F.col("doc_id").alias("query_id"), "text")
    seen = R.allowed_documents(d, **FILTER).select("lang", "doc_id", "text")
    return _R9(S.bm25(seen, asked, "lang", R.RETURN_K, X.search_tokens(F.col("text"))))


_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')"
FILTERED_SQL = f"""WITH {NEWS_SQL}, corpus AS (SELECT doc_id, coalesce(lang, '') AS lang, {_TOKENS} AS tokens FROM news WHERE source_grade IN ('PRIMARY', 'REPUTABLE_MEDIA') AND CAST(make_timestamp(published_us) AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-20' AND citation_url IS NOT NULL),
q AS (SELECT coalesce(lang, '') AS lang, doc_id AS query_id, {_TOKENS} AS qtokens FROM documents WHERE doc_id % 20 = 0), {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM llist WHERE rank <= 12"""


def duplicate_ratio(spark, sf_dir):
    """The share of each question's first twelve fused results that repeats another one's text."""
    texts = _texts(spark, sf_dir).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    return R.duplicate_ratio(_fused(spark, sf_dir).join(texts, "doc_id")).withColumn("duplicate_ratio", F.round("duplicate_ratio", 9))


DUPLICATE_SQL = f"{_ALL} SELECT query_id, round(CAST(count(*) - count(DISTINCT coalesce(text, '')) AS DOUBLE) / count(*), 9) AS duplicate_ratio FROM fused JOIN corpus USING (doc_id) WHERE rank <= 12 GROUP BY 1"


def signals(spark, sf_dir):
    """How much selection drops of each question's reranked list, and how many sources are left."""
    reranked = written(_reranked(spark, sf_dir, R.chosen).select("query_id", "parent_id", "kept"), "rag-reranked")
    return R.retrieval_signals(reranked, reranked.filter("kept is not null"))


def chunks(spark, sf_dir):
    """Structural chunks of every document."""
    made = C.chunk(D.markdown_blocks(read(spark, sf_dir, "documents"), "doc_id"), "doc_id")
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["block"], s["start"], s["end"])), ",")
    return made.select("doc_id", "section", "child", "role", "chunk_type", F.length("content").alias("chars"), spans.alias("spans"), "content_hash", "chunk_id", F.coalesce("parent_id", F.lit("")).alias("parent_id"))


QUERIES = {
    "rag_filtered_search": (filtered_search, FILTERED_SQL),
    "rag_duplicate_ratio": (duplicate_ratio, DUPLICATE_SQL),
    "rag_signals": (signals, None),
    "rag_chunks": (chunks, None),
    "rag_dense_rank": (dense_rank, f"WITH {_BASE}, {_DENSE} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM dlist"),
    "rag_bm25_rank": (bm25_rank, f"WITH {_BASE}, {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM llist"),
    "rag_hybrid_search": (hybrid_search, f"{_ALL} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM fused"),
    "rag_corpus_statistics": (corpus_statistics, STATS_SQL),
    "rag_rerank": (rerank, RERANK_SQL),
    "rag_diverse_selection": (diverse_selection, None),
    "rag_metrics": (retrieval_metrics, METRICS_SQL),
    "rag_metric_summary": (metric_summary, SUMMARY_SQL),
    "rag_token_counts": (token_counts, TOKENS_SQL),
    "rag_chunk_packing": (chunk_packing, None),
    "rag_hash_embedding": (hash_embedding, HASH_SQL),
    "rag_coverage": (coverage_pairs, COVERAGE_SQL),
    "rag_active_hits": (active_hits, ACTIVE_SQL),
    "rag_parent_chain": (parent_chain, PARENT_SQL),
}
