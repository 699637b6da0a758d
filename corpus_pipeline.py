"""The corpus pipeline: language ID, quality, near-duplicates, mixing, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns documents for the next; run() writes every
stage's result to the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language_id, minhash, mixing, quality, sentencepiece_codec
from tidemark.llm.common import BROADCAST_IDS, Scratch, materialize, small_batches, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Calibrated probability below which a language is not believed.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter, null and empty texts, and those with a prediction below LEAST_SCORE go.

    Trained on the rows it gets that have a lang; without any, nothing has a language. Repeated rows
    are judged alike, a text of any length as a whole; other columns are dropped.
    """
    small_batches(spark)
    model = language_id.train(docs)
    marked = language_id.identify(docs, model)
    return marked.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of predicted quality 1. Trained on the labelled rows it gets, but for the held-out fold; without any, the score is 0.5 and all stay.

    Null and empty texts get the score of no features. Repeated rows are judged alike, a text of any
    length as a whole; other columns are dropped.
    """
    small_batches(spark)
    model = quality.train(quality.labelled(docs, table(spark, sf_dir, "labels")))
    return quality.score(docs, model).filter("predicted = 1").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of similarity 0.8 or more; rows with a null doc_id all stay.

    Null, empty and wordless texts are in no group and stay. Rows alike in doc_id and text are one
    document, of which one row stays. Where a doc_id stands for different texts, each of them is
    judged as a document of its own, ties in a group going to the smaller text.
    """
    small_batches(spark)
    scratch = Scratch()
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.isEmpty():
        judged = minhash.near_duplicates(docs, keep=scratch.keep)
        gone = materialize(judged.filter("not kept").select("doc_id"), "pipeline-gone")
        left = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti")
    else:
        # a number for each doc_id and digest of a text, written once so that it stays
        marked = docs.select(*COLUMNS).withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
        keys = marked.filter("doc_id is not null").select("doc_id", "digest").distinct().withColumn("key", F.monotonically_increasing_id())
        named = scratch.keep(marked.join(scratch.keep(keys, "pipeline-keys"), ["doc_id", "digest"], "left").select(*COLUMNS, "key"), "pipeline-named")
        one = named.filter("key is not null").dropDuplicates(["key"])
        judged = minhash.near_duplicates(one.select(F.col("key").alias("doc_id"), "text"), keep=scratch.keep)
        group = judged.select(F.col("doc_id").alias("key"), "component_id")
        best = one.join(group, "key").groupBy("component_id").agg(F.min_by("key", F.struct("doc_id", F.sha2("text", 256))).alias("key"))
        left = materialize(one.join(best, "key", "left_semi").select(*COLUMNS).unionByName(named.filter("key is null").select(*COLUMNS)), "pipeline-left")
    scratch.drop(spark)  # what is needed of it is in pipeline-gone or pipeline-left
    return left.select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; null and wordless texts have no words to take and go, a null source is a source. Rows alike are taken equally often."""
    plan = mixing.mix(docs).filter("copies > 0").select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("z"), "copies").distinct()
    taken = materialize(plan, "pipeline-copies")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (mixing.words(F.col("text")) == F.col("z"))
    # a plan of few rows goes to the texts, so that these are not shuffled
    joined = docs.select(*COLUMNS).join(F.broadcast(taken) if taken.count() <= BROADCAST_IDS // 4 else taken, same)
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as piece ids: doc_id, lang, source, n_pieces, piece_ids; none for a null or empty text, whole texts of any length."""
    small_batches(spark)
    encoded = sentencepiece_codec.encode(docs, sentencepiece_codec.Vocabulary.load())
    return encoded.select("doc_id", "lang", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids")


STAGES = [
    ("language_id", identify_language),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Learned models and random rounding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
