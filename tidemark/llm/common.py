"""What the training-data operators share: tables, materialised steps, held-out folds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the contracts define it: a run of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of ids that may be broadcast (8 bytes each, 16 MB at most); larger sides are shuffled.
BROADCAST_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a folder of its own and any other an error, as its executors could not see one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read again: lineage ends there, and any executor can reread it."""
    return Scratch().keep(df, name)


class Scratch:
    """The tables that one call writes; drop() deletes these and no others, once nothing reads them."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        spark = df.sparkSession
        path = f"{shared_root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def drop(self, spark: SparkSession) -> None:
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(hadoop).delete(at, True)
        self.paths.clear()


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of at most rows rows in this session from now on (fewer, if it says so): with whole texts a batch of the usual size takes tens of megabytes, in the JVM and in each worker.

    A setting of the application: the registered queries and the pipeline call it, operators do not.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def text_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text and lang of documents, dealt over all cores where the files give fewer partitions than there are cores (a small table in one row group); batches of whole texts are kept small."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def fold(column: str, parts: int) -> Column:
    """crc32 of a value's decimal text, modulo parts."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def uniform(column: str, seed: int) -> Column:
    """A repeatable number in [0, 1) for a value."""
    return (F.xxhash64(F.col(column), F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1))).cast("double") / float(1 << 52)


def only_ids(df: DataFrame, ids: DataFrame, key: str, n_ids: int) -> DataFrame:
    """Rows whose key is in ids; ids are broadcast only when few."""
    return df.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, key, "left_semi")
