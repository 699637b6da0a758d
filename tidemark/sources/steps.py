"""Steps written to the folder that driver and executors share, so they are computed once and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local master gets a folder of its own and any other an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table, written once and read again wherever it is used."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Steps:
    """Steps of a loop, each made from the one before under its name."""

    def __init__(self) -> None:
        self.paths: dict[str, str] = {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        spark = df.sparkSession
        path = f"{shared_root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths[name] = path
        return spark.read.schema(df.schema).parquet(path)

    def replaced(self, df: DataFrame, name: str) -> DataFrame:
        """df written; the last step of the same name, which nothing but df reads, is deleted."""
        old = self.paths.get(name)
        out = self.written(df, name)
        if old is not None:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(old)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        return out
