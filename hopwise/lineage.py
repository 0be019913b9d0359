"""Cutting lineage through storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.classic.dataframe import DataFrame as Classic


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. One of our own only where that is unset and all runs in this process; a cluster's executors could not read it."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="hopwise-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder. spark.cleaner.referenceTracking.cleanCheckpoints removes it once nothing refers to it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def unsized(df: DataFrame) -> DataFrame:
    """df without an estimate of its size. A join's is the product of both sides' and outlives checkpoints, so in a loop it gets millions of digits."""
    spark = df.sparkSession
    return Classic(spark._jsparkSession.createDataFrame(df._jdf.javaRDD(), df._jdf.schema()), spark)


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """df for several passes: written as Parquet in the shared folder and deleted after them. What is cached is left as it is."""
    if df.storageLevel.useMemory or df.storageLevel.useDisk:
        yield df
        return
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
        yield spark.read.parquet(path)
    finally:
        removed(spark, path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this process has written in the shared one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
