"""Intermediate tables written to the cluster's shared folder: they cut lineage and plan size, and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster sets it; one of our own only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file:///tmp/checkpoints/tiermem"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet and read back; what is staged already stays as it is."""
    if hasattr(df, "_tm_staged"):
        return df
    spark = df.sparkSession
    path = fresh(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tm_staged = path
    return out


def _system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _system(spark, path)
    return fs.exists(where)


def stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """When path was last changed, and its length."""
    fs, where = _system(spark, path)
    status = fs.getFileStatus(where)
    return status.getModificationTime(), status.getLen()


def drop_staged(*frames: DataFrame) -> None:
    """Delete tables that staged() wrote, once nothing reads them any more."""
    for df in frames:
        if hasattr(df, "_tm_staged"):
            fs, where = _system(df.sparkSession, df._tm_staged)
            fs.delete(where, True)
