"""Shared scratch space: tables written once and read back.

Everything cut off from its lineage goes below the folder that the cluster
names in ``spark.checkpoint.dir``; one of our own is set only where that
setting is missing on a single machine (tests, notebooks).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a row group, which a task holds while it writes.
ROW_GROUP = 32 << 20


def root(spark: SparkSession) -> str:
    """The shared folder as a URI, without a closing slash."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to shared storage and read back: no lineage beyond the files, and of known size."""
    spark = df.sparkSession
    path = f"{root(spark)}/tallow/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a table that no step reads any more; a frame made from it can't be run again."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/tallow/" in f}
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
