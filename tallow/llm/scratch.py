"""Shared scratch space of the operators here: tables, and folders of their own for other files."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from tallow.functions.scratch import discard, root, table

__all__ = ["discard", "folder", "release", "root", "table"]


def folder(spark: SparkSession, name: str) -> str:
    """A new path for one set of files; nothing is created yet."""
    return f"{root(spark)}/tallow/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of finished steps: it does so once the driver has collected their garbage."""
    spark.sparkContext._jvm.System.gc()
