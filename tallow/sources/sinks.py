"""Where features, training sets and results go."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_features(features: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Features, labels included where there are any; one folder per ticker."""
    features.write.mode("overwrite").partitionBy("Ticker").format(fmt).options(header=True).save(path)


def write_training_set(rows: DataFrame, columns: list[str], horizon: int, transform: str, path: str) -> None:
    """columns and target_{transform}_t+k of y as Parquet below data, one row of metadata as JSON below meta."""
    targets = [F.get("y", F.lit(k)).alias(f"target_{transform}_t+{k + 1}") for k in range(horizon)]
    rows.select("Ticker", "Datetime", *columns, *targets).write.mode("overwrite").parquet(f"{path}/data")
    meta = {"features": columns, "horizon": horizon, "transform": transform}
    rows.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def write_results(metrics: DataFrame, path: str, config: dict | None = None) -> None:
    """Metric rows as JSON lines; with a config its snapshot, one JSON line with sorted keys, below config."""
    if config is None:
        metrics.write.mode("overwrite").json(path)
        return
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    text = json.dumps(config, sort_keys=True, default=str)
    metrics.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The metric rows and the config that write_results stored with them."""
    return spark.read.json(f"{path}/metrics"), json.loads(spark.read.text(f"{path}/config").first()[0])
