"""Splits, samples and outliers; a series is the rows of one Ticker by Datetime."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallow.functions.quantiles import quantiles
from tallow.functions.windows import series, whole
from tallow.operators.features import scale_free_indicators


def row_index(df: DataFrame) -> DataFrame:
    """df with idx from 0 and n, the length of the series."""
    return df.withColumns({"idx": (F.row_number().over(series()) - 1).cast("long"), "n": F.count("*").over(whole())})


def holdout_split(df: DataFrame, holdout: int, horizon: int, least_train: int = 50) -> DataFrame:
    """df with split: the last rows are holdout (at least horizon + 10), train ends horizon rows earlier but keeps least_train; between lies a gap."""
    size = max(holdout, horizon + 10)
    out = row_index(df)
    start = F.col("n") - size
    end = F.greatest(start - horizon, F.least(F.lit(least_train), start))
    split = F.when(F.col("idx") >= start, "holdout").when(F.col("idx") < end, "train").otherwise("gap")
    return out.withColumn("split", split).drop("n")


def time_split(df: DataFrame, test_share: float) -> DataFrame:
    """df with split: the first int(n (1 - test_share)) rows train, the rest test."""
    out = row_index(df)
    return out.withColumn("split", F.when(F.col("idx") < F.floor(F.col("n") * (1 - test_share)), "train").otherwise("test")).drop("n")


def horizon_score(y: Column, how: str) -> Column:
    """One number of a target array: max_abs, mean, max or min."""
    return {
        "max_abs": lambda: F.array_max(F.transform(y, F.abs)),
        "mean": lambda: F.aggregate(y, F.lit(0.0), lambda s, v: s + v) / F.size(y),
        "max": lambda: F.array_max(y),
        "min": lambda: F.array_min(y),
    }[how]()


def outlier_filter(train: DataFrame, percentile: float, how: str = "max_abs", y: str = "y") -> DataFrame:
    """Training rows whose score lies within the percentile: the upper tail goes for max_abs and max, the lower for min, both for mean."""
    score = horizon_score(F.col(y), how)
    low, high = quantiles(train, {"s": (score, [1 - percentile, percentile])})["s"]
    keep = {"max_abs": score <= F.lit(high), "max": score <= F.lit(high), "min": score >= F.lit(low)}
    return train.where(keep.get(how, (score >= F.lit(low)) & (score <= F.lit(high))))


def sample_rows(df: DataFrame, count: int, seed: int = 42, history: int = 30) -> DataFrame:
    """count rows per ticker of least hash, each with the closes of its last history rows."""
    hist = F.collect_list("Close").over(series().rowsBetween(-(history - 1), 0))
    order = Window.partitionBy("Ticker").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "Ticker", F.col("Datetime").cast("string"))))
    return df.withColumn("history", hist).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= count).drop("__r")


def postprocess(forecast: Column, last: Column, max_change: float = 0.1) -> Column:
    """Each value at most max_change from the one before and at least half of the last price; gaps and infinities carry on."""
    start = F.struct(last.alias("p"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, v: Column) -> Column:
        bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
        near = F.least(F.greatest(v, s["p"] * (1 - max_change)), s["p"] * (1 + max_change))
        p = F.when(bad, s["p"]).otherwise(F.greatest(near, 0.5 * last))
        return F.struct(p.alias("p"), F.concat(s["out"], F.array(p)).alias("out"))

    return F.aggregate(forecast, start, step, lambda s: s["out"])


def preflight(spark, requested: list[str], registry: dict[str, str], rows: int, groups: list[str] = (), limit: int = 100_000_000) -> DataFrame:
    """(level, message) on a job of rows rows: unknown indicators and groups, a cell count beyond limit, indicators in price units.

    registry gives the group of every indicator; a handful of names, so plain
    lists become a small table.
    """
    found = [("ERROR", f"unknown indicator {x}") for x in requested if x not in registry]
    found += [("ERROR", f"unknown group {x}") for x in groups if x not in registry.values()]
    known = [x for x in requested if x in registry]
    cells = rows * (len(known) + sum(g in groups for g in registry.values()))
    if cells > limit:
        found.append(("WARNING", f"{cells} cells"))
    free = scale_free_indicators(known)
    found += [("INFO", f"{x} is in price units") for x in known if x not in free]
    return spark.createDataFrame(found, "level string, message string")
