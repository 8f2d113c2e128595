"""Forecast targets and trend labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallow.functions.windows import series
FLOOR = 1e-8


def multistep_targets(candles: DataFrame, horizon: int, col: str = "Close") -> DataFrame:
    """candles with y = the next horizon values; rows without all of them go."""
    if horizon < 1:
        raise ValueError("the horizon is at least 1")
    out = candles.withColumns({"y": F.array(*[F.lead(col, k).over(series()) for k in range(1, horizon + 1)]), "__last": F.lead(col, horizon).over(series())})
    return out.where(F.col("__last").isNotNull()).drop("__last")


def labelled_targets(candles: DataFrame, horizon: int, col: str = "Close") -> DataFrame:
    """candles with target_{col}_t+k; the tail is null."""
    return candles.withColumns({f"target_{col}_t+{k}": F.lead(col, k).over(series()) for k in range(1, horizon + 1)})


def _base(context: Column) -> Column:
    return F.when(context == 0, FLOOR).otherwise(context)


def to_target(y: Column, transform: str, context: Column) -> Column:
    """Prices as they are, as relative change or as log return against one last price; the context 0 counts as 1e-8."""
    if transform == "price":
        return y
    if transform == "pct_change":
        return F.transform(y, lambda p: (p - _base(context)) / _base(context))
    if transform == "log_return":
        return F.transform(y, lambda p: F.ln(F.greatest(p, F.lit(FLOOR)) / F.greatest(_base(context), F.lit(FLOOR))))
    raise ValueError(f"unknown target transform {transform!r}")


def from_target(y: Column, transform: str, context: Column) -> Column:
    """The inverse of to_target."""
    if transform == "price":
        return y
    if transform == "pct_change":
        return F.transform(y, lambda r: _base(context) * (1 + r))
    if transform == "log_return":
        return F.transform(y, lambda r: F.greatest(_base(context), F.lit(FLOOR)) * F.exp(r))
    raise ValueError(f"unknown target transform {transform!r}")


def from_target_cumulative(y: Column, transform: str, context: Column) -> Column:
    """Prices from step returns, each on the price before."""
    if transform == "price":
        return y
    grow = {"pct_change": lambda p, r: p * (1 + r), "log_return": lambda p, r: p * F.exp(r)}[transform]
    start = F.struct(_base(context).alias("p"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, r: Column) -> Column:
        p = grow(s["p"], r)
        return F.struct(p.alias("p"), F.concat(s["out"], F.array(p)).alias("out"))

    return F.aggregate(y, start, step, lambda s: s["out"])


def target_transform(config: dict) -> str:
    """Explicit setting, else the older flag, else log returns where the caller says so, else prices."""
    if config.get("target_transform"):
        return config["target_transform"]
    if "use_percentage_returns" in config:
        return "pct_change" if config["use_percentage_returns"] else "price"
    return config.get("default", "price")


def trend_labels(candles: DataFrame, horizon: int, threshold: float = 0.02, name: str = "trend") -> DataFrame:
    """2 up, 1 sideways, 0 down: change over horizon rows strictly beyond the threshold; the tail is 1."""
    change = F.try_divide(F.lead("Close", horizon).over(series()) - F.col("Close"), F.col("Close"))
    label = F.when(change > threshold, 2).when(change < -threshold, 0).otherwise(1)
    return candles.withColumn(name, F.coalesce(label, F.lit(1)))


def ten_day_labels(candles: DataFrame, threshold: float = 0.02) -> DataFrame:
    """As trend_labels over ten rows, the threshold included, the tail left out; with the change."""
    change = F.try_divide(F.lead("Close", 10).over(series()) - F.col("Close"), F.col("Close"))
    out = candles.withColumn("change", change).where(F.col("change").isNotNull())
    return out.withColumn("trend", F.when(F.col("change") >= threshold, 2).when(F.col("change") <= -threshold, 0).otherwise(1))


def launcher_labels(candles: DataFrame, window: int, horizon: int, threshold: float = 0.02) -> DataFrame:
    """candles with target_trend over window rows and, where that is another number, target_trend_h{horizon}."""
    out = trend_labels(candles, window, threshold, "target_trend")
    return out if window == horizon else trend_labels(out, horizon, threshold, f"target_trend_h{horizon}")
