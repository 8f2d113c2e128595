"""Rolling, future and recursive forecasts of fitted models, over all tickers at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallow.functions import scratch
from tallow.functions.windows import series
from tallow.operators.models import LinearForecaster
from tallow.operators.targets import from_target, from_target_cumulative


def roll(holdout: DataFrame, predict: Callable[[DataFrame], DataFrame], model: str, horizon: int, stride: int = 1, transform: str = "log_return") -> DataFrame:
    """(model, Ticker, origin, step, y_true, y_pred, last_price) from every stride-th origin of the holdout whose targets are all there; predict adds y_pred."""
    rows = holdout.withColumns({"origin": (F.row_number().over(series()) - 1).cast("long"), "__truth": F.array(*[F.lead("Close", k).over(series()) for k in range(1, horizon + 1)])})
    rows = rows.where(F.get("__truth", F.lit(horizon - 1)).isNotNull() & (F.pmod("origin", F.lit(stride)) == 0))
    prices = from_target(F.col("y_pred"), transform, F.col("Close"))
    long = predict(rows).select("Ticker", "origin", F.col("Close").alias("last_price"), F.posexplode(F.arrays_zip(F.col("__truth").alias("t"), prices.alias("p"))).alias("pos", "z"))
    return long.select(F.lit(model).alias("model"), "Ticker", "origin", (F.col("pos") + 1).alias("step"), F.col("z.t").alias("y_true"), F.col("z.p").alias("y_pred"), "last_price")


def future(features: DataFrame, predict: Callable[[DataFrame], DataFrame], model: str, transform: str = "log_return") -> DataFrame:
    """(Ticker, model, step, y_pred) from each ticker's last row; a missing prediction is the last price."""
    last = features.withColumn("__r", F.row_number().over(Window.partitionBy("Ticker").orderBy(F.desc("Datetime")))).where("__r = 1")
    out = predict(last).select("Ticker", "Close", F.posexplode(from_target(F.col("y_pred"), transform, F.col("Close"))).alias("pos", "p"))
    return out.select("Ticker", F.lit(model).alias("model"), (F.col("pos") + 1).alias("step"), F.coalesce("p", "Close").alias("y_pred"))


def futures(features: DataFrame, models: dict[str, Callable[[DataFrame], DataFrame]], horizon: int, transform: str = "log_return") -> DataFrame:
    """(Ticker, model, step, y_pred, note) of all models and of naive, each ticker's last price.

    A model that fails has the last price for all steps too, and its error as note.
    """
    last = features.groupBy("Ticker").agg(F.max_by("Close", "Datetime").alias("p"))
    flat = lambda m, note: last.select("Ticker", F.lit(m).alias("model"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), F.col("p").alias("y_pred"), F.lit(note).cast("string").alias("note"))
    out = flat("naive", None)
    for name, predict in models.items():
        try:
            made = scratch.table(future(features, predict, name, transform).withColumn("note", F.lit(None).cast("string")), "future")  # fails here, if at all
        except Exception as e:  # one model's failure is a note, not the end of the run
            made = flat(name, f"{type(e).__name__}: {e}"[:200])
        out = out.union(made)
    return out


def recursive(histories: DataFrame, features: Callable[[Column], dict[str, Column]], model: LinearForecaster, steps: int, transform: str = "log_return") -> DataFrame:
    """histories (Ticker, history: array<double>) with forecast: block after block of the model's horizon, each fed with the prices before.

    A chained price is kept within half and 1.2 times the one before.
    """
    h = len(model.weights)
    out = histories.withColumn("forecast", F.array().cast("array<double>"))
    keep = histories.columns
    for _ in range(-(-steps // h)):
        vec = features(F.concat("history", "forecast"))
        out = out.withColumns({c: vec[c].cast("double") for c in model.features})
        out = out.withColumn("__last", F.element_at(F.concat("history", "forecast"), -1))
        made = from_target_cumulative(model.predict(), transform, F.col("__last")) if transform != "price" else model.predict()
        start = F.struct(F.col("__last").alias("p"), F.array().cast("array<double>").alias("out"))

        def step(s: Column, v: Column) -> Column:
            p = F.when(v.isNull() | F.isnan(v), s["p"]).when(v < 0, 0.5 * s["p"]).when(v > 2 * s["p"], 1.2 * s["p"]).otherwise(v)
            return F.struct(p.alias("p"), F.concat(s["out"], F.array(p)).alias("out"))

        safe = F.aggregate(made, start, step, lambda s: s["out"])
        # A row per ticker, written: each block's expressions would hold all those before it.
        out = scratch.table(out.withColumn("forecast", F.concat("forecast", safe)).select(*keep, "forecast"), "forecast")
    return out.withColumn("forecast", F.slice("forecast", 1, steps))


def recursive_holdout(histories: DataFrame, features: Callable[[Column], dict[str, Column]], model: LinearForecaster, holdout: DataFrame, steps: int, transform: str = "log_return") -> DataFrame:
    """(Ticker, step, y_true, y_pred): prices chained over the holdout's first rows, from what was known before it."""
    made = recursive(histories, features, model, steps, transform).select("Ticker", F.posexplode("forecast").alias("pos", "y_pred"))
    truth = holdout.select("Ticker", F.row_number().over(series()).alias("step"), F.col("Close").alias("y_true")).where(F.col("step") <= steps)
    return made.select("Ticker", (F.col("pos") + 1).alias("step"), "y_pred").join(truth.hint("merge"), ["Ticker", "step"])
