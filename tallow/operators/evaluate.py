"""Forecast baselines, aggregation of rolling forecasts, and metrics.

Predictions are long rows (model, Ticker, origin, step, y_true, y_pred,
last_price); metrics are aggregations over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallow.functions import scratch
from tallow.functions.windows import series


def multistep_baselines(train: DataFrame, horizon: int) -> DataFrame:
    """(Ticker, model, step, y_pred): last price; drift over the last min(20, n / 4) rows; mean of the last 20."""
    back = Window.partitionBy("Ticker").orderBy(F.desc("Datetime"))
    tail = train.withColumns({"__k": F.row_number().over(back), "__n": F.count("*").over(Window.partitionBy("Ticker"))}).where("__k <= 20")
    span = F.greatest(F.least(F.lit(20), F.floor(F.col("__n") / 4)), F.lit(2))
    stats = tail.groupBy("Ticker").agg(
        F.max(F.when(F.col("__k") == 1, F.col("Close"))).alias("last"),
        F.max(F.when(F.col("__k") == span, F.col("Close"))).alias("first"),
        F.max(span).alias("span"),
        F.avg("Close").alias("mean"),
    )
    steps = stats.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    drift = F.coalesce(F.try_divide(F.col("last") - F.col("first"), F.col("span") - 1), F.lit(0.0))
    each = F.create_map(F.lit("naive"), F.col("last"), F.lit("drift"), F.col("last") + drift * F.col("step"), F.lit("rolling_mean"), F.col("mean"))
    return steps.select("Ticker", "step", F.explode(each).alias("model", "y_pred")).select("Ticker", "model", "step", "y_pred")


def rolling_baselines(holdout: DataFrame, horizon: int) -> DataFrame:
    """(model, Ticker, origin, step, y_true, y_pred, last_price) of the same baselines from every origin with all its targets."""
    h = holdout.withColumn("origin", (F.row_number().over(series()) - 1).cast("long"))
    five, twenty = series().rowsBetween(-4, 0), series().rowsBetween(-19, 0)
    n5 = F.count("*").over(five)
    drift = F.when(n5 > 1, (F.col("Close") - F.first("Close").over(five)) / (n5 - 1)).otherwise(0.0)
    wide = h.select("Ticker", "origin", F.col("Close").alias("last_price"), drift.alias("drift"), F.avg("Close").over(twenty).alias("mean"), F.array(*[F.lead("Close", k).over(series()) for k in range(1, horizon + 1)]).alias("y"))
    wide = wide.where(F.get("y", F.lit(horizon - 1)).isNotNull())
    steps = wide.select("*", F.posexplode("y").alias("pos", "y_true")).withColumn("step", F.col("pos") + 1)
    each = F.create_map(F.lit("naive"), F.col("last_price"), F.lit("drift"), F.col("last_price") + F.col("drift") * F.col("step"), F.lit("rolling_mean"), F.col("mean"))
    long = steps.select("Ticker", "origin", "step", "y_true", "last_price", F.explode(each).alias("model", "y_pred"))
    return long.select("model", "Ticker", "origin", "step", "y_true", "y_pred", "last_price")


def naive_previous(df: DataFrame, y: str = "Close") -> DataFrame:
    """df with y_true and y_pred = the value before, the first its own."""
    return df.withColumns({"y_true": F.col(y), "y_pred": F.coalesce(F.lag(y, 1).over(series()), F.col(y))})


def aggregate_rolling(predictions: DataFrame, method: str = "mean") -> DataFrame:
    """(model, Ticker, target, y_pred, y_std, n): all predictions that hit one row."""
    value = F.avg("y_pred") if method == "mean" else F.percentile("y_pred", F.lit(0.5))
    return predictions.groupBy("model", "Ticker", (F.col("origin") + F.col("step")).alias("target")).agg(value.alias("y_pred"), F.stddev_pop("y_pred").alias("y_std"), F.count("*").alias("n"))


def metrics(predictions: DataFrame, keys: list[str] | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """rmse, mae, r2 and mape per key, over at least two pairs, and more aggregates of them; r2 is null where the truth is constant.

    One aggregation of mergeable moments: the truth's spread comes from its
    variance, which merges means and squares about them, so that r2 loses
    nothing to cancellation and no second pass goes by the mean.
    """
    keys, more = keys or ["model", "step"], more or {}
    err = F.col("y_true") - F.col("y_pred")
    ape = F.when(F.col("y_true") != 0, F.abs(err / F.when(F.col("y_true") != 0, F.col("y_true"))))
    s = predictions.where(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"), F.var_pop("y_true").alias("spread"), F.avg(ape).alias("ape"), *[x.alias(c) for c, x in more.items()]
    )
    r2 = 1 - F.try_divide(F.col("mse"), F.col("spread"))
    return s.where("n >= 2").select(*keys, "n", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"), (100 * F.col("ape")).alias("mape"), *more)


def step_averages(per_step: DataFrame) -> DataFrame:
    """Means of the per-step metrics per model."""
    return per_step.groupBy("model").agg(*[F.avg(c).alias(f"avg_{c}") for c in ("rmse", "mae", "r2")])


def to_returns(predictions: DataFrame) -> DataFrame:
    """The same predictions as log returns on the last price."""
    safe = lambda c: F.greatest(F.col(c), F.lit(1e-8))
    return predictions.withColumns({c: F.ln(safe(c) / safe("last_price")) for c in ("y_true", "y_pred")})


def evaluate_rolling(actual: DataFrame, aggregated: DataFrame, baseline: str = "naive") -> DataFrame:
    """rmse, mae, r2 and mean contributions per model on rows with predictions, and the improvement on the baseline in percent. actual: (Ticker, target, y_true)."""
    joined = aggregated.join(actual, ["Ticker", "target"])
    m = metrics(joined, ["model"], {"contributions": F.avg("n")})
    base = m.where(F.col("model") == baseline).select(F.col("rmse").alias("__b"))
    return m.crossJoin(F.broadcast(base)).select(  # base is one row
        "model", "n", "rmse", "mae", "r2", "contributions", (F.col("rmse") < F.col("__b")).alias("beats_baseline"), (100 * F.try_divide(F.col("__b") - F.col("rmse"), F.col("__b"))).alias("improvement")
    )


def direct_evaluation(predictions: DataFrame) -> DataFrame:
    """rmse, mae and r2 of the first step per model, the rmse of the last price as a forecast of it, and whether the model beats that."""
    naive = F.sqrt(F.avg((F.col("y_true") - F.col("last_price")) ** 2))
    out = metrics(predictions.where("step = 1"), ["model"], {"naive_rmse": naive}).select("model", "n", "rmse", "mae", "r2", "naive_rmse")
    return out.withColumn("beats_naive", F.col("rmse") < F.col("naive_rmse"))


def recursive_scores(forecast: DataFrame, actual: DataFrame) -> DataFrame:
    """rmse, mae and r2 per ticker of forecast (Ticker, step, y_pred) against actual (Ticker, step, y_true), over the steps that both have."""
    both = forecast.join(actual.hint("merge"), ["Ticker", "step"])
    return metrics(both, ["Ticker"]).select("Ticker", "n", "rmse", "mae", "r2")


def trend_assessment(classes: DataFrame, forecasts: DataFrame, scores: DataFrame) -> DataFrame:
    """Per ticker the class and its probabilities, and the change in percent that the model of best r2 expects at its last step.

    classes: (Ticker, trend, probabilities, Close); forecasts: (Ticker, model,
    step, y_pred); scores: (model, r2).
    """
    best = scores.agg(F.max_by("model", F.struct("r2", "model")).alias("best_model"))  # one row
    last = forecasts.groupBy("Ticker", "model").agg(F.max_by("y_pred", "step").alias("expected"))
    chosen = last.crossJoin(F.broadcast(best)).where("model = best_model").select("Ticker", "best_model", "expected")
    change = 100 * F.try_divide(F.col("expected") - F.col("Close"), F.col("Close"))
    return classes.join(chosen.hint("merge"), "Ticker", "left").select("Ticker", "trend", "probabilities", "best_model", change.alias("expected_change"))


def prediction_alarms(predictions: DataFrame) -> DataFrame:
    """Per model: negative predictions, those over half off the mean, and whether r2 is too good to be true."""
    judged = metrics(predictions, ["model"]).select("model", (F.col("r2") > 0.999).alias("too_good"))
    mean = predictions.groupBy("model").agg(F.avg("y_true").alias("__m"))
    mean = scratch.table(mean.join(judged, "model", "left"), "means")  # a row per model, of known size, so that predictions need no shuffle to meet it
    off = F.abs(F.col("y_pred") - F.col("__m")) > 0.5 * F.abs(F.col("__m"))
    return predictions.join(mean, "model").groupBy("model").agg(F.sum((F.col("y_pred") < 0).cast("long")).alias("negative"), F.sum(off.cast("long")).alias("far_off"), F.first("too_good").alias("too_good"))


def confusion(labels: DataFrame) -> DataFrame:
    """(y_true, y_pred, n)."""
    return labels.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


def classifier_metrics(labels: DataFrame) -> DataFrame:
    """One row: accuracy and F1 weighted by class size; a class never predicted has F1 0."""
    c = confusion(labels)
    right = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
    true = c.groupBy(F.col("y_true").alias("c")).agg(F.sum("n").alias("t"), right.alias("tp"))
    pred = c.groupBy(F.col("y_pred").alias("c")).agg(F.sum("n").alias("p"))
    f1 = F.coalesce(2 * F.col("tp") / (F.col("t") + F.coalesce("p", F.lit(0))), F.lit(0.0))
    each = true.join(pred, "c", "left")
    return each.agg((F.sum("tp") / F.sum("t")).alias("accuracy"), (F.sum(f1 * F.col("t")) / F.sum("t")).alias("f1_weighted"))


def horizon_segments(per_step: DataFrame, horizon: int) -> DataFrame:
    """Mean rmse of the first, middle and last third of the steps."""
    third = max(1, horizon // 3)
    seg = F.when(F.col("step") <= third, "short").when(F.col("step") <= 2 * third, "medium").otherwise("long")
    return per_step.groupBy("model", seg.alias("segment")).agg(F.avg("rmse").alias("rmse"))


def directional_accuracy(predictions: DataFrame) -> DataFrame:
    """Share of equal signs of the changes of truth and prediction, along the flattened (Ticker, origin, step) sequence of each model and ticker."""
    w = Window.partitionBy("model", "Ticker").orderBy("origin", "step")
    d = lambda c: F.signum(F.col(c) - F.lag(c, 1).over(w))
    pairs = predictions.select("model", d("y_true").alias("a"), d("y_pred").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return pairs.groupBy("model").agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("directional_accuracy"))


def error_distribution(predictions: DataFrame, width: float) -> DataFrame:
    """(model, bin, n): residuals in bins of the width given."""
    return predictions.groupBy("model", F.floor((F.col("y_true") - F.col("y_pred")) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def residual_statistics(predictions: DataFrame) -> DataFrame:
    r = F.col("y_true") - F.col("y_pred")
    return predictions.groupBy("model").agg(F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"), F.count("*").alias("n"))


def ranking(predictions: DataFrame) -> DataFrame:
    """Models by r2 over all steps in return space, with their place."""
    m = metrics(to_returns(predictions), ["model"])
    return m.select("model", "r2", F.row_number().over(Window.orderBy(F.desc("r2"), "model")).alias("place"))  # a row per model


def step_matrix(per_step: DataFrame, horizon: int) -> DataFrame:
    """r2 of every model (rows) and step (columns)."""
    return per_step.groupBy("model").pivot("step", list(range(1, horizon + 1))).agg(F.first("r2"))


def uncertainty(aggregated: DataFrame) -> DataFrame:
    return aggregated.groupBy("model").agg(F.avg("y_std").alias("mean_std"))


def run_summary(df: DataFrame) -> DataFrame:
    """Statistics of the closes per ticker."""
    return df.groupBy("Ticker").agg(F.count("*").alias("n"), F.avg("Close").alias("mean"), F.stddev_samp("Close").alias("std"), F.min("Close").alias("low"), F.max("Close").alias("high"))
