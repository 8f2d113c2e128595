"""Baselines, rolling forecasts and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.functions.windows import series
from tallow.operators import evaluate as E
from tallow.operators import split as S
from tallow.operators import targets as Y
from tallow.plans import feature_queries
from tallow.plans.oracle import EVENT_CANDLES as EC
from tallow.sources import candles as C

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
OVER = "(PARTITION BY Ticker ORDER BY Datetime)"
H = 3


def query(name: str, sql: str | None, digits: int = 6):
    def put(f):
        feature_queries.query(name, sql, digits)(f)
        QUERIES[name] = feature_queries.QUERIES.pop(name)
        if sql is not None:
            ORACLES[name] = feature_queries.ORACLES.pop(name)
        return f

    return put


def _split(spark, sf_dir) -> DataFrame:
    return S.holdout_split(C.event_candles(spark, sf_dir), 40, H)


def _predictions(spark, sf_dir) -> DataFrame:
    return E.rolling_baselines(_split(spark, sf_dir).where("split = 'holdout'"), H)


_SPLIT = f"SELECT *, CASE WHEN idx >= s THEN 'holdout' WHEN idx < greatest(s - {H}, least(50, s)) THEN 'train' ELSE 'gap' END AS split FROM (SELECT *, row_number() OVER {OVER} - 1 AS idx, count(*) OVER (PARTITION BY Ticker) - 40 AS s FROM ({EC}))"
_PRED = f"""WITH h AS (SELECT Ticker, row_number() OVER {OVER} - 1 AS origin, Close AS last_price, avg(Close) OVER (PARTITION BY Ticker ORDER BY Datetime ROWS 19 PRECEDING) AS m,
  count(*) OVER (PARTITION BY Ticker ORDER BY Datetime ROWS 4 PRECEDING) AS k, first_value(Close) OVER (PARTITION BY Ticker ORDER BY Datetime ROWS 4 PRECEDING) AS f, {', '.join(f'lead(Close, {k}) OVER {OVER} AS y{k}' for k in (1, 2, 3))} FROM ({_SPLIT}) WHERE split = 'holdout'),
s AS ({' UNION ALL '.join(f'SELECT Ticker, origin, {k} AS step, y{k} AS y_true, last_price, m, CASE WHEN k > 1 THEN (last_price - f) / (k - 1) ELSE 0 END AS d FROM h WHERE y3 IS NOT NULL' for k in (1, 2, 3))}),
p AS (SELECT 'naive' AS model, Ticker, origin, step, y_true, last_price AS y_pred, last_price FROM s UNION ALL SELECT 'drift', Ticker, origin, step, y_true, last_price + d * step, last_price FROM s UNION ALL SELECT 'rolling_mean', Ticker, origin, step, y_true, m, last_price FROM s)"""
_M = "R(sqrt(avg((y_true - y_pred) ** 2))) AS rmse, R(avg(abs(y_true - y_pred))) AS mae, R(1 - sum((y_true - y_pred) ** 2) / nullif(sum((y_true - m0) ** 2), 0)) AS r2, R(100 * avg(abs((y_true - y_pred) / nullif(y_true, 0)))) AS mape"


def _metric(keys: str, source: str = "p", extra: str = "", raw: bool = False) -> str:
    columns = _M.replace("R(", "(") if raw else _M
    return f"{_PRED}{extra} SELECT {keys}, count(*) AS n, {columns} FROM (SELECT *, avg(y_true) OVER (PARTITION BY {keys}) AS m0 FROM {source}) GROUP BY {keys}"


@query("multistep_baselines", f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY Ticker ORDER BY Datetime DESC) AS k, count(*) OVER (PARTITION BY Ticker) AS n FROM ({_SPLIT}) WHERE split = 'train'),
a AS (SELECT Ticker, max(CASE WHEN k = 1 THEN Close END) AS l, max(CASE WHEN k = greatest(least(20, floor(n / 4)), 2) THEN Close END) AS f, max(greatest(least(20, floor(n / 4)), 2)) AS z, avg(Close) AS m FROM t WHERE k <= 20 GROUP BY 1), s AS (SELECT *, unnest([1, 2, 3]) AS step FROM a)
SELECT Ticker, 'naive' AS model, step, R(l) AS y_pred FROM s UNION ALL SELECT Ticker, 'drift', step, R(l + (l - f) / (z - 1) * step) FROM s UNION ALL SELECT Ticker, 'rolling_mean', step, R(m) FROM s""")
def multistep_baselines(spark, sf_dir):
    return E.multistep_baselines(_split(spark, sf_dir).where("split = 'train'"), H)


@query("rolling_baselines", f"{_PRED} SELECT model, Ticker, origin, step, R(y_true) AS y_true, R(y_pred) AS y_pred, R(last_price) AS last_price FROM p")
def rolling_baselines(spark, sf_dir):
    return _predictions(spark, sf_dir)


@query("naive_previous", f"SELECT Ticker, Datetime, R(Close) AS y_true, R(coalesce(lag(Close, 1) OVER {OVER}, Close)) AS y_pred FROM ({EC})")
def naive_previous(spark, sf_dir):
    return E.naive_previous(C.event_candles(spark, sf_dir)).select("Ticker", "Datetime", "y_true", "y_pred")


@query("metrics_per_step", _metric("model, step"))
def metrics_per_step(spark, sf_dir):
    return E.metrics(_predictions(spark, sf_dir))


@query("metrics_overall", _metric("model"))
def metrics_overall(spark, sf_dir):
    return E.metrics(_predictions(spark, sf_dir), ["model"])


_RET = ", r AS (SELECT model, Ticker, origin, step, ln(greatest(y_true, 1e-8) / greatest(last_price, 1e-8)) AS y_true, ln(greatest(y_pred, 1e-8) / greatest(last_price, 1e-8)) AS y_pred FROM p)"


@query("metrics_in_returns", _metric("model, step", "r", _RET))
def metrics_in_returns(spark, sf_dir):
    return E.metrics(E.to_returns(_predictions(spark, sf_dir)))


@query("step_averages", f"SELECT model, R(avg(rmse)) AS avg_rmse, R(avg(mae)) AS avg_mae, R(avg(r2)) AS avg_r2 FROM ({_metric('model, step', raw=True)}) GROUP BY 1")
def step_averages(spark, sf_dir):
    return E.step_averages(E.metrics(_predictions(spark, sf_dir)))


for _how, _sql in {"mean": "avg(y_pred)", "median": "quantile_cont(y_pred, 0.5)"}.items():

    def _agg(spark, sf_dir, how=_how):
        return E.aggregate_rolling(_predictions(spark, sf_dir), how)

    query(f"aggregate_rolling_{_how}", f"{_PRED} SELECT model, Ticker, origin + step AS target, R({_sql}) AS y_pred, R(stddev_pop(y_pred)) AS y_std, count(*) AS n FROM p GROUP BY 1, 2, 3")(_agg)

_AGG = f"{_PRED}, g AS (SELECT model, Ticker, origin + step AS target, avg(y_pred) AS y_pred, stddev_pop(y_pred) AS y_std, count(*) AS c FROM p GROUP BY 1, 2, 3), a AS (SELECT Ticker, row_number() OVER {OVER} - 1 AS target, Close AS y_true FROM ({_SPLIT}) WHERE split = 'holdout')"


@query("evaluate_rolling", f"""{_AGG}, j AS (SELECT *, avg(y_true) OVER (PARTITION BY model) AS m0 FROM g JOIN a USING (Ticker, target)), m AS (SELECT model, count(*) AS n, sqrt(avg((y_true - y_pred) ** 2)) AS rmse, avg(abs(y_true - y_pred)) AS mae, 1 - sum((y_true - y_pred) ** 2) / nullif(sum((y_true - m0) ** 2), 0) AS r2, avg(c) AS contributions FROM j GROUP BY 1)
SELECT model, n, R(rmse) AS rmse, R(mae) AS mae, R(r2) AS r2, R(contributions) AS contributions, rmse < (SELECT rmse FROM m WHERE model = 'naive') AS beats_baseline, R(100 * ((SELECT rmse FROM m WHERE model = 'naive') - rmse) / (SELECT rmse FROM m WHERE model = 'naive')) AS improvement FROM m""")
def evaluate_rolling(spark, sf_dir):
    h = _split(spark, sf_dir).where("split = 'holdout'")
    actual = h.select("Ticker", (F.row_number().over(series()) - 1).cast("long").alias("target"), F.col("Close").alias("y_true"))
    return E.evaluate_rolling(actual, E.aggregate_rolling(E.rolling_baselines(h, H)))


@query("uncertainty", f"{_AGG} SELECT model, R(avg(y_std)) AS mean_std FROM g GROUP BY 1")
def uncertainty(spark, sf_dir):
    return E.uncertainty(E.aggregate_rolling(_predictions(spark, sf_dir)))


@query("prediction_alarms", f"{_PRED} SELECT model, CAST(count(*) FILTER (y_pred < 0) AS BIGINT) AS negative, CAST(count(*) FILTER (abs(y_pred - m0) > 0.5 * abs(m0)) AS BIGINT) AS far_off, 1 - sum((y_true - y_pred) ** 2) / sum((y_true - m0) ** 2) > 0.999 AS too_good FROM (SELECT *, avg(y_true) OVER (PARTITION BY model) AS m0 FROM p) GROUP BY 1")
def prediction_alarms(spark, sf_dir):
    return E.prediction_alarms(_predictions(spark, sf_dir))


_LAB = f"{_PRED}, l AS (SELECT CASE WHEN y_true > last_price * 1.03 THEN 2 WHEN y_true < last_price * 0.97 THEN 0 ELSE 1 END AS y_true, CASE WHEN y_pred > last_price * 1.03 THEN 2 WHEN y_pred < last_price * 0.97 THEN 0 ELSE 1 END AS y_pred FROM p WHERE model <> 'naive')"


def _labels(spark, sf_dir) -> DataFrame:
    lab = lambda c: F.when(F.col(c) > F.col("last_price") * 1.03, 2).when(F.col(c) < F.col("last_price") * 0.97, 0).otherwise(1).alias(c)
    return _predictions(spark, sf_dir).where("model != 'naive'").select(lab("y_true"), lab("y_pred"))


@query("confusion", f"{_LAB} SELECT y_true, y_pred, count(*) AS n FROM l GROUP BY 1, 2")
def confusion(spark, sf_dir):
    return E.confusion(_labels(spark, sf_dir))


@query("classifier_metrics", f"""{_LAB}, t AS (SELECT y_true AS c, count(*) AS t, count(*) FILTER (y_true = y_pred) AS tp FROM l GROUP BY 1), q AS (SELECT y_pred AS c, count(*) AS p FROM l GROUP BY 1)
SELECT R(sum(tp) / sum(t)) AS accuracy, R(sum(2 * tp / (t + coalesce(p, 0)) * t) / sum(t)) AS f1_weighted FROM t LEFT JOIN q USING (c)""")
def classifier_metrics(spark, sf_dir):
    return E.classifier_metrics(_labels(spark, sf_dir))


@query("horizon_segments", f"SELECT model, CASE step WHEN 1 THEN 'short' WHEN 2 THEN 'medium' ELSE 'long' END AS segment, R(avg(rmse)) AS rmse FROM ({_metric('model, step', raw=True)}) GROUP BY 1, 2")
def horizon_segments(spark, sf_dir):
    return E.horizon_segments(E.metrics(_predictions(spark, sf_dir)), H)


@query("directional_accuracy", f"{_PRED} SELECT model, R(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END)) AS directional_accuracy FROM (SELECT model, sign(y_true - lag(y_true) OVER w) AS a, sign(y_pred - lag(y_pred) OVER w) AS b FROM p WINDOW w AS (PARTITION BY model, Ticker ORDER BY origin, step)) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1")
def directional_accuracy(spark, sf_dir):
    return E.directional_accuracy(_predictions(spark, sf_dir))


@query("error_distribution", f"{_PRED} SELECT model, CAST(floor((y_true - y_pred) / 10.0) AS BIGINT) AS bin, count(*) AS n FROM p GROUP BY 1, 2")
def error_distribution(spark, sf_dir):
    return E.error_distribution(_predictions(spark, sf_dir), 10.0)


@query("residual_statistics", f"{_PRED} SELECT model, R(avg(y_true - y_pred)) AS mean, R(stddev_pop(y_true - y_pred)) AS std, count(*) AS n FROM p GROUP BY 1")
def residual_statistics(spark, sf_dir):
    return E.residual_statistics(_predictions(spark, sf_dir))


@query("model_ranking", f"SELECT model, r2, CAST(row_number() OVER (ORDER BY r2 DESC, model) AS INT) AS place FROM ({_metric('model', 'r', _RET)})")
def model_ranking(spark, sf_dir):
    return E.ranking(_predictions(spark, sf_dir))


@query("step_matrix", f"SELECT model, max(CASE WHEN step = 1 THEN r2 END) AS s1, max(CASE WHEN step = 2 THEN r2 END) AS s2, max(CASE WHEN step = 3 THEN r2 END) AS s3 FROM ({_metric('model, step')}) GROUP BY 1")
def step_matrix(spark, sf_dir):
    return E.step_matrix(E.metrics(_predictions(spark, sf_dir)), H).toDF("model", "s1", "s2", "s3")


@query("run_summary", f"SELECT Ticker, count(*) AS n, R(avg(Close)) AS mean, R(stddev_samp(Close)) AS std, R(min(Close)) AS low, R(max(Close)) AS high FROM ({EC}) GROUP BY 1")
def run_summary(spark, sf_dir):
    return E.run_summary(C.event_candles(spark, sf_dir))


@query("holdout_returns", f"SELECT * FROM (SELECT Ticker, Datetime, R(ln(greatest(Close, 1e-8) / greatest(lag(Close, 1) OVER {OVER}, 1e-8))) AS r, lag(Close, 1) OVER {OVER} AS p FROM ({_SPLIT}) WHERE split = 'holdout') WHERE p IS NOT NULL")
def holdout_returns(spark, sf_dir):
    h = _split(spark, sf_dir).where("split = 'holdout'").withColumn("p", F.lag("Close", 1).over(series())).where("p IS NOT NULL")
    return h.select("Ticker", "Datetime", F.ln(F.greatest("Close", F.lit(1e-8)) / F.greatest("p", F.lit(1e-8))).alias("r"), "p")
