"""Models and forecasts; the random and iterative ones have no SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallow.functions import scratch
from tallow.functions.dialect import Duck
from tallow.functions.windows import series
from tallow.operators import augment as A
from tallow.operators import evaluate as E
from tallow.operators import features as X
from tallow.operators import forecast as J
from tallow.operators import models as L
from tallow.operators import split as S
from tallow.operators import targets as Y
from tallow.operators.indicators import compute, compute_sql
from tallow.plans import evaluation_queries as EQ
from tallow.plans.evaluation_queries import query
from tallow.plans.oracle import EVENT_CANDLES as EC
from tallow.sources import candles as C
from tallow.sources.sinks import read_results, write_results

QUERIES, ORACLES = {}, {}
_before = set(EQ.QUERIES)
H, FEATURES = 2, ["sma_5_ratio", "rsi_14", "atr_normalized_14"]


def _samples(spark, sf_dir) -> DataFrame:
    out = compute(C.event_candles(spark, sf_dir).where("Close > 0"), FEATURES)
    return S.holdout_split(out, 40, H)


def _train(rows: DataFrame) -> DataFrame:
    t = Y.multistep_targets(rows.where("split = 'train'"), H)
    return t.withColumn("y", Y.to_target(F.col("y"), "log_return", F.col("Close"))).dropna(subset=FEATURES)


@query("linear_one_feature", f"""WITH s AS (SELECT Close AS x, lead(Close, 1) OVER w AS y1, lead(Close, 2) OVER w AS y2 FROM ({EC}) WINDOW w AS (PARTITION BY Ticker ORDER BY Datetime))
SELECT 1 AS step, R(regr_slope(y1, x)) AS slope, R(regr_intercept(y1, x)) AS intercept FROM s WHERE y2 IS NOT NULL UNION ALL SELECT 2, R(regr_slope(y2, x)), R(regr_intercept(y2, x)) FROM s WHERE y2 IS NOT NULL""", digits=5)
def linear_one_feature(spark, sf_dir):
    m = L.LinearForecaster.fit(Y.multistep_targets(C.event_candles(spark, sf_dir), 2), ["Close"], 2)
    return spark.createDataFrame([(k + 1, float(w[0]), float(w[1])) for k, w in enumerate(m.weights)], "step int, slope double, intercept double")


def _rolled(spark, sf_dir, name: str) -> DataFrame:
    rows = _samples(spark, sf_dir)
    train, hold = scratch.table(_train(rows), "train"), rows.where("split = 'holdout'").dropna(subset=FEATURES)
    if name == "linear":
        m = L.LinearForecaster.fit(train, FEATURES, H)
        predict = m.transform
    elif name == "kernel_ridge":
        m, add = L.kernel_ridge(train, FEATURES, H, gamma=0.1)
        predict = lambda df: m.transform(add(df))
    else:
        ms = L.fit_steps(name, train, FEATURES, H)
        predict = lambda df: L.predict_steps(ms, df, FEATURES)
    return J.roll(hold, predict, name, H)


for _name in ("linear", "elastic_net", "boosted_trees", "kernel_ridge"):

    def _run(spark, sf_dir, name=_name):
        return E.metrics(_rolled(spark, sf_dir, name))

    query(f"model_{_name}", None)(_run)


@query("model_classifiers", None)
def model_classifiers(spark, sf_dir):
    rows = Y.trend_labels(_samples(spark, sf_dir), 5, 0.03)
    out, failed = L.train_classifiers(rows.where("split = 'train'"), rows.where("split = 'holdout'"), FEATURES, ["random_forest", "svc", "linear_svc", "perceptron", "no_such_model"])
    return L.classifier_report(spark, out, failed)


@query("classifier_gaps", None)
def classifier_gaps(spark, sf_dir):
    """Rows judged by a classifier, those with gaps in their features included."""
    rows = Y.trend_labels(_samples(spark, sf_dir), 5, 0.03)
    hold = rows.where("split = 'holdout'").withColumn(FEATURES[0], F.when(F.pmod(F.xxhash64("Ticker", "Datetime"), F.lit(3)) > 0, F.col(FEATURES[0])))
    out, _ = L.train_classifiers(rows.where("split = 'train'"), hold, FEATURES, ["random_forest"], params={"random_forest": {"numTrees": 5}})
    return out.groupBy("model").agg(F.count("*").alias("n"))


@query("search_svc", None)
def search_svc(spark, sf_dir):
    rows = Y.trend_labels(_samples(spark, sf_dir), 5, 0.03).where("split = 'train'")
    late = F.percent_rank().over(Window.partitionBy("Ticker").orderBy("Datetime")) > 0.8
    rows = scratch.table(rows.withColumn("late", late), "labelled")
    tried, best = L.search_classifier("svc", rows.where("NOT late"), rows.where("late"), FEATURES, {"C": [0.1, 10.0], "gamma": [0.1, 1.0]})
    return tried.withColumn("best", F.lit(", ".join(f"{k}={v}" for k, v in best.items())))


@query("boosting_rounds", None)
def boosting_rounds(spark, sf_dir):
    """Trees that each step's boosting used before the validation rows stopped it, of at most 60."""
    train = scratch.table(_train(_samples(spark, sf_dir)), "train")
    models = L.fit_steps("boosted_trees", train, FEATURES, H, validation=0.2, maxIter=60, maxDepth=3)
    return spark.createDataFrame([(k + 1, m.getNumTrees) for k, m in enumerate(models)], "step int, rounds int")


@query("results_snapshot", f"SELECT model, n, '{{\"columns\": [\"sma_5_ratio\", \"rsi_14\", \"atr_normalized_14\"], \"horizon\": 2}}' AS config FROM (VALUES ('drift'), ('naive'), ('rolling_mean')) v(model), (SELECT sum(greatest(least(c, 40) - 3, 0))::BIGINT AS n FROM (SELECT count(*) AS c FROM ({EC}) GROUP BY Ticker))")
def results_snapshot(spark, sf_dir):
    """Metrics and the configuration that they were made with, written and read back."""
    path = f"{scratch.root(spark)}/tallow/results-{uuid.uuid4().hex}"
    hold = S.holdout_split(C.event_candles(spark, sf_dir), 40, 3).where("split = 'holdout'")
    write_results(E.metrics(E.rolling_baselines(hold, 3), ["model"]), path, {"horizon": H, "columns": FEATURES})
    metrics, config = read_results(spark, path)
    n = F.col("n") / 3  # steps
    return metrics.select("model", n.cast("long").alias("n"), F.lit(json.dumps(config, sort_keys=True)).alias("config"))


@query("pca_features", None)
def pca_features(spark, sf_dir):
    out, _ = L.pca_features(_samples(spark, sf_dir).select("Ticker", "Datetime", *FEATURES), FEATURES, 0.95)
    return out


@query("future_forecast", None)
def future_forecast(spark, sf_dir):
    rows = _samples(spark, sf_dir)
    broken = lambda df: df.withColumn("y_pred", F.col("no_such_column"))
    return J.futures(rows, {"linear": L.LinearForecaster.fit(_train(rows), FEATURES, H).transform, "broken": broken}, H)


@query("recursive_forecast", None)
def recursive_forecast(spark, sf_dir):
    names = ["return_1", "ma_ratio", "momentum_10"]
    c = C.event_candles(spark, sf_dir).where("Close > 0")
    h = c.withColumn("history", F.collect_list("Close").over(series().rowsBetween(-29, 0))).where(F.size("history") == 30)
    vec = lambda a: X.price_vector(a, [1], [5, 20])
    rows = Y.multistep_targets(h.withColumns({n: vec(F.col("history"))[n].cast("double") for n in names}), H)
    m = L.LinearForecaster.fit(rows.withColumn("y", Y.to_target(F.col("y"), "log_return", F.col("Close"))), names, H, ridge=1e-6)
    last = h.groupBy("Ticker").agg(F.max_by("history", "Datetime").alias("history"))
    return J.recursive(last, vec, m, 6).select("Ticker", F.posexplode("forecast").alias("pos", "y_pred"))


# Saving, judging, choosing -----------------------------------------------------


@query("model_reload", f"""WITH s AS (SELECT Close AS x, lead(Close, 1) OVER w AS y1, lead(Close, 2) OVER w AS y2 FROM ({EC}) WINDOW w AS (PARTITION BY Ticker ORDER BY Datetime))
SELECT 1 AS step, R(regr_slope(y1, x)) AS slope, R(regr_intercept(y1, x)) AS intercept FROM s WHERE y2 IS NOT NULL UNION ALL SELECT 2, R(regr_slope(y2, x)), R(regr_intercept(y2, x)) FROM s WHERE y2 IS NOT NULL""", digits=5)
def model_reload(spark, sf_dir):
    path = f"{scratch.root(spark)}/tallow/model-{uuid.uuid4().hex}"
    L.LinearForecaster.fit(Y.multistep_targets(C.event_candles(spark, sf_dir), 2), ["Close"], 2).save(spark, path)
    m = L.LinearForecaster.load(spark, path)
    return spark.createDataFrame([(k + 1, float(w[0]), float(w[1])) for k, w in enumerate(m.weights)], "step int, slope double, intercept double")


_ONE = ["sma_5_ratio"]
_DIRECT = f"""WITH f AS (SELECT i.Ticker, i.Datetime, i.sma_5_ratio AS x, c.Close FROM ({compute_sql(f"SELECT * FROM ({EC}) WHERE Close > 0", _ONE, Duck())}) i JOIN ({EC}) c USING (Ticker, Datetime)),
n AS (SELECT *, row_number() OVER o - 1 AS idx, count(*) OVER (PARTITION BY Ticker) - 40 AS s, lead(Close, 1) OVER o AS y1 FROM f WINDOW o AS (PARTITION BY Ticker ORDER BY Datetime)),
p AS (SELECT *, CASE WHEN idx >= s THEN 'holdout' WHEN idx < greatest(s - 1, least(50, s)) THEN 'train' ELSE 'gap' END AS split FROM n),
t AS (SELECT x, ln(nxt / Close) AS r FROM (SELECT *, lead(Close, 1) OVER (PARTITION BY Ticker ORDER BY Datetime) AS nxt FROM p WHERE split = 'train') WHERE nxt IS NOT NULL AND x IS NOT NULL),
m AS (SELECT regr_slope(r, x) AS a, regr_intercept(r, x) AS b FROM t),
h AS (SELECT Close AS last_price, nxt AS y_true, Close * exp(a * x + b) AS y_pred FROM (SELECT *, lead(Close, 1) OVER (PARTITION BY Ticker ORDER BY Datetime) AS nxt FROM p WHERE split = 'holdout' AND x IS NOT NULL), m WHERE nxt IS NOT NULL),
g AS (SELECT *, avg(y_true) OVER () AS m0 FROM h)
SELECT 'linear' AS model, count(*) AS n, R(sqrt(avg((y_true - y_pred) ** 2))) AS rmse, R(avg(abs(y_true - y_pred))) AS mae, R(1 - sum((y_true - y_pred) ** 2) / sum((y_true - m0) ** 2)) AS r2, R(sqrt(avg((y_true - last_price) ** 2))) AS naive_rmse,
  sqrt(avg((y_true - y_pred) ** 2)) < sqrt(avg((y_true - last_price) ** 2)) AS beats_naive FROM g"""


@query("direct_evaluation", _DIRECT, digits=5)
def direct_evaluation(spark, sf_dir):
    rows = S.holdout_split(compute(C.event_candles(spark, sf_dir).where("Close > 0"), _ONE), 40, 1)
    train = Y.multistep_targets(rows.where("split = 'train'"), 1)
    m = L.LinearForecaster.fit(train.withColumn("y", Y.to_target(F.col("y"), "log_return", F.col("Close"))).dropna(subset=_ONE), _ONE, 1)
    return E.direct_evaluation(J.roll(rows.where("split = 'holdout'").dropna(subset=_ONE), m.transform, "linear", 1))


@query("step_scaling", f"""WITH s AS (SELECT Ticker, Datetime, lead(Close, 1) OVER w AS y1, lead(Close, 2) OVER w AS y2 FROM ({EC}) WINDOW w AS (PARTITION BY Ticker ORDER BY Datetime)), k AS (SELECT * FROM s WHERE y2 IS NOT NULL),
p AS (SELECT avg(y1) AS m1, avg(y2) AS m2, stddev_pop(y1) AS s1, stddev_pop(y2) AS s2 FROM k) SELECT Ticker, Datetime, R((y1 - m1) / s1) AS y1, R((y2 - m2) / s2) AS y2, R(y2) AS back FROM k, p""")
def step_scaling(spark, sf_dir):
    rows = Y.multistep_targets(C.event_candles(spark, sf_dir), 2)
    p = X.fit_step_scaler(rows, 2)
    scaled = X.apply_step_scaler(rows, p)
    back = X.apply_step_scaler(scaled.withColumn("z", F.col("y")), p, inverse=True, name="z")
    return back.select("Ticker", "Datetime", F.get("y", F.lit(0)).alias("y1"), F.get("y", F.lit(1)).alias("y2"), F.get("z", F.lit(1)).alias("back"))


@query("transform_new", f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY Ticker ORDER BY Datetime DESC) AS k, lag(Close, 2) OVER w AS l, avg(Close) OVER (PARTITION BY Ticker ORDER BY Datetime ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS m FROM ({EC}) WINDOW w AS (PARTITION BY Ticker ORDER BY Datetime)),
p AS (SELECT avg(l) AS ml, stddev_pop(l) AS sl, avg(m) AS mm, stddev_pop(m) AS sm FROM c WHERE k > 7) SELECT Ticker, Datetime, R((l - ml) / sl) AS Close_lag_2, R((m - mm) / sm) AS Close_rolling_5_mean FROM c, p WHERE k <= 7""")
def transform_new(spark, sf_dir):
    c = C.event_candles(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("Ticker").orderBy(F.desc("Datetime"))))
    old, new = c.where("k > 7"), c.where("k <= 7")
    stored = X.FeaturePipeline(["Close"], [2], [5], ["mean"]).fit(old).to_json()
    return X.FeaturePipeline.from_json(stored).transform_new(new, old).select("Ticker", "Datetime", "Close_lag_2", "Close_rolling_5_mean")


@query("processor_metadata", None)
def processor_metadata(spark, sf_dir):
    train = _train(_samples(spark, sf_dir))
    both = [L.FeatureProcessor(FEATURES, mode).fit(train) for mode in ("raw", "raw+pca")]
    return both[0].metadata(spark).union(both[1].metadata(spark))


@query("model_importances", None)
def model_importances(spark, sf_dir):
    train = scratch.table(_train(_samples(spark, sf_dir)), "train")
    return L.importances(spark, L.fit_steps("boosted_trees", train, FEATURES, H, maxIter=5), FEATURES)


@query("search_kernel_ridge", None)
def search_kernel_ridge(spark, sf_dir):
    train = scratch.table(_train(_samples(spark, sf_dir)), "train")
    _, _, best = L.search_kernel_ridge(train, FEATURES, H, {"alpha": [0.1, 1.0], "gamma": [0.1, 1.0]})
    return spark.createDataFrame([(best["alpha"], best["gamma"])], "alpha double, gamma double")


@query("search_forest", None)
def search_forest(spark, sf_dir):
    rows = Y.trend_labels(_samples(spark, sf_dir), 5, 0.03).where("split = 'train'")
    _, best = L.search_forest(rows, FEATURES, {"maxDepth": [3, 5, 7], "minInstancesPerNode": [1, 5]}, 2)
    return spark.createDataFrame([(best["maxDepth"], best["minInstancesPerNode"])], "max_depth int, least_rows int")


@query("augment_comparison", None)
def augment_comparison(spark, sf_dir):
    rows = scratch.table(S.row_index(_samples(spark, sf_dir)), "samples")
    train = scratch.table(_train(rows).select("Ticker", "idx", *FEATURES, "y"), "train")
    hold = rows.where("split = 'holdout'").dropna(subset=FEATURES)

    def score(some: DataFrame) -> DataFrame:
        m = L.LinearForecaster.fit(some, FEATURES, H)
        return E.metrics(J.roll(hold, m.transform, "linear", H)).agg(*[F.avg(c).alias(c) for c in ("rmse", "mae", "r2")])

    return A.compare(train, FEATURES, score, ["jitter", "scale", "mixup", "magnitude_warp", "trend_inject"])


@query("augment_methods", "SELECT method, description FROM (VALUES ('jitter', 'normal noise in proportion to each feature''s deviation'), ('smote', 'new rows between near ones of one target range')) v(method, description), (SELECT count(*) AS n FROM events) WHERE n > 0")
def augment_methods(spark, sf_dir):
    some = spark.read.parquet(f"{sf_dir}/events.parquet").limit(1).count() > 0
    return A.methods(spark).where(F.col("method").isin("jitter", "smote") & F.lit(some))


def _histories(spark, sf_dir, names: list[str], vec) -> tuple[DataFrame, DataFrame, L.LinearForecaster]:
    c = S.holdout_split(C.event_candles(spark, sf_dir).where("Close > 0"), 40, H)
    early = c.where("split != 'holdout'")
    h = early.withColumn("history", F.collect_list("Close").over(series().rowsBetween(-29, 0))).where(F.size("history") == 30)
    rows = Y.multistep_targets(h.withColumns({n: vec(F.col("history"))[n].cast("double") for n in names}), H)
    m = L.LinearForecaster.fit(rows.withColumn("y", Y.to_target(F.col("y"), "log_return", F.col("Close"))), names, H, ridge=1e-6)
    return h.groupBy("Ticker").agg(F.max_by("history", "Datetime").alias("history")), c.where("split = 'holdout'"), m


@query("recursive_holdout", None)
def recursive_holdout(spark, sf_dir):
    vec = lambda a: X.price_vector(a, [1], [5, 20])
    last, hold, m = _histories(spark, sf_dir, ["return_1", "ma_ratio", "momentum_10"], vec)
    both = J.recursive_holdout(last, vec, m, hold, 20)
    return E.recursive_scores(both.select("Ticker", "step", "y_pred"), both.select("Ticker", "step", "y_true"))


@query("trend_assessment", None)
def trend_assessment(spark, sf_dir):
    rows = scratch.table(Y.trend_labels(_samples(spark, sf_dir), 5, 0.03).dropna(subset=FEATURES), "labelled")
    forest = L.CLASSIFIERS["random_forest"](numTrees=10).fit(L.assemble(rows.where("split = 'train'"), FEATURES).withColumn("label", F.col("trend").cast("double")))
    last = rows.withColumn("k", F.row_number().over(Window.partitionBy("Ticker").orderBy(F.desc("Datetime")))).where("k = 1")
    classes = forest.transform(L.assemble(last, FEATURES)).select("Ticker", F.col("prediction").cast("int").alias("trend"), vector_to_array("probability").alias("probabilities"), "Close")
    train = _train(rows)
    m = L.LinearForecaster.fit(train, FEATURES, H)
    scores = E.metrics(J.roll(rows.where("split = 'holdout'"), m.transform, "linear", H), ["model"]).select("model", "r2")
    out = E.trend_assessment(classes, J.future(rows, m.transform, "linear"), scores)
    return out.select("Ticker", "trend", F.array_max("probabilities").alias("probability"), "best_model", "expected_change")


@query("launcher_labels", f"""SELECT Ticker, Datetime, {", ".join(f"coalesce(CASE WHEN (lead(Close, {k}) OVER w - Close) / nullif(Close, 0) > 0.02 THEN 2 WHEN (lead(Close, {k}) OVER w - Close) / nullif(Close, 0) < -0.02 THEN 0 ELSE 1 END, 1) AS {n}" for k, n in ((5, "target_trend"), (10, "target_trend_h10")))} FROM ({EC}) WINDOW w AS (PARTITION BY Ticker ORDER BY Datetime)""")
def launcher_labels(spark, sf_dir):
    return Y.launcher_labels(C.event_candles(spark, sf_dir), 5, 10).select("Ticker", "Datetime", "target_trend", "target_trend_h10")


for _n in set(EQ.QUERIES) - _before:
    QUERIES[_n] = EQ.QUERIES.pop(_n)
    if _n in EQ.ORACLES:
        ORACLES[_n] = EQ.ORACLES.pop(_n)
