"""Stretches with halos, running sums over them and exact quantiles, against plain windows and sorted values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallow.functions import quantiles as Q
from tallow.functions.stretches import haloed, in_stretches, numbered, running_sums
from tallow.operators import features as X
from tallow.operators.indicators import REGISTRY, compute
from tallow.operators.targets import multistep_targets

CANDLES = "Ticker string, Datetime timestamp, Open double, High double, Low double, Close double, Volume double"


def candles(spark, sizes):
    rng = np.random.default_rng(4)
    rows = []
    for ticker, n in sizes.items():
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        for k in range(n):
            c = float(close[k])
            rows.append((ticker, k, c * 0.99, c * 1.02, c * 0.97, None if k % 97 == 13 else c, float(rng.integers(0, 50))))
    df = spark.createDataFrame(rows, CANDLES.replace("timestamp", "long"))
    return df.withColumn("Datetime", F.timestamp_seconds(F.col("Datetime") * 3600))


def table(df, names):
    return {(r["Ticker"], r["Datetime"]): [r[n] for n in names] for r in df.select("Ticker", "Datetime", *names).collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-7)), (k, x, y)


@pytest.mark.parametrize("group", ["volume", "momentum", "regime"])
def test_indicators_over_stretches_equal_plain_ones(spark, group):
    df = candles(spark, {"a": 700, "b": 3, None: 260, "c": 1})
    names = REGISTRY.by_category(group)
    same(table(compute(df, names, stretch=200), names), table(compute(df, names), names))


def test_one_series_is_split_over_many_tasks(spark):
    df = candles(spark, {"a": 5000})
    out = in_stretches(df, lambda d: X.rolling_features(d, [20], ["mean"], ["Close"]), behind=20, length=500)
    assert out.where("Close_rolling_20_mean IS NOT NULL").count() == 4999
    rows = haloed(numbered(df, 500), 500, 20)
    per = rows.groupBy("__stretch").agg(F.count("*").alias("n"), F.count_if("__own").alias("own")).collect()
    assert sorted(r["own"] for r in per if r["own"]) == [500] * 10 and max(r["n"] for r in per) == 520
    plan = compute(df, ["sma_20", "obv", "rsi_14"], stretch=500)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert windows and all("__stretch" in w for w in windows)


def test_features_and_targets_over_stretches(spark):
    df = candles(spark, {"a": 333, "b": 64, "c": 65, "d": 1})

    def make(d):
        d = X.close_features(X.rolling_features(X.lag_features(d, [1, 7], ["Close"]), [5], ["std", "median"], ["Close"]), [2], [3, 9])
        return multistep_targets(d, 4)

    names = ["Close_lag_7", "Close_rolling_5_std", "Close_rolling_5_median", "Close_ma_ratio", "Close_return_10"]
    whole = lambda d: {k: [*v[:-1], *v[-1]] for k, v in table(d, [*names, "y"]).items()}
    same(whole(in_stretches(df, make, behind=11, ahead=4, length=64)), whole(make(df)))
    with pytest.raises(ValueError):
        in_stretches(df, make, behind=80, length=64)


def test_running_sums_over_stretches(spark):
    rows = [("a", k, None if k < 3 or k % 5 == 0 else float(k)) for k in range(50)] + [("b", 0, None), (None, 1, 2.0), (None, 2, 3.0)]
    df = spark.createDataFrame(rows, "Ticker string, Datetime long, v double").withColumn("Datetime", F.timestamp_seconds("Datetime"))
    got = {(r["Ticker"], r["__row"]): r["s"] for r in running_sums(numbered(df, 7), {"s": "v"}, 7).collect()}
    for t in ("a", "b", None):
        total = None
        for k, (_, _, v) in enumerate([r for r in rows if r[0] == t], 1):
            total = v if total is None else total + (v or 0)
            assert got[t, k] == total


def test_numbering_of_an_empty_table(spark):
    df = candles(spark, {"a": 1}).where("false")
    assert compute(df, ["sma_5", "obv", "ema_5"], stretch=100).collect() == []


def brute(values, p):
    x = sorted(v for v in values if v is not None and not math.isnan(v))
    if not x:
        return None
    at = p * (len(x) - 1)
    lo = int(at)
    return x[lo] if at == lo else (lo + 1 - at) * x[lo] + (at - lo) * x[min(lo + 1, len(x) - 1)]


@pytest.mark.parametrize("few, accuracy", [(4096, 2000), (8, 100), (1, 50)])
def test_quantiles_equal_those_of_sorted_values(spark, monkeypatch, few, accuracy):
    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "ACCURACY", accuracy)
    rng = np.random.default_rng(0)
    n = 5000
    cols = {
        "normal": rng.normal(size=n).tolist(), "ties": rng.integers(0, 3, n).astype(float).tolist(), "wide": (rng.normal(size=n) * 10.0 ** rng.integers(-200, 200, n)).tolist(),
        "one": [7.0] * n, "gaps": [None if k % 3 else float(k) for k in range(n)], "none": [None] * n, "nan": [float("nan") if k % 2 else -float(k) for k in range(n)], "mostly": [0.0] * (n - 9) + [1e9] * 9,
    }
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} double" for c in cols)).repartition(5)
    shares = [0.0, 0.01, 0.25, 0.5, 0.77, 0.9985, 1.0]
    got = Q.quantiles(df, {c: (F.col(c), shares) for c in cols})
    for c in cols:
        assert got[c] == [brute(cols[c], p) for p in shares], c


def test_quantiles_of_an_empty_table(spark):
    df = spark.createDataFrame([], "x double")
    assert Q.quantiles(df, {"x": (F.col("x"), [0.5])}) == {"x": [None]}
