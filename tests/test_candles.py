"""Candles, indicators and features: registered SQL, pandas formulas, leaks, isolation of tickers, edge series."""

import datetime as dt
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallow import plans
from tallow.functions.dialect import Spark
from tallow.operators import neighbours as N
from tallow.operators import features as X
from tallow.operators import prune as P
from tallow.operators import split as S
from tallow.operators import targets as Y
from tallow.operators.indicators import REGISTRY, compute
from tallow.operators.models import LinearForecaster
from tallow.sources import candles as C

SF = "/root/testdata/sf0.001"


def series(spark, n=80, tickers=("A", "B"), seed=42):
    rng = np.random.default_rng(seed)
    rows = []
    for t in tickers:
        close = 100 * np.cumprod(1 + 0.02 * rng.normal(size=n))
        for i, c in enumerate(close):
            rows.append((t, pd.Timestamp("2024-01-01") + pd.Timedelta(days=i), float(c * 0.99), float(c * (1 + 0.01 * abs(rng.normal()))), float(c * (0.98 - 0.01 * abs(rng.normal()))), float(c), float(rng.integers(1000, 9000))))
    return spark.createDataFrame(pd.DataFrame(rows, columns=[f.name for f in C.SCHEMA.fields]), C.SCHEMA)


def frame(df, ticker="A"):
    return df.where(F.col("Ticker") == ticker).toPandas().sort_values("Datetime").reset_index(drop=True)


def test_registry_has_all_groups():
    assert len(REGISTRY.indicators) == 123
    sizes = {g: len(REGISTRY.by_category(g)) for g in REGISTRY.categories()}
    assert sizes == {"returns": 16, "trend": 32, "volatility": 14, "momentum": 31, "volume": 12, "candle": 9, "regime": 9}
    assert REGISTRY.inputs_of("rsi_14") == {"Close"}


def test_recurrences_equal_pandas(spark):
    df = series(spark, 700, ("A",))
    out = frame(compute(df, ["ema_20", "dema_20", "tema_20", "kama_10", "macd_12_26_9_signal"], shift=False))
    c = out.Close
    e = c.ewm(span=20, adjust=False).mean()
    e2 = e.ewm(span=20, adjust=False).mean()
    assert np.allclose(out.ema_20, e) and np.allclose(out.dema_20, 2 * e - e2)
    assert np.allclose(out.tema_20, 3 * e - 3 * e2 + e2.ewm(span=20, adjust=False).mean())
    m = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    assert np.allclose(out.macd_12_26_9_signal, m.ewm(span=9, adjust=False).mean())
    er = (c - c.shift(10)).abs() / c.diff().abs().rolling(10).sum()
    sc = (er * (2 / 3 - 2 / 31) + 2 / 31) ** 2
    k = np.full(len(c), np.nan)
    k[10] = c[10]
    for i in range(11, len(c)):
        k[i] = k[i - 1] + sc[i] * (c[i] - k[i - 1])
    assert np.allclose(out.kama_10, k, equal_nan=True)


def test_windows_equal_pandas(spark):
    out = frame(compute(series(spark), ["sma_20", "rsi_14", "stoch_k_14", "skew_return_20", "cci_20", "aroon_up_25"], shift=False))
    c, d = out.Close, out.Close.diff()
    assert np.allclose(out.sma_20, c.rolling(20).mean(), equal_nan=True)
    gain, loss = d.clip(lower=0).fillna(0).rolling(14).mean(), (-d.clip(upper=0)).fillna(0).rolling(14).mean()
    assert np.allclose(out.rsi_14, 100 - 100 / (1 + gain / loss), equal_nan=True)
    assert np.allclose(out.skew_return_20, c.pct_change().rolling(20).skew(), equal_nan=True)
    tp = (out.High + out.Low + c) / 3
    mad = tp.rolling(20).apply(lambda x: np.abs(x - x.mean()).mean(), raw=True)
    assert np.allclose(out.cci_20, (tp - tp.rolling(20).mean()) / (0.015 * mad), equal_nan=True)
    assert np.allclose(out.aroon_up_25, out.High.rolling(26).apply(lambda x: x.argmax(), raw=True) * 4, equal_nan=True)


def test_no_indicator_sees_its_own_row(spark):
    df = series(spark, 60, ("A",))
    names = ["sma_5_ratio", "ema_10", "rsi_14", "atr_14", "obv", "breakout_20", "kama_10", "entropy_proxy_20"]
    day = F.lit("2024-02-15").cast("timestamp")
    hit = df.withColumn("Close", F.when(F.col("Datetime") == day, F.col("Close") * 10).otherwise(F.col("Close")))
    a, b = frame(compute(df, names)), frame(compute(hit, names))
    upto = a.Datetime <= "2024-02-15"
    pd.testing.assert_frame_equal(a.loc[upto, names], b.loc[upto, names])
    assert not a.loc[~upto, names].equals(b.loc[~upto, names])


def test_tickers_do_not_touch(spark):
    names = ["ema_20", "obv", "zscore_close_10", "kama_10"]
    both = frame(compute(series(spark), names))
    alone = frame(compute(series(spark).where("Ticker = 'A'"), names))
    pd.testing.assert_frame_equal(both, alone)


def test_flat_and_short_series(spark):
    day = dt.datetime(2024, 1, 1)
    flat = [("F", day + dt.timedelta(days=i), 5.0, 5.0, 5.0, 5.0, 0.0) for i in range(60)]
    short = [("S", day, 1.0, 2.0, 0.5, 1.5, 3.0)]
    df = spark.createDataFrame(flat + short, C.SCHEMA)
    out = compute(df, list(REGISTRY.indicators))
    assert out.count() == 61
    f = frame(compute(df, ["rsi_14", "skew_return_20", "kurt_return_20", "entropy_proxy_20", "donchian_position_20", "hurst_100"], shift=False), "F")
    assert f.rsi_14.isna().all() and f.donchian_position_20.isna().all() and f.hurst_100.isna().all()
    assert f.skew_return_20.iloc[-1] == 0 and f.kurt_return_20.iloc[-1] == -3 and f.entropy_proxy_20.iloc[-1] == 0


def test_partitioning_does_not_matter(spark):
    names = ["ema_20", "rsi_14", "pvt"]
    a = frame(compute(series(spark), names))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        b = frame(compute(series(spark).repartition(7), names))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    pd.testing.assert_frame_equal(a, b)


def test_duplicate_candles_keep_the_last_chunk(spark):
    a = series(spark, 5, ("A",)).withColumn("chunk", F.lit(1))
    b = a.withColumns({"Close": F.col("Close") + 1, "chunk": F.lit(2)})
    out = C.keep_last(C.combine([a, b]))
    assert out.count() == 5 and out.join(b.select("Datetime", F.col("Close").alias("c")), "Datetime").where("Close != c").count() == 0


def test_intervals():
    # Expectations by hand: the limits in days, aliases, and names that are none.
    assert C.interval(" 60MIN ") == "60m" and C.interval("1day") == "1d" and C.interval("1hour") == "1h" and C.interval("3month") == "3mo" and C.interval("1week") == "1wk"
    assert C.INTERVALS["60m"] == 58 and C.INTERVALS["1h"] == 725 and C.INTERVALS["1m"] == 6 and len(C.INTERVALS) == 13
    for name in ("7x", "hourly", "daily", "1w"):
        with pytest.raises(ValueError):
            C.interval(name)


def test_target_round_trips(spark):
    df = spark.createDataFrame([(100.0, [105.0, 110.0, 120.0]), (0.0, [1.0, 2.0, 3.0])], "Close double, y array<double>")
    for t in ("price", "pct_change", "log_return"):
        back = df.select(Y.from_target(Y.to_target(F.col("y"), t, F.col("Close")), t, F.col("Close")).alias("b"), "y").collect()
        for r in back:
            assert np.allclose(r["b"], r["y"], rtol=1e-9)
    r = spark.range(1).select(Y.from_target_cumulative(F.array(F.lit(0.05), F.lit(0.03), F.lit(-0.02)), "pct_change", F.lit(100.0)).alias("p")).first()
    assert np.allclose(r["p"], [105, 108.15, 105.987])


def test_scale_rules():
    assert X.scale_of("sma_20") == "absolute" and X.scale_of("sma_20_ratio") == "relative" and X.scale_of("Volume") == "volume"
    assert X.scale_of("Close") == "absolute" and X.scale_of("bbands_width_20") == "other" and X.scale_of("candle_body") == "other" and X.scale_of("Close_rolling_std_20") == "absolute" and X.scale_of("Close_lag_5") == "absolute" and X.scale_of("rsi_14") == "relative"
    assert X.scale_free_indicators(["sma_20", "sma_20_ratio", "rsi_14", "macd_12_26_9", "obv", "vwap_proxy_20"]) == ["sma_20_ratio", "rsi_14", "obv", "vwap_proxy_20"]
    assert X.of_base_price(["Close", "Open_lag_1", "Adj Close", "rsi_14", "Volume"]) == ["Close", "rsi_14", "Volume"] and X.prices_used(["High_x", "Close"]) == ["Close", "High"]


def test_pruning_learns_from_training_rows_only(spark):
    rng = np.random.default_rng(1)
    n = 100
    pdf = pd.DataFrame({"idx": range(n), "Close": rng.normal(size=n), "a": rng.normal(size=n), "same": 1.0, "gap": [None] * 60 + [1.5, 2.5] * 20})
    pdf["twin"] = pdf.a * 2 + 1e-3 * rng.normal(size=n)
    df = spark.createDataFrame(pdf).withColumn("gap", C.finite("gap"))
    p = P.Pruner().fit(df.where("idx < 80"), ["Close", "a", "same", "gap", "twin"])
    assert {d[0]: d[1] for d in p.decisions} == {"same": "constant", "gap": "nulls", "twin": "correlated"}
    worse = df.withColumn("a", F.when(F.col("idx") >= 80, 9999.0).otherwise(F.col("a")))
    assert P.Pruner().fit(worse.where("idx < 80"), ["Close", "a", "same", "gap", "twin"]).decisions == p.decisions
    assert P.Pruner.from_json(p.to_json()).transform(df).columns == ["idx", "Close", "a"]


def test_correlations_with_gaps(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(size=(200, 3)), columns=list("abc"))
    pdf.loc[::7, "b"] = np.nan
    pdf["c"] = pdf.a + pdf.c
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double")
    for r in P.correlations(df, ["a", "b", "c"]).collect():
        assert r["corr"] == pytest.approx(pdf.corr().loc[r["a"], r["b"]])
    ranks = P.correlations(df.select("a", "c"), ["a", "c"], "spearman").first()
    assert ranks["corr"] == pytest.approx(pdf.corr("spearman").loc["a", "c"])


def test_linear_forecaster_equals_least_squares(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    y = np.column_stack([x @ [1.0, -2.0] + 3, x @ [0.5, 0.1] - 1])
    df = spark.createDataFrame([(float(a), float(b), [float(v) for v in t]) for (a, b), t in zip(x, y)], "a double, b double, y array<double>")
    m = LinearForecaster.fit(df, ["a", "b"], 2)
    assert np.allclose(m.weights, [[1, -2, 3], [0.5, 0.1, -1]])


def test_splits_leave_a_gap(spark):
    out = frame(S.holdout_split(series(spark, 200, ("A",)), 20, 5))
    assert (out.split == "holdout").sum() == 20 and (out.split == "gap").sum() == 5 and (out.split == "train").sum() == 175


SAMPLE = ["candles_hourly", "candle_slice", "ind_momentum_rsi", "rolling_median", "close_features", "outliers_mean", "metrics_per_step", "augment_mixup", "classify_features", "direct_evaluation", "prune_decisions", "augment_volatility_regime"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(plans.ORACLES[name]).fetchdf()
    got = plans.QUERIES[name](spark, SF).toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    keys = [c for c in cols if got[c].dtype.kind not in "f"]
    a, b = (x[cols].sort_values(keys).reset_index(drop=True) for x in (got, want))
    for c in cols:
        if a[c].dtype.kind == "f":
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-6, atol=2e-6, equal_nan=True), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


def test_nearest_rows_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    n = 1300
    pdf = pd.DataFrame({"Ticker": ["A"] * n + ["B"] * 65 + ["C"] + ["D"] * 70, "f": rng.normal(size=n + 136), "g": rng.normal(size=n + 136)})
    pdf.loc[pdf.Ticker == "D", ["f", "g"]] = 1.0
    pdf["idx"] = pdf.groupby("Ticker").cumcount()
    df = spark.createDataFrame(pdf).withColumn("y", F.array("f"))
    got = {(r["Ticker"], r["idx"]): [x["d"] for x in r["__n"]] for r in N._nearest(df, ["f", "g"], 5, 42).collect()}
    assert len(got) == len(pdf)
    for t, part in pdf.groupby("Ticker"):
        x = part[["f", "g"]].to_numpy()
        d = ((x[:, None] - x[None]) ** 2).sum(2)
        np.fill_diagonal(d, np.inf)
        want = np.sort(d, axis=1)[:, : min(5, len(x) - 1)]
        assert np.allclose([got[t, i] for i in part.idx], want), t
    made = N.smote(df, ["f", "g"])
    assert made.count() > len(pdf) and N.pattern_morph(df, ["f", "g"]).count() == len(pdf)


def test_augment_knows_the_methods_of_neighbours(spark):
    from tallow.operators.augment import augment

    rng = np.random.default_rng(6)
    df = spark.createDataFrame([("A", i, *map(float, rng.normal(size=3)), [float(i)]) for i in range(20)], "Ticker string, idx long, f double, g double, h double, y array<double>")
    for m, n in {"frequency_mask": 20, "pattern_morph": 20, "feature_rotation": 20, "smote": 30}.items():
        out = augment(df, ["f", "g", "h"], [m])
        assert out.columns == [*df.columns, "method", "copy"] and out.where(F.col("method") == m).count() == n, m


def test_every_level_is_known():
    assert sum(map(len, REGISTRY.levels(REGISTRY.indicators, Spark()))) >= 123


def test_recurrences_of_a_series_that_spans_partitions(spark, monkeypatch):
    from tallow.functions import recurrence

    monkeypatch.setattr(recurrence, "PARTITION_ROWS", 60)
    rng = np.random.default_rng(4)
    rows = [(t, i, None if (i < 3 or i % 17 == 0) and t == "a" else float(rng.normal())) for t, n in (("a", 500), ("b", 40), (None, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "Ticker string, Datetime long, x double").repartition(5)
    Mean, Affine = recurrence.Mean, recurrence.Affine
    parts = [Mean("m2", (("m1", 1.0),), 7), Mean("m1", (("x", 1.0),), 5), Mean("d", (("m1", 1.0), ("m2", -2.0)), 3), Affine("r", "CASE WHEN Datetime % 100 = 20 THEN 0 ELSE 0.5 END", "CASE WHEN Datetime = 150 THEN NULL ELSE Datetime END")]
    got = recurrence.linear_recurrences(df, parts).toPandas()
    assert len(got) == len(rows)
    for _, g in got.groupby("Ticker", dropna=False):
        g = g.sort_values("Datetime")
        y = {"m1": None, "m2": None, "d": None, "r": None}
        for row in g.itertuples():
            x = None if row.x != row.x else row.x
            mean = lambda old, x, span: x if old is None else old if x is None else old + 2 / (span + 1) * (x - old)
            y["m1"] = mean(y["m1"], x, 5)
            if y["m1"] is not None:
                # A mean of means waits where its own input does: the inner one goes on.
                y["m2"] = mean(y["m2"], y["m1"], 7)
                y["d"] = mean(y["d"], y["m1"] - 2 * y["m2"], 3)
            a, b = (0 if row.Datetime % 100 == 20 else 0.5), (None if row.Datetime == 150 else row.Datetime)
            y["r"] = b if a == 0 else None if y["r"] is None or b is None else a * y["r"] + b
            for name, want in y.items():
                have = getattr(row, name)
                assert (have != have) if want is None else abs(have - want) < 1e-9 * max(1, abs(want)), (row, name, want)


def test_kendall_equals_pandas(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"a": rng.integers(0, 12, 400).astype(float), "b": rng.normal(size=400).round(1)})
    pdf["b"] += pdf.a * 0.2
    df = spark.createDataFrame(pdf).union(spark.createDataFrame([(None, 1.0), (2.0, None)], "a double, b double"))
    c = np.sign(pdf.a.values[:, None] - pdf.a.values) * np.sign(pdf.b.values[:, None] - pdf.b.values)
    want = c.sum() / np.sqrt((pdf.a.values[:, None] != pdf.a.values).sum() * (pdf.b.values[:, None] != pdf.b.values).sum())
    assert P.kendall(df, "a", "b") == pytest.approx(want)
    assert P.kendall(df.withColumn("b", F.lit(1.0)), "a", "b") is None and P.kendall(df.where("false"), "a", "b") is None


@pytest.mark.parametrize("rows", [1 << 15, 20])
def test_kendall_of_all_pairs_in_one_set_of_jobs(spark, monkeypatch, rows):
    monkeypatch.setattr(P, "RANGE_ROWS", rows)
    rng = np.random.default_rng(9)
    n = 300
    x = rng.normal(size=(n, 6))
    x[:, 1] += x[:, 0]
    x[:, 2] = np.where(rng.random(n) < 0.95, 0.0, x[:, 2])  # one value in nearly all rows
    x[:, 3] = rng.integers(0, 4, n)
    x[:, 4] = np.where(rng.random(n) < 0.8, x[:, 3], x[:, 0])
    x[:, 5] = 2.0
    gaps = rng.random(x.shape) < 0.1
    columns = list("abcdef")
    data = [tuple(None if g else float(v) for v, g in zip(r, m)) for r, m in zip(x, gaps)]
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in columns)).repartition(3)
    got = {(r["a"], r["b"]): r["corr"] for r in P.correlations(df, columns, "kendall").collect()}
    assert len(got) == 15
    for i in range(6):
        for j in range(i + 1, 6):
            both = ~gaps[:, i] & ~gaps[:, j]
            u, v = np.sign(x[both, i][:, None] - x[both, i]), np.sign(x[both, j][:, None] - x[both, j])
            scale = (u != 0).sum() * (v != 0).sum()
            have = got[columns[i], columns[j]]
            assert have is None if scale == 0 else have == pytest.approx((u * v).sum() / np.sqrt(scale)), (i, j)


def test_stored_pipeline_needs_its_context_only(spark):
    c = series(spark, 60)
    old, new = c.where(F.col("Datetime") < c.agg(F.max("Datetime")).first()[0]), c.where(F.col("Datetime") == c.agg(F.max("Datetime")).first()[0])
    p = X.FeaturePipeline(["Close"], [1, 3], [5], ["mean", "std"]).fit(old)
    again = X.FeaturePipeline.from_json(p.to_json())
    a = frame(again.transform_new(new, old))[p.names()].to_numpy()
    b = frame(p.transform(c).where(F.col("Datetime") == c.agg(F.max("Datetime")).first()[0]))[p.names()].to_numpy()
    assert len(a) and np.allclose(a, b) and p.summary()["features"] == 4


def test_processor_and_reloaded_models(spark, tmp_path):
    from tallow.operators import models as L

    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    x[:, 2] = x[:, 0] + 0.01 * x[:, 2]
    df = spark.createDataFrame([(float(a), float(b), float(c), [float(a - b)]) for a, b, c in x], "a double, b double, c double, y array<double>")
    p = L.FeatureProcessor(["a", "b", "c"], "raw+pca", 0.95).fit(df)
    out = p.transform(df)
    assert out.columns == ["y", "PCA_1", "PCA_2", "a", "b", "c"] and p.metadata(spark).first()["n_out"] == 5
    assert abs(out.agg(F.corr("PCA_1", "PCA_2")).first()[0]) < 1e-6
    m = LinearForecaster.fit(df, ["a", "b"], 1)
    m.save(spark, f"{tmp_path}/linear")
    assert np.array_equal(LinearForecaster.load(spark, f"{tmp_path}/linear").weights, m.weights)
    trees = L.fit_steps("boosted_trees", df, ["a", "b"], 1, maxIter=2)
    L.save_steps(trees, f"{tmp_path}/trees")
    back = L.load_steps(type(trees[0]), f"{tmp_path}/trees", 1)
    one = lambda ms: [r["y_pred"] for r in L.predict_steps(ms, df, ["a", "b"]).collect()]
    assert one(trees) == one(back)
    assert [r["feature"] for r in L.importances(spark, trees, ["a", "b"], top=1).collect()] in (["a"], ["b"])


def test_grids_and_variants():
    from tallow.operators import models as L
    from tallow.operators.indicators import Registry

    assert len(L.grid({"a": [1, 2], "b": [3, 4, 5]})) == 6 and L.grid({"a": [1, 2, 3]}, 2) == L.grid({"a": [1, 2, 3]}, 2) and len(L.grid({"a": [1, 2, 3]}, 2)) == 2
    assert L.search([{"a": 3}, {"a": 1}, {"a": -1}], lambda c: abs(c["a"]))[0] == {"a": 1}
    r = Registry()
    r.indicators, r.helpers = dict(REGISTRY.indicators), dict(REGISTRY.helpers)
    assert r.variant("rsi_14", 21) == "rsi_21" and "rs_21" in r.helpers and r.variant("ema_20_ratio", 33) == "ema_33_ratio" and "ema_33" in r.indicators
    assert "rsi_21" not in REGISTRY.indicators
    with pytest.raises(ValueError):
        r.variant("obv", 3)
