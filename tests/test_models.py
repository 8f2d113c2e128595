"""Classifier fronts and searches, early stopping, failures as rows, fallbacks, stored configurations, Beta weights."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallow.operators import augment as A
from tallow.operators import forecast as J
from tallow.operators import models as L
from tallow.operators import neighbours as N
from tallow.sources.sinks import read_results, write_results


def ring(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    inside = (x**2).sum(1) < 1.2
    return spark.createDataFrame([(float(a), float(b), int(t)) for (a, b), t in zip(x, inside)], "a double, b double, trend int")


def accuracy(out, model):
    return out.where(F.col("model") == model).agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))).first()[0]


def test_random_features_beat_the_linear_machine_on_a_ring(spark):
    out, failed = L.train_classifiers(ring(spark), ring(spark, 200, 1), ["a", "b"], ["svc", "linear_svc", "nothing"], params={"svc": {"C": 10.0, "gamma": 0.5}})
    assert failed == [("nothing", "unknown model")]
    assert accuracy(out, "svc") > 0.9 > 0.75 > accuracy(out, "linear_svc")
    report = L.classifier_report(spark, out, failed).where("error IS NOT NULL").collect()
    assert [(r["model"], r["n"], r["error"]) for r in report] == [("nothing", None, "unknown model")]
    assert L.classifier_report(spark, None, failed).count() == 1


def test_search_takes_the_better_choice_and_gaps_take_means(spark):
    tried, best = L.search_classifier("random_forest", ring(spark), ring(spark, 200, 1), ["a", "b"], {"maxDepth": [1, 6]})
    assert best == {"maxDepth": 6} and tried.count() == 2
    gaps = ring(spark, 50, 2).withColumn("a", F.when(F.col("b") > 0, F.col("a")))
    out, _ = L.train_classifiers(ring(spark), gaps, ["a", "b"], ["random_forest"], params={"random_forest": {"numTrees": 3}})
    assert out.count() == 50


def test_boosting_stops_early_on_noise(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(a), [float(b)]) for a, b in rng.normal(size=(400, 2))], "a double, y array<double>")
    stopped, full = (L.fit_steps("boosted_trees", df, ["a"], 1, validation=v, maxIter=15, maxDepth=3)[0].getNumTrees for v in (0.3, 0.0))
    assert stopped < full == 15


def test_parameters_by_precedence():
    config = {"model_hyperparameters": {"regressor_a": {"x": 1}}, "model_zoo": {"a": {"params": {"x": 2}}, "b": {"params": {"x": 3, "y": 4}}, "c": {"z": 5}}, "advanced_models": {"c": {"z": 6}, "d": {"params": {"w": 7}}}}
    got = {n: L.model_parameters(n, config, {"y": 9} if n == "b" else None) for n in "abcde"}
    assert got == {"a": {"x": 1}, "b": {"x": 3, "y": 9}, "c": {"z": 5}, "d": {"w": 7}, "e": {}}
    assert L.model_parameters("a") == {}


def test_futures_have_a_naive_row_and_fall_back(spark):
    df = spark.createDataFrame([("t", 1, 5.0), ("t", 2, 7.0), ("u", 1, 3.0)], "Ticker string, Datetime long, Close double")
    good = lambda d: d.withColumn("y_pred", F.array(F.lit(0.0), F.lit(np.log(2.0))))

    def broken(d):
        raise RuntimeError("no")

    rows = {(r["Ticker"], r["model"], r["step"]): (r["y_pred"], r["note"]) for r in J.futures(df, {"good": good, "broken": broken}, 2).collect()}
    assert len(rows) == 12 and rows["t", "good", 2][0] == pytest.approx(14.0) and rows["u", "naive", 2] == (3.0, None)
    assert rows["t", "broken", 1] == (7.0, "RuntimeError: no")


def test_results_come_back_with_their_configuration(spark, tmp_path):
    df = spark.createDataFrame([("m", 1.5)], "model string, rmse double")
    write_results(df, f"file://{tmp_path}/r", {"b": [1, 2], "a": {"c": None}})
    metrics, config = read_results(spark, f"file://{tmp_path}/r")
    assert [tuple(r) for r in metrics.select("model", "rmse").collect()] == [("m", 1.5)] and config == {"b": [1, 2], "a": {"c": None}}


@pytest.mark.parametrize("a", [0.2, 0.5, 3.0])
def test_beta_weights_have_their_moments(spark, a):
    x = np.array([r[0] for r in spark.range(20_000).select(A.beta(a, 1, "t", "id")).collect()])
    assert x.min() >= 0 and x.max() <= 1 and abs(x.mean() - 0.5) < 0.01
    assert x.var() == pytest.approx(1 / (4 * (2 * a + 1)), rel=0.03)
    assert ((x - 0.5) ** 4).mean() == pytest.approx(3 / (16 * (2 * a + 1) * (2 * a + 3)), rel=0.05)


@pytest.mark.parametrize("band, n", [("low", 40), ("mid", 41), ("high", 40), ("high", 1)])
def test_band_equals_that_of_a_fast_transform(spark, monkeypatch, band, n):
    monkeypatch.setattr(N, "SPECTRUM_ROWS", 16)
    monkeypatch.setattr(N, "SPECTRUM_BINS", 3)
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 2))
    rows = [(t, k, None if k == 5 else float(a), float(b)) for t in ("s", None) for k, (a, b) in enumerate(x)]
    out = N.frequency_mask(spark.createDataFrame(rows, "Ticker string, idx long, f double, g double"), ["f", "g"], band).collect()
    spec = np.fft.rfft(np.where((np.arange(n) == 5)[:, None] & np.array([True, False]), 0.0, x), axis=0)
    first, last = N.band_bins(n, band, 0.2)
    spec[first:last] = 0
    want = np.fft.irfft(spec, n, axis=0)
    assert len(out) == 2 * n
    for r in out:
        assert (r["f"], r["g"]) == pytest.approx(tuple(want[r["idx"]]), abs=1e-9)


def test_overrides_of_a_preset(spark):
    rows = [("t", k, float(k), [float(k)]) for k in range(30)]
    df = spark.createDataFrame(rows, "Ticker string, idx long, f double, y array<double>")
    plain = A.augment(df, ["f"], "light")
    loud = A.augment(df, ["f"], "light", params={"jitter": {"sigma": 5.0}})
    far = lambda d: d.where("method = 'jitter'").agg(F.max(F.abs(F.col("f") - F.col("idx")))).first()[0]
    assert far(loud) == pytest.approx(500 * far(plain)) and plain.count() == loud.count() == 90
    with pytest.raises(ValueError):
        A.augment(df, ["f"], ["jitter"], params={"nothing": {}})
