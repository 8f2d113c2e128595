"""Distributed forecasters and classifiers on feature rows (keys, features, y array).

Each fit is a set of Spark jobs; what reaches the driver are coefficients and
sums whose size depends on the number of features and steps only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow.functions import scratch
from tallow.functions.windows import series, whole
from tallow.operators.features import apply_scaler, fit_means, fit_scaler, impute


@dataclass
class LinearForecaster:
    """One coefficient vector per step; all steps share the Gram matrix."""

    features: list[str]
    weights: np.ndarray  # steps x (features + 1), the intercept last

    @classmethod
    def fit(cls, rows: DataFrame, features: list[str], steps: int, intercept: bool = True, ridge: float = 0.0) -> "LinearForecaster":
        """Least squares from one pass of sums; a singular system takes the least-norm solution."""
        xs = [F.col(c).cast("double") for c in features] + ([F.lit(1.0)] if intercept else [])
        ys = [F.get("y", F.lit(k)) for k in range(steps)]
        p = len(xs)
        sums = [F.sum(xs[i] * xs[j]).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)]
        sums += [F.sum(x * y).alias(f"h{i}_{k}") for i, x in enumerate(xs) for k, y in enumerate(ys)]
        row = rows.dropna(subset=features).agg(*sums).first()
        gram, cross = np.zeros((p, p)), np.zeros((p, steps))
        for i in range(p):
            for j in range(i, p):
                gram[i, j] = gram[j, i] = row[f"g{i}_{j}"] or 0.0
            for k in range(steps):
                cross[i, k] = row[f"h{i}_{k}"] or 0.0
        gram[np.arange(len(features)), np.arange(len(features))] += ridge
        w = np.linalg.lstsq(gram, cross, rcond=None)[0].T
        return cls(features, w if intercept else np.column_stack([w, np.zeros(steps)]))

    def predict(self) -> Column:
        """The array of all steps' predictions, as an expression."""
        dot = lambda w: sum((F.lit(float(a)) * F.col(c) for a, c in zip(w[:-1], self.features)), F.lit(float(w[-1])))
        return F.array(*[dot(w) for w in self.weights])

    def transform(self, rows: DataFrame, name: str = "y_pred") -> DataFrame:
        return rows.withColumn(name, self.predict())

    def save(self, spark: SparkSession, path: str) -> None:
        """One row per step and feature, the intercept by the name ""."""
        rows = [(k, j, c, float(w[j])) for k, w in enumerate(self.weights) for j, c in enumerate([*self.features, ""])]
        spark.createDataFrame(rows, "step int, place int, feature string, weight double").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "LinearForecaster":
        rows = sorted(map(tuple, spark.read.parquet(path).collect()))  # coefficients
        features = [c for k, _, c, _ in rows if k == 0 and c]
        return cls(features, np.array([w for *_, w in rows]).reshape(-1, len(features) + 1))


def assemble(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(rows)


REGRESSORS: dict[str, Callable[..., Estimator]] = {
    "elastic_net": lambda **k: LinearRegression(**({"regParam": 0.01, "elasticNetParam": 0.5, "standardization": False, "maxIter": 100} | k)),
    "boosted_trees": lambda **k: GBTRegressor(**({"maxDepth": 4, "maxIter": 20, "stepSize": 0.1, "seed": 42} | k)),
}
CLASSIFIERS: dict[str, Callable[..., Estimator]] = {
    "random_forest": lambda **k: RandomForestClassifier(**({"numTrees": 30, "maxDepth": 6, "seed": 42, "labelCol": "label"} | k)),
    "perceptron": lambda layers, **k: MultilayerPerceptronClassifier(**({"layers": layers, "maxIter": 40, "seed": 42, "labelCol": "label"} | k)),
}


def available_models() -> list[str]:
    return sorted(["linear", *REGRESSORS, *CLASSIFIERS])


def fit_steps(name: str, rows: DataFrame, features: list[str], steps: int, validation: float = 0.0, **params) -> list[Model]:
    """One regressor per step.

    With a validation share, boosting stops where trees no longer lower the
    loss of that share of the rows, chosen by a hash of their features.
    """
    vec = assemble(rows, features)
    if validation:
        params = {"validationIndicatorCol": "__held"} | params
        vec = vec.withColumn("__held", F.pmod(F.xxhash64(*features), F.lit(1000)) < int(1000 * validation))
    return [REGRESSORS[name](labelCol="label", **params).fit(vec.withColumn("label", F.get("y", F.lit(k)))) for k in range(steps)]


def predict_steps(models: list[Model], rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with y_pred, the array of all steps."""
    out = assemble(rows, features)
    for k, m in enumerate(models):
        out = m.setPredictionCol(f"__p{k}").transform(out)
    return out.withColumn("y_pred", F.array(*[F.col(f"__p{k}") for k in range(len(models))])).drop("features", *[f"__p{k}" for k in range(len(models))])


def save_steps(models: list[Model], path: str) -> None:
    """One folder per step."""
    for k, m in enumerate(models):
        m.write().overwrite().save(f"{path}/step-{k}")


def load_steps(kind: type[Model], path: str, steps: int) -> list[Model]:
    return [kind.load(f"{path}/step-{k}") for k in range(steps)]


def importances(spark: SparkSession, models: list[Model], features: list[str], top: int | None = None) -> DataFrame:
    """(feature, importance, place), the mean over the steps, greatest first; of equal ones by name."""
    mean = np.mean([m.featureImportances.toArray() for m in models], axis=0)
    rows = sorted(zip(features, map(float, mean)), key=lambda x: (-x[1], x[0]))[:top]
    return spark.createDataFrame([(f, v, k + 1) for k, (f, v) in enumerate(rows)], "feature string, importance double, place int")


def grid(space: dict[str, list], most: int | None = None, seed: int = 42) -> list[dict]:
    """Every choice of the space, or as many of them as most, drawn by seed."""
    every = [dict(zip(space, x)) for x in product(*space.values())]
    if most is None or most >= len(every):
        return every
    return [every[i] for i in sorted(np.random.default_rng(seed).choice(len(every), most, replace=False).tolist())]


def search(choices: list[dict], loss: Callable[[dict], float]) -> tuple[dict, list[tuple[dict, float]]]:
    """(best choice, all with their losses); each loss is a Spark job of its own, of equal ones the first wins."""
    tried = [(c, loss(c)) for c in choices]
    return min(tried, key=lambda x: x[1])[0], tried


def first_step_loss(fit: Callable[[dict, DataFrame], Callable[[DataFrame], DataFrame]], rows: DataFrame, share: float = 0.8) -> Callable[[dict], float]:
    """Loss of a choice: the rmse of the first step on each ticker's last rows, after a fit on those before."""
    place = F.row_number().over(series()) / F.count("*").over(whole())
    cut = scratch.table(rows.withColumn("__early", place <= share), "search")
    early, late = cut.where("__early").drop("__early"), cut.where("NOT __early").drop("__early")

    def loss(choice: dict) -> float:
        off = F.get("y_pred", F.lit(0)) - F.get("y", F.lit(0))
        return fit(choice, early)(late).agg(F.sqrt(F.avg(off * off))).first()[0] or float("inf")

    return loss


def search_kernel_ridge(rows: DataFrame, features: list[str], steps: int, space: dict[str, list], most: int | None = None) -> tuple[LinearForecaster, Callable[[DataFrame], DataFrame], dict]:
    """kernel_ridge with the alpha and gamma of the space that forecast the first step best."""

    def fit(choice: dict, early: DataFrame) -> Callable[[DataFrame], DataFrame]:
        m, add = kernel_ridge(early.withColumn("y", F.slice("y", 1, 1)), features, 1, **choice)
        return lambda df: m.transform(add(df))

    best, _ = search(grid(space, most), first_step_loss(fit, rows))
    model, add = kernel_ridge(rows, features, steps, **best)
    return model, add, best


def search_forest(train: DataFrame, features: list[str], space: dict[str, list], most: int, seed: int = 42, label: str = "trend") -> tuple[Model, dict]:
    """A random forest with the parameters, of a seeded part of the space, that classify folds of the training rows best."""
    maps = []
    forest = RandomForestClassifier(numTrees=20, seed=seed, labelCol="label")
    for choice in grid(space, most, seed):
        maps.append({forest.getParam(k): v for k, v in choice.items()})
    rows = assemble(train.dropna(subset=features), features).select("features", F.col(label).cast("double").alias("label"))
    judge = MulticlassClassificationEvaluator(labelCol="label", metricName="f1")
    found = CrossValidator(estimator=forest, estimatorParamMaps=maps, evaluator=judge, numFolds=3, seed=seed).fit(scratch.table(rows, "forest"))
    best = maps[int(np.argmax(found.avgMetrics))]
    return found.bestModel, {k.name: v for k, v in best.items()}


@dataclass
class FeatureProcessor:
    """Standardised features as they are (raw) or with principal components before them (raw+pca)."""

    features: list[str]
    mode: str = "raw"
    share: float | int = 0.95
    scaler: DataFrame | None = None
    loadings: list[list[float]] | None = None
    kept: list[float] | None = None

    def fit(self, train: DataFrame) -> "FeatureProcessor":
        if self.mode not in ("raw", "raw+pca"):
            raise ValueError(f"unknown mode {self.mode!r}: raw or raw+pca")
        self.scaler = scratch.table(fit_scaler(train, self.features), "scaler")
        if self.mode == "raw+pca":
            scaled = apply_scaler(train, self.scaler, self.features).dropna(subset=self.features)
            vec = VectorAssembler(inputCols=self.features, outputCol="__v").transform(scaled)
            model = PCA(k=len(self.features) if self.share < 1 else int(self.share), inputCol="__v", outputCol="__pc").fit(vec)
            kept, load = model.explainedVariance.toArray(), model.pc.toArray()
            k = int(np.searchsorted(np.cumsum(kept), self.share) + 1) if self.share < 1 else len(kept)
            signs = np.sign(load[np.abs(load).argmax(0), np.arange(load.shape[1])])
            self.loadings, self.kept = (load * signs)[:, :k].T.tolist(), kept[:k].tolist()
        return self

    def names(self) -> list[str]:
        return [f"PCA_{j + 1}" for j in range(len(self.loadings or []))] + self.features

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with the features scaled and the components, which are null where a feature is."""
        out = apply_scaler(rows, self.scaler, self.features)
        parts = {f"PCA_{j + 1}": sum((F.col(c) * float(w) for c, w in zip(self.features, load)), F.lit(0.0)) for j, load in enumerate(self.loadings or [])}
        rest = [c for c in rows.columns if c not in self.features]
        return out.select(*rest, *[v.alias(k) for k, v in parts.items()], *self.features)

    def metadata(self, spark: SparkSession) -> DataFrame:
        """One row: mode, dimensions in and out, components, and the variance that they explain."""
        row = (self.mode, len(self.features), len(self.names()), len(self.loadings or []), float(sum(self.kept or [])))
        return spark.createDataFrame([row], "mode string, n_in int, n_out int, n_components int, explained double")


def random_features(rows: DataFrame, features: list[str], count: int = 64, gamma: float = 1.0, seed: int = 42) -> DataFrame:
    """rows with rff_0 ...: cosines whose products approximate a Gaussian kernel (Rahimi and Recht 2007)."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, np.sqrt(2 * gamma), (count, len(features))), rng.uniform(0, 2 * np.pi, count)
    one = lambda j: F.cos(sum((F.lit(float(a)) * F.col(c) for a, c in zip(w[j], features)), F.lit(float(b[j])))) * float(np.sqrt(2 / count))
    return rows.select("*", *[one(j).alias(f"rff_{j}") for j in range(count)])


def kernel_ridge(rows: DataFrame, features: list[str], steps: int, alpha: float = 1.0, gamma: float = 1.0, count: int = 32, seed: int = 42) -> tuple[LinearForecaster, Callable[[DataFrame], DataFrame]]:
    """Ridge on random features; also the function that adds them to new rows."""
    add = lambda df: random_features(df, features, count, gamma, seed)
    return LinearForecaster.fit(add(rows), [f"rff_{j}" for j in range(count)], steps, ridge=alpha), add


def train_classifiers(train: DataFrame, test: DataFrame, features: list[str], names: list[str], label: str = "trend", params: dict[str, dict] | None = None) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """(model, y_true, y_pred) on the test rows, and (model, error) of those that are unknown or failed.

    Gaps take the training means, features are scaled by training rows; params
    has, by model, what replaces its defaults.
    """
    means = fit_means(train, features)
    fill = lambda df: impute(df.withColumn("label", F.col(label).cast("double")), means, features)
    scale = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)])
    a, b = fill(train), fill(test)
    prep = scale.fit(a)
    a, b = (scratch.table(prep.transform(df).select("features", "label"), "classes") for df in (a, b))
    out, failed = None, []
    for n in names:
        if n not in CLASSIFIERS:
            failed.append((n, "unknown model"))
            continue
        try:
            own = ({"layers": [len(features), 16, 3]} if n == "perceptron" else {}) | (params or {}).get(n, {})
            p = CLASSIFIERS[n](**own).fit(a).transform(b).select(F.lit(n).alias("model"), F.col("label").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))
            out = p if out is None else out.union(p)
        except Exception as e:  # one model's failure is a row, not the end of the run
            failed.append((n, f"{type(e).__name__}: {e}"[:200]))
    return out, failed


def classifier_report(spark: SparkSession, predicted: DataFrame | None, failed: list[tuple[str, str]]) -> DataFrame:
    """(model, y_true, y_pred, n, error): the counts of each model, and a row for each that failed."""
    rows = spark.createDataFrame([(m, None, None, None, e) for m, e in failed], "model string, y_true int, y_pred int, n long, error string")
    if predicted is None:
        return rows
    counts = predicted.groupBy("model", "y_true", "y_pred").agg(F.count("*").alias("n"))
    return counts.withColumn("error", F.lit(None).cast("string")).union(rows)


class KernelSVC:
    """One linear machine for each class on random features of a Gaussian kernel; gamma as in exp(-gamma distance^2), None: one over the number of features."""

    def __init__(self, C: float = 1.0, gamma: float | None = None, count: int = 64, seed: int = 42, maxIter: int = 20):
        self.C, self.gamma, self.count, self.seed, self.steps = C, gamma, count, seed, maxIter

    def _front(self, rows: DataFrame) -> DataFrame:
        names = [f"__x{j}" for j in range(self.width)]
        wide = rows.withColumn("__a", vector_to_array("features")).select("*", *[F.get("__a", F.lit(j)).alias(c) for j, c in enumerate(names)])
        wide = random_features(wide, names, self.count, self.gamma or 1.0 / self.width, self.seed)
        lifted = [f"rff_{j}" for j in range(self.count)]
        return VectorAssembler(inputCols=lifted, outputCol="__rff").transform(wide).drop("__a", *names, *lifted)

    def fit(self, rows: DataFrame) -> "KernelSVC":
        self.width = rows.select(F.size(vector_to_array("features"))).first()[0]
        lifted = scratch.table(self._front(rows).select("__rff", "label"), "lifted")
        n = max(1, lifted.count())
        # The penalty of the whole, C, as one of the mean loss.
        machine = OneVsRest(classifier=LinearSVC(maxIter=self.steps, regParam=1.0 / (self.C * n)), labelCol="label", featuresCol="__rff")
        self.model = machine.fit(lifted)
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(self._front(rows)).drop("__rff")


CLASSIFIERS["svc"] = lambda **k: KernelSVC(**k)
CLASSIFIERS["linear_svc"] = lambda **k: OneVsRest(classifier=LinearSVC(**({"maxIter": 20, "regParam": 0.1} | k)), labelCol="label")


def search_classifier(name: str, train: DataFrame, test: DataFrame, features: list[str], space: dict[str, list], label: str = "trend", most: int | None = None, seed: int = 42) -> tuple[DataFrame, dict]:
    """(every choice's accuracy on test rows, the best choice): one fit a choice, of equal ones the first."""
    rows = []
    for choice in grid(space, most, seed):
        out, failed = train_classifiers(train, test, features, [name], label, {name: choice})
        accuracy = None if failed else out.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))).first()[0]
        rows.append((choice, accuracy))
    best = max(rows, key=lambda r: -1.0 if r[1] is None else r[1])[0]
    named = [(", ".join(f"{k}={v}" for k, v in c.items()), a) for c, a in rows]
    return train.sparkSession.createDataFrame(named, "choice string, accuracy double"), best


def model_parameters(name: str, config: dict | None = None, overrides: dict | None = None) -> dict:
    """Parameters of a model: the config's first section that has it, then overrides.

    Sections in order: model_hyperparameters (as regressor_name), model_zoo,
    advanced_models; of the latter two what stands under params, if there is
    such an entry.
    """
    config = config or {}
    own = config.get("model_hyperparameters", {}).get(f"regressor_{name}") or {}
    for section in ("model_zoo", "advanced_models"):
        if not own:
            held = config.get(section, {}).get(name) or {}
            own = held.get("params", held)
    return own | (overrides or {})


def pca_features(rows: DataFrame, features: list[str], share: float | int) -> tuple[DataFrame, list[float]]:
    """rows with PCA_1 ...: gaps as 0, columns centred, signs by the largest loading; share below 1 is the variance to keep."""
    means = rows.agg(*[F.avg(F.coalesce(c, F.lit(0.0))).alias(c) for c in features]).first()
    centred = rows.withColumns({f"__{c}": F.coalesce(F.col(c), F.lit(0.0)) - float(means[c] or 0.0) for c in features})
    vec = VectorAssembler(inputCols=[f"__{c}" for c in features], outputCol="__v").transform(centred)
    model = PCA(k=len(features) if share < 1 else int(share), inputCol="__v", outputCol="__pc").fit(vec)
    kept = model.explainedVariance.toArray()
    k = int(np.searchsorted(np.cumsum(kept), share) + 1) if share < 1 else len(kept)
    load = model.pc.toArray()
    signs = np.sign(load[np.abs(load).argmax(0), np.arange(load.shape[1])])
    out = model.transform(vec).withColumn("__a", vector_to_array("__pc"))
    out = out.select(*rows.columns, *[(F.get("__a", F.lit(j)) * float(signs[j])).alias(f"PCA_{j + 1}") for j in range(k)])
    return out, kept[:k].tolist()
