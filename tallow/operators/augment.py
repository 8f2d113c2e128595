"""Augmentation of training rows (key, features, y array); reproducible on any partitioning.

All randomness is drawn from MD5 of (seed, method, copy, row key), never from a
generator that runs along a partition.  Rows are numbered by ``idx``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallow.functions.quantiles import quantiles
from tallow.functions.recurrence import Affine, linear_recurrences

PRESETS = {"light": ["jitter", "scale"], "medium": ["jitter", "scale", "magnitude_warp"], "strong": ["jitter", "scale", "magnitude_warp", "trend_inject", "regime_noise"], "time": ["window_crop", "block_bootstrap"], "mix": ["mixup"], "tails": ["tail_augment"]}


def uniform(seed: int, tag: str, *key: Column | str) -> Column:
    """In [0, 1), from 32 bits of MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def normal(seed: int, tag: str, *key: Column | str) -> Column:
    """Standard normal by Box and Muller."""
    a, b = uniform(seed, tag + "/a", *key), uniform(seed, tag + "/b", *key)
    return F.sqrt(-2 * F.ln(1 - a)) * F.cos(2 * math.pi * b)


def beta(a: float, seed: int, tag: str, *key: Column | str) -> Column:
    """Beta(a, a), exactly and without rejection: a point of the polar method for Beta(a + 1, a + 1), whose odds two powers of uniforms bring down to a."""
    u, v, p, q = (uniform(seed, f"{tag}/{c}", *key) for c in "uvpq")
    x = (1 + F.sqrt(1 - F.pow(1 - u, F.lit(2 / (2 * a + 1)))) * F.cos(2 * math.pi * v)) / 2
    z = F.ln(x / (1 - x)) + (F.ln(1 - p) - F.ln(1 - q)) / a
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(700.0)), F.lit(-700.0))))


def _stds(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of population deviations, 0 as 1."""
    return df.agg(*[F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.coalesce(F.stddev_pop(c), F.lit(1.0))).alias(f"{c}__std") for c in columns])


def _with(df: DataFrame, one: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(one))  # one row


def _put(df: DataFrame, old: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in old.columns])


def jitter(df: DataFrame, columns: list[str], sigma: float = 0.01, seed: int = 42, copy: int = 0) -> DataFrame:
    """Normal noise of sigma times each feature's deviation; y stays."""
    return _put(_with(df, _stds(df, columns)), df, {c: F.col(c) + sigma * F.col(f"{c}__std") * normal(seed, f"jitter/{copy}/{c}", "Ticker", "idx") for c in columns})


def scale(df: DataFrame, columns: list[str], low: float = 0.95, high: float = 1.05, seed: int = 42, copy: int = 0) -> DataFrame:
    """One factor per row."""
    f = low + (high - low) * uniform(seed, f"scale/{copy}", "Ticker", "idx")
    return _put(df, df, {c: F.col(c) * f for c in columns})


def window_crop(df: DataFrame, ratio: float = 0.9, seed: int = 42, copy: int = 0) -> DataFrame:
    """One contiguous block of int(ratio n) rows per ticker; a series whose block has under ten rows stays whole."""
    n = F.count("*").over(Window.partitionBy("Ticker"))
    size = F.floor(ratio * F.col("__n"))
    start = F.floor(uniform(seed, f"crop/{copy}", "Ticker") * (F.col("__n") - size + 1))
    kept = df.withColumn("__n", n).where((size < 10) | ((F.col("idx") >= start) & (F.col("idx") < start + size)))
    return kept.drop("__n")


def _ranked(df: DataFrame, seed: int, tag: str) -> DataFrame:
    w = Window.partitionBy("Ticker").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), "Ticker", F.col("idx").cast("string"))))
    return df.withColumn("__r", (F.row_number().over(w) - 1).cast("long"))


def mixup(df: DataFrame, columns: list[str], alpha: float = 0.2, seed: int = 42, copy: int = 0) -> DataFrame:
    """Each row mixed with its partner in a random permutation of its ticker; the row's weight is Beta(alpha, alpha), for X and y."""
    partner = _ranked(df, seed, f"mixup/{copy}").select("Ticker", F.col("__r").alias("idx"), *[F.col(c).alias(f"__{c}") for c in columns], F.col("y").alias("__y"))
    lam = beta(alpha, seed, f"mixup/l/{copy}", "Ticker", "idx")
    joined = df.join(partner.hint("merge"), ["Ticker", "idx"]).withColumn("__l", lam)
    mix = lambda a, b: F.col("__l") * a + (1 - F.col("__l")) * b
    new = {c: mix(F.col(c), F.col(f"__{c}")) for c in columns} | {"y": F.zip_with("y", "__y", mix)}
    return _put(joined, df, new)


def volatility_regime(df: DataFrame, columns: list[str], alpha: float = 0.1, beta: float = 0.85, seed: int = 42, copy: int = 0) -> DataFrame:
    """X times a volatility path v = 0.01 + alpha z^2 + beta v', its root over its mean, clipped to [0.5, 2]."""
    z = df.withColumn("__z", normal(seed, f"vol/{copy}", "Ticker", "idx"))
    z = z.withColumn("__z1", F.coalesce(F.lag("__z", 1).over(Window.partitionBy("Ticker").orderBy("idx")), F.lit(0.0)))
    path = linear_recurrences(z, [Affine("__v", f"CASE WHEN idx = 0 THEN 0.0 ELSE {beta!r} END", f"CASE WHEN idx = 0 THEN 1.0 ELSE 0.01 + {alpha!r} * __z1 * __z1 END")], order="idx")
    root = F.sqrt("__v")
    path = path.withColumn("__f", F.greatest(F.least(root / F.avg(root).over(Window.partitionBy("Ticker")), F.lit(2.0)), F.lit(0.5)))
    return _put(path, df, {c: F.col(c) * F.col("__f") for c in columns})


def block_bootstrap(df: DataFrame, block: int = 10, seed: int = 42, copy: int = 0) -> DataFrame:
    """Circular blocks of each ticker, cut to its length; a series under two blocks is resampled row by row."""
    n = df.groupBy("Ticker").agg(F.count("*").alias("__n"))
    size = F.when(F.col("__n") < 2 * block, 1).otherwise(block)
    places = n.select("Ticker", "__n", size.alias("__b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("__i"))
    start = F.floor(uniform(seed, f"boot/{copy}", "Ticker", F.floor(F.col("__i") / F.col("__b"))) * F.col("__n"))
    places = places.select("Ticker", F.col("__i"), F.pmod(start + F.col("__i") % F.col("__b"), F.col("__n")).cast("long").alias("idx"))
    out = places.hint("merge").join(df, ["Ticker", "idx"])
    return out.select(*[F.col("__i").alias("idx") if c == "idx" else F.col(c) for c in df.columns])


def trend_inject(df: DataFrame, columns: list[str], kind: str = "linear", magnitude: float = 0.1) -> DataFrame:
    """A trend over t in [0, 1] times the magnitude and each feature's deviation."""
    t = F.col("idx") / F.greatest(F.count("*").over(Window.partitionBy("Ticker")) - 1, F.lit(1))
    shape = {"linear": t, "quadratic": t * t, "sine": F.sin(2 * math.pi * t)}[kind]
    wide = _with(df.withColumn("__t", shape), _stds(df, columns))
    return _put(wide, df, {c: F.col(c) + magnitude * F.col("__t") * F.col(f"{c}__std") for c in columns})


def regime_noise(df: DataFrame, columns: list[str], low: float = 0.005, high: float = 0.03, window: int = 20, seed: int = 42, copy: int = 0) -> DataFrame:
    """Noise that grows with the local deviation of the row means, scaled to [low, high]."""
    w = Window.partitionBy("Ticker")
    mean = sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns)
    local = F.stddev_pop("__m").over(w.orderBy("idx").rowsBetween(-window, 0))
    wide = df.withColumn("__m", mean).withColumn("__v", local)
    wide = wide.withColumn("__s", low + (high - low) * F.coalesce(F.try_divide(F.col("__v") - F.min("__v").over(w), F.max("__v").over(w) - F.min("__v").over(w)), F.lit(0.0)))
    return _put(wide, df, {c: F.col(c) + F.col("__s") * normal(seed, f"regime/{copy}/{c}", "Ticker", "idx") for c in columns})


def tail_augment(df: DataFrame, columns: list[str], percentile: float = 0.1, amplify: float = 1.2) -> DataFrame:
    """Rows and again those whose largest |y| lies in either tail, pushed away from the feature means."""
    s = F.array_max(F.transform("y", F.abs))
    wide = df.withColumn("__s", s)
    low, high = quantiles(df, {"s": (s, [percentile, 1 - percentile])})["s"]
    means = df.agg(*[F.avg(c).alias(f"{c}__m") for c in columns])
    tails = _with(wide, means).where((F.col("__s") <= F.lit(low)) | (F.col("__s") >= F.lit(high)))
    return df.union(_put(tails, df, {c: F.col(f"{c}__m") + amplify * (F.col(c) - F.col(f"{c}__m")) for c in columns}))


def magnitude_warp(df: DataFrame, columns: list[str], knots: int = 4, low: float = 0.8, high: float = 1.2, seed: int = 42, copy: int = 0) -> DataFrame:
    """X times a curve through random knots over the series, linear in between."""
    n = F.count("*").over(Window.partitionBy("Ticker"))
    at = F.col("idx") / F.greatest(n - 1, F.lit(1)) * (knots - 1)
    k = F.least(F.floor(at), F.lit(knots - 2))
    u = lambda j: low + (high - low) * uniform(seed, f"warp/{copy}", "Ticker", j)
    wide = df.withColumns({"__at": at}).withColumn("__k", k)
    curve = u(F.col("__k")) + (u(F.col("__k") + 1) - u(F.col("__k"))) * (F.col("__at") - F.col("__k"))
    return _put(wide, df, {c: F.col(c) * curve for c in columns})


METHODS = {
    "jitter": "normal noise in proportion to each feature's deviation", "scale": "one random factor per row", "window_crop": "a random contiguous block", "mixup": "rows mixed with random partners",
    "volatility_regime": "a clustered volatility path", "block_bootstrap": "random blocks in a new order", "frequency_mask": "a band of the spectrum at zero", "pattern_morph": "rows moved toward near ones",
    "trend_inject": "an added trend", "regime_noise": "noise that grows with volatility", "tail_augment": "extreme rows pushed further out", "feature_rotation": "a small turn among principal components",
    "smote": "new rows between near ones of one target range", "magnitude_warp": "a random smooth factor over time",
}


def methods(spark: SparkSession) -> DataFrame:
    """(method, description)."""
    return spark.createDataFrame(sorted(METHODS.items()), "method string, description string")


def summary(spark: SparkSession, chosen: list[str], copies: int = 1, enabled: bool = True) -> DataFrame:
    """One row: enabled, methods, copies and by how much rows are expected to multiply."""
    used = chosen if enabled else []
    row = (enabled, ",".join(used), copies if enabled else 0, 1 + len(used) * copies if enabled else 1)
    return spark.createDataFrame([row], "enabled boolean, methods string, copies int, expected_multiplier int")


def compare(train: DataFrame, columns: list[str], score: Callable[[DataFrame], DataFrame], chosen: list[str], seed: int = 42) -> DataFrame:
    """(method, rmse, mae, r2, place): none and each method alone, as score (one row: rmse, mae, r2) judges a model of those rows; best rmse first, of equal ones the greater r2."""
    runs = [("none", train)] + [(m, augment(train, columns, [m], seed=seed).drop("method", "copy")) for m in chosen]
    rows = [(m, *score(rows).select("rmse", "mae", "r2").first()) for m, rows in runs]  # a Spark job per method
    rows.sort(key=lambda r: (r[1], -r[3], r[0]))
    return train.sparkSession.createDataFrame([(*r, k + 1) for k, r in enumerate(rows)], "method string, rmse double, mae double, r2 double, place int")


def augment(df: DataFrame, columns: list[str], methods: list[str] | str, copies: int = 1, seed: int = 42, params: dict[str, dict] | None = None) -> DataFrame:
    """Originals first (method original), then each method's copies, tagged (method, copy).

    methods are names or the name of a preset; params has, by method, arguments that replace its defaults.
    """
    from tallow.operators import neighbours as N  # it imports this module

    makers = {"pattern_morph": N.pattern_morph, "jitter": jitter, "scale": scale, "mixup": mixup, "volatility_regime": volatility_regime, "regime_noise": regime_noise, "magnitude_warp": magnitude_warp}
    plain = {"window_crop": window_crop, "block_bootstrap": block_bootstrap}
    seeded = {"feature_rotation": N.feature_rotation, "smote": N.smote}
    tag = lambda d, m, k: d.withColumns({"method": F.lit(m), "copy": F.lit(k)})
    out = tag(df, "original", 0)
    methods = PRESETS[methods] if isinstance(methods, str) else methods
    if strange := set(params or {}) - set(METHODS):
        raise ValueError(f"unknown methods {sorted(strange)}")
    for m in methods:
        own = (params or {}).get(m, {})
        for k in range(copies):
            if m in makers:
                made = makers[m](df, columns, **{"seed": seed, "copy": k} | own)
            elif m in plain:
                made = plain[m](df, **{"seed": seed, "copy": k} | own)
            elif m in seeded:
                made = seeded[m](df, columns, **{"seed": seed + k} | own)
            else:
                made = {"trend_inject": trend_inject, "tail_augment": tail_augment, "frequency_mask": N.frequency_mask}[m](df, columns, **own)
            out = out.unionByName(tag(made, m, k))
    return out
