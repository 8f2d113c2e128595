"""Lag and rolling features, scaling, and rules on feature names."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from tallow.functions.quantiles import quantiles
from tallow.functions.windows import series

RESERVED = ("Datetime", "Ticker", "Date")
OHLCV = ("Open", "High", "Low", "Close", "Volume")
FUNCTIONS = ("mean", "std", "var", "min", "max", "median", "skew", "kurt")


def numeric_columns(df: DataFrame) -> list[str]:
    """All numeric columns but the reserved."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in RESERVED]


def lag_features(df: DataFrame, lags: list[int], columns: list[str], scale_free: bool = False, base_price: str | None = None) -> DataFrame:
    """{col}_lag_{k} per ticker; raw prices and volume are left out if scale_free, other prices than base_price if that is given."""
    if scale_free:
        columns = [c for c in columns if c not in OHLCV]
    if base_price:
        columns = [c for c in columns if c == base_price or c not in OHLCV]
    return df.select("*", *[F.lag(c, k).over(series()).alias(f"{c}_lag_{k}") for c in columns for k in lags])


def rolling(col: str, window: int, fn: str) -> Column:
    """fn over the window rows before the current one, from one value on."""
    w = series().rowsBetween(-window, -1)
    x = F.col(col)
    n = F.count(x).over(w)
    flat = F.max(x).over(w) == F.min(x).over(w)
    return {
        "mean": lambda: F.avg(x).over(w),
        "std": lambda: F.stddev_samp(x).over(w),
        "var": lambda: F.var_samp(x).over(w),
        "min": lambda: F.min(x).over(w),
        "max": lambda: F.max(x).over(w),
        "median": lambda: F.percentile(x, F.lit(0.5)).over(w),
        "skew": lambda: F.when(n >= 3, F.when(flat, 0.0).otherwise(F.skewness(x).over(w) * F.sqrt(n * (n - 1)) / (n - 2))),
        "kurt": lambda: F.when(n >= 4, F.when(flat, -3.0).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x).over(w) + 6))),
    }[fn]()


def rolling_features(df: DataFrame, windows: list[int], functions: list[str], columns: list[str]) -> DataFrame:
    """{col}_rolling_{w}_{fn}: one frame does the window and the one-row shift."""
    return df.select("*", *[rolling(c, w, f).alias(f"{c}_rolling_{w}_{f}") for c in columns for w in windows for f in functions])


def close_features(df: DataFrame, lags: list[int], windows: list[int]) -> DataFrame:
    """Features of the close alone, each as of the row before."""
    lag = lambda k: F.lag("Close", k).over(series())
    out = {f"Close_lag_{k}": lag(k) for k in lags}
    out |= {f"Close_return_{k}": F.try_divide(lag(1), lag(k + 1)) - 1 for k in (1, 5, 10)}
    ratio = F.try_divide(lag(1), lag(2))
    out["Close_log_return"] = F.when(ratio > 0, F.ln(ratio))
    for w in windows:
        out[f"Close_rolling_mean_{w}"] = rolling("Close", w, "mean")
        out[f"Close_rolling_std_{w}"] = rolling("Close", w, "std")
    if len(windows) >= 2:
        out["Close_ma_ratio"] = F.try_divide(rolling("Close", windows[0], "mean"), rolling("Close", windows[-1], "mean"))
    out["Close_ROC_10"] = F.try_divide(lag(1) - lag(11), lag(11)) * 100
    out["Close_momentum_10"] = lag(1) - lag(11)
    out["Close_acceleration"] = (lag(1) - lag(2)) - (lag(2) - lag(3))
    return df.select("*", *[v.alias(k) for k, v in out.items()])


def price_vector(history: Column, lags: list[int], windows: list[int]) -> dict[str, Column]:
    """Features of a price array, oldest first, for one step ahead; short histories fall back to their last price or 0."""
    n = F.size(history)
    at = lambda k: F.get(history, n - k)
    last = at(1)
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    tail = lambda w: F.slice(history, F.greatest(n - w + 1, F.lit(1)), F.lit(w))
    std = lambda x: F.sqrt(F.aggregate(F.transform(x, lambda v: (v - mean(x)) * (v - mean(x))), F.lit(0.0), lambda s, v: s + v) / F.size(x))
    back = lambda k: F.try_divide(at(1) - at(k + 1), at(k + 1))
    out = {f"lag_{k}": F.when(n >= k, at(k)).otherwise(last) for k in lags}
    out |= {f"return_{k}": F.coalesce(F.when(n > k, back(k)), F.lit(0.0)) for k in (1, 5, 10)}
    out["log_return"] = F.coalesce(F.when((n > 1) & (at(1) > 0) & (at(2) > 0), F.ln(at(1) / F.when(at(2) != 0, at(2)))), F.lit(0.0))
    for w in windows:
        out[f"rolling_mean_{w}"], out[f"rolling_std_{w}"] = mean(tail(w)), std(tail(w))
    out["ma_ratio"] = F.coalesce(F.try_divide(mean(tail(windows[0])), mean(tail(windows[-1]))), F.lit(1.0))
    out["ROC_10"] = F.coalesce(F.when(n >= 12, 100 * F.try_divide(at(2) - at(12), at(12))), F.lit(0.0))
    out["momentum_10"] = F.when(n >= 12, at(2) - at(12)).otherwise(0.0)
    out["acceleration"] = F.when(n >= 3, (at(1) - at(2)) - (at(2) - at(3))).otherwise(0.0)
    return out


# Scaling -----------------------------------------------------------------


def fit_scaler(df: DataFrame, columns: list[str], method: str = "standard") -> DataFrame:
    """One row: {col}__shift and {col}__scale; a scale of 0 counts as 1.  robust: median and distance of the quartiles, exactly."""
    one = lambda s: F.when(s == 0, 1.0).otherwise(F.coalesce(s, F.lit(1.0)))
    aggs = []
    if method == "robust":
        found = quantiles(df, {c: (F.col(c), [0.25, 0.5, 0.75]) for c in columns})
        row = [v for c in columns for v in (found[c][1], 1.0 if found[c][0] in (None, found[c][2]) else found[c][2] - found[c][0])]
        return df.sparkSession.createDataFrame([row], ", ".join(f"`{c}__shift` double, `{c}__scale` double" for c in columns))
    for c in columns:
        x = F.col(c).cast("double")
        if method == "standard":
            shift, scale = F.avg(x), F.stddev_pop(x)
        elif method == "minmax":
            shift, scale = F.min(x), F.max(x) - F.min(x)
        else:
            raise ValueError(f"unknown scaler {method!r}")
        aggs += [shift.alias(f"{c}__shift"), one(scale).alias(f"{c}__scale")]
    return df.agg(*aggs)


def apply_scaler(df: DataFrame, params: DataFrame, columns: list[str], inverse: bool = False) -> DataFrame:
    """columns scaled by a fitted row, or back."""
    wide = df.crossJoin(F.broadcast(params))  # params is one row
    scaled = {c: (F.col(c) * F.col(f"{c}__scale") + F.col(f"{c}__shift")) if inverse else (F.col(c) - F.col(f"{c}__shift")) / F.col(f"{c}__scale") for c in columns}
    return wide.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def fit_step_scaler(rows: DataFrame, steps: int) -> DataFrame:
    """One row: arrays y__shift and y__scale with the mean and population deviation of each step of y; a scale of 0 counts as 1."""
    each = [F.get("y", F.lit(k)) for k in range(steps)]
    one = lambda s: F.when(s == 0, 1.0).otherwise(F.coalesce(s, F.lit(1.0)))
    return rows.agg(F.array(*map(F.avg, each)).alias("y__shift"), F.array(*[one(F.stddev_pop(y)) for y in each]).alias("y__scale"))


def apply_step_scaler(rows: DataFrame, params: DataFrame, inverse: bool = False, name: str = "y") -> DataFrame:
    """The array column name scaled step by step, or back."""
    wide = rows.crossJoin(F.broadcast(params))  # params is one row
    pairs = F.arrays_zip(F.col("y__shift").alias("m"), F.col("y__scale").alias("s"))
    value = F.zip_with(name, pairs, lambda v, p: v * p["s"] + p["m"] if inverse else (v - p["m"]) / p["s"])
    return wide.select(*[value.alias(name) if c == name else F.col(c) for c in rows.columns])


@dataclass
class FeaturePipeline:
    """Lag and rolling features of some columns, scaled by what training rows gave; new rows are transformed with what was stored."""

    columns: list[str]
    lags: list[int]
    windows: list[int]
    functions: list[str]
    method: str = "standard"
    params: dict[str, float] | None = None

    def names(self) -> list[str]:
        return [f"{c}_lag_{k}" for c in self.columns for k in self.lags] + [f"{c}_rolling_{w}_{f}" for c in self.columns for w in self.windows for f in self.functions]

    def _features(self, df: DataFrame) -> DataFrame:
        return rolling_features(lag_features(df, self.lags, self.columns), self.windows, self.functions, self.columns)

    def fit(self, train: DataFrame) -> "FeaturePipeline":
        self.params = fit_scaler(self._features(train), self.names(), self.method).first().asDict()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """df with the scaled features."""
        return self._features(df).withColumns({c: (F.col(c) - float(self.params[f"{c}__shift"])) / float(self.params[f"{c}__scale"]) for c in self.names()})

    def transform_new(self, new: DataFrame, context: DataFrame) -> DataFrame:
        """The scaled features of new rows; of context only each ticker's last rows, as many as a feature looks back, are used."""
        reach = max([*self.lags, *self.windows])
        back = Window.partitionBy("Ticker").orderBy(F.desc("Datetime"))
        tail = context.withColumn("__k", F.row_number().over(back)).where(F.col("__k") <= reach).drop("__k")
        both = tail.withColumn("__new", F.lit(False)).unionByName(new.withColumn("__new", F.lit(True)))
        return self.transform(both).where("__new").drop("__new")

    def summary(self) -> dict:
        return {"columns": len(self.columns), "features": len(self.names()), "fitted": self.params is not None, "method": self.method}

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "FeaturePipeline":
        return cls(**json.loads(text))


def fit_means(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row of training means for impute()."""
    return train.agg(*[F.avg(F.col(c)).alias(f"{c}__mean") for c in columns])


def impute(df: DataFrame, means: DataFrame, columns: list[str]) -> DataFrame:
    """Gaps filled with the training means, in any split."""
    wide = df.crossJoin(F.broadcast(means))  # means is one row
    return wide.select(*[F.coalesce(F.col(c), F.col(f"{c}__mean")).alias(c) if c in columns else F.col(c) for c in df.columns])


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Infinities and NaN are missing; rows that miss any of columns go."""
    out = df.withColumns({c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)) for c in columns})
    return out.dropna(subset=columns)


# Rules on names ----------------------------------------------------------

# Patterns of feature names by scale class, in order of precedence; case does not matter.
RULES: dict[str, tuple[str, ...]] = {
    "volume": ("^Volume$", "^Volume_", "_Volume_", "^obv$", "^vpt$", "^ad_line$", "^force_index", "^ease_of_movement"),
    "relative": (
        r"_return_\d+$", "^log_return", "^pct_return", "_log_return$", "_pct_return$", "_ratio", "^price_to_sma", "_normalized", "_zscore", "^zscore_", "_percentile", "_position",
        "^bb_width", "^keltner_width", "^donchian_width", r"^rsi_\d+$", "^stoch_[kd]$", "^stoch_rsi", r"^cci_\d+$", r"^mfi_\d+$", "^williams_r", r"^adx_\d+$", r"^di_(plus|minus)_\d+$",
        "^realized_vol", "^parkinson_vol", "^garman_klass", "^chaikin_vol", "^trend_strength", "^aroon_", "_return.*_rolling.*_std", "_acceleration$", "^price_acceleration", r"^roc_\d+$", r"_ROC_\d+$", "^cmf_", "^regime_", "^hurst_", "^fractal_dim",
    ),
    "absolute": (
        "^(Close|Open|High|Low|Adj Close)$", r"^(Close|Open|High|Low)_lag_\d+$", r"^(Close|Open|High|Low)_rolling_\d+_(mean|min|max|median)$", r"^(sma|ema|wma|dema|tema|kama|hma|vwma)_\d+$", r"^atr_\d+$", "^true_range$",
        r"^bb_(upper|lower)_\d+$", r"^(keltner|donchian)_(upper|lower)_\d+$", "^macd_(line|signal|hist)$", r"^momentum_\d+$", "^intraday_range$", "^gap_open_close$", r"^dpo_\d+$", r"^elder_ray_(bull|bear)_\d+$", "^awesome_osc$", r"^Close_momentum_\d+$",
    ),
}
PRICE_NAMES = ("Close", "Open", "High", "Low", "Adj Close")
#: What else a price gives its name to, as written, is of its scale.
PRICE_PREFIX = f"^({'|'.join(PRICE_NAMES)})_"
# Prefixes of indicators in price units, and what makes them safe anywhere in the name.
ABSOLUTE_PREFIXES = ("sma_", "ema_", "wma_", "vwma_", "hma_", "dema_", "tema_", "kama_", "true_range", "atr_", "momentum_", "macd_", "elder_ray_", "awesome_osc", "dpo_", "gap_open_close", "intraday_range")
SCALE_FREE_PARTS = ("_ratio", "_normalized", "_pct", "_percent", "_width", "_position")
# Parts of names that speak of the future, and of names of features that look back.
FUTURE = ("_t+", "_future", "_next", "_forward", "_ahead")
BACKWARD = ("_lag_", "_return_", "_rolling_", "_ma_ratio_", "_ROC_", "_momentum_", "_acceleration")


def classify(names: DataFrame, name: str = "name") -> DataFrame:
    """names with scale: volume, relative, absolute or other, by the first class with a pattern that the name matches."""
    n = F.col(name)
    found = F.when(n.rlike(PRICE_PREFIX), "absolute").otherwise("other")
    for scale in reversed(RULES):
        found = F.when(n.rlike(f"(?i){'|'.join(RULES[scale])}"), scale).otherwise(found)
    return names.withColumn("scale", found)


def scale_of(name: str) -> str:
    found = next((s for s, patterns in RULES.items() if re.search("|".join(patterns), name, re.I)), None)
    return found or ("absolute" if re.search(PRICE_PREFIX, name) else "other")


def keep_scale_free(df: DataFrame, base: str = "Close") -> DataFrame:
    """Columns of absolute scale go; the base price, reserved and all other columns stay."""
    return df.select(*[c for c in df.columns if c in (*RESERVED, base) or scale_of(c) != "absolute"])


def scale_free_indicators(names: list[str]) -> list[str]:
    """Names without an absolute prefix, or with a safe part anywhere."""
    return [n for n in names if not n.startswith(ABSOLUTE_PREFIXES) or any(s in n for s in SCALE_FREE_PARTS)]


def of_base_price(columns: list[str], base: str = "Close") -> list[str]:
    """Columns that no other price gives its name to."""
    others = [p for p in PRICE_NAMES if p != base]
    return [c for c in columns if not any(c == o or c.startswith(f"{o}_") for o in others)]


def indicators_of_base_price(inputs: dict[str, set[str]], base: str = "Close") -> dict[str, str]:
    """Of the indicators with these input columns those that need another price, with that price."""
    return {n: min(bad) for n, cols in inputs.items() if (bad := {c for c in cols if c in PRICE_NAMES and c != base})}


def prices_used(columns: list[str]) -> list[str]:
    """Prices that are, or give their names to, columns."""
    return [p for p in PRICE_NAMES if any(c == p or c.startswith(f"{p}_") for c in columns)]


def feature_set(columns: list[str]) -> list[str]:
    """Five close-only features or more: these; else all of the close; else the rest."""
    derived = [c for c in columns if c.startswith("Close_")]
    if len(derived) >= 5:
        return derived
    return derived or [c for c in columns if c != "Close"]


def leak_messages(names: DataFrame) -> DataFrame:
    """(name, level, message) of names that look into the future, are the raw target, or are of the close without looking back."""
    n = F.col("name")
    speaks = lambda parts, x: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(x, p))
    found = [
        (n == "Close", "ERROR", "the raw target is a feature"),
        (speaks(FUTURE, F.lower(n)), "ERROR", "the name speaks of the future"),
        (n.startswith("Close_") & ~speaks(BACKWARD, n), "WARNING", "a feature of the close that may not look back"),
    ]
    each = F.explode(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(level).alias("level"), F.lit(text).alias("message"))) for c, level, text in found])))
    return names.select("name", each.alias("m")).select("name", "m.level", "m.message")


def overlapping_targets(pairs: DataFrame, feature_time: str, target_time: str) -> int:
    """Rows whose target is not later than their features."""
    return pairs.where(F.col(target_time) <= F.col(feature_time)).count()


def first_row_gaps(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per ticker the share of columns that are null in its first row: under one half, something is not shifted."""
    first = df.withColumn("__r", F.row_number().over(series())).where("__r = 1")
    nulls = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return first.select("Ticker", (nulls / F.lit(len(columns))).alias("null_share"), (nulls * 2 >= len(columns)).alias("safe"))
