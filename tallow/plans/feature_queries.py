"""Ingest, features, targets, splits and scaling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallow.functions.windows import series
from tallow.operators import augment as A
from tallow.operators import features as X
from tallow.operators import indicators
from tallow.operators import prune as P
from tallow.operators import split as S
from tallow.operators import targets as Y
from tallow.operators.indicators import REGISTRY, compute, compute_sql
from tallow.functions.dialect import Duck
from tallow.plans.oracle import EVENT_CANDLES as EC
from tallow.plans.oracle import ORDER_CANDLES as OC
from tallow.sources import candles as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OVER = "(PARTITION BY Ticker ORDER BY Datetime)"


def _frame(lo: int, hi: int) -> str:
    return f"(PARTITION BY Ticker ORDER BY Datetime ROWS BETWEEN {lo} PRECEDING AND {hi} PRECEDING)"


def doubles_rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def query(name: str, sql: str | None, digits: int = 6):
    """Register a function (spark, sf_dir) -> DataFrame; its doubles are rounded, those of sql are by itself (R(x))."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: doubles_rounded(f(spark, sf_dir), digits)
        if sql is not None:
            out, at = "", 0
            while (k := sql.find("R(", at)) >= 0:  # R(x) AS c
                if k and (sql[k - 1].isalnum() or sql[k - 1] == "_"):
                    out, at = out + sql[at : k + 2], k + 2
                    continue
                depth, j = 1, k + 2
                while depth:
                    depth += {"(": 1, ")": -1}.get(sql[j], 0)
                    j += 1
                out, at = out + sql[at:k] + f"(round({sql[k + 2 : j - 1]}, {digits}) + 0.0)", j
            ORACLES[name] = out + sql[at:]
        return f

    return put


# Ingest --------------------------------------------------------------------


@query("kline_normalise", "SELECT event_type AS Ticker, date_trunc('millisecond', ts) AS Datetime, value AS Open, value AS High, value AS Low, value AS Close, CAST(user_id AS DOUBLE) AS Volume FROM events")
def kline_normalise(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = lambda c: F.col(c).cast("string")
    k = F.array(F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), *[text("value")] * 4, text("user_id"))
    out = C.normalise_klines(e.select("event_type", k.alias("k")), F.col("event_type"))
    return out.withColumn("Datetime", F.col("Datetime").cast("timestamp_ntz"))


@query("keep_last_chunk", f"WITH c AS ({EC}), u AS (SELECT *, 1 AS chunk FROM c UNION ALL SELECT Ticker, Datetime, Open + 1, High + 1, Low + 1, Close + 1, Volume, 2 FROM c WHERE hour(Datetime) < 12) SELECT Ticker, Datetime, Open, High, Low, Close, Volume FROM (SELECT *, row_number() OVER (PARTITION BY Ticker, Datetime ORDER BY chunk DESC) AS r FROM u) WHERE r = 1")
def keep_last_chunk(spark, sf_dir):
    c = C.event_candles(spark, sf_dir)
    later = c.where(F.hour("Datetime") < 12).select("Ticker", "Datetime", *[(F.col(x) + 1).alias(x) for x in ("Open", "High", "Low", "Close")], "Volume")
    return C.keep_last(C.combine([c.withColumn("chunk", F.lit(1)), later.withColumn("chunk", F.lit(2))]))


@query("clamp_history", f"SELECT c.* FROM ({EC}) c JOIN (SELECT Ticker, max(Datetime) AS m FROM ({EC}) GROUP BY 1) USING (Ticker) WHERE Datetime >= m - INTERVAL 6 DAY")
def clamp_history(spark, sf_dir):
    return C.clamp_history(C.event_candles(spark, sf_dir), "1m")


@query("combine_assets", f"{EC} UNION ALL {OC}")
def combine_assets(spark, sf_dir):
    return C.combine([C.event_candles(spark, sf_dir), C.order_candles(spark, sf_dir)])


@query("asset_summary", f"SELECT Ticker, count(*) AS n_rows, min(Datetime) AS first_time, max(Datetime) AS last_time, 'Ticker,Datetime,Open,High,Low,Close,Volume' AS columns FROM ({EC}) GROUP BY 1")
def asset_summary(spark, sf_dir):
    return C.summary(C.event_candles(spark, sf_dir))


@query("symbols", '''SELECT raw, category, CASE WHEN category <> 'crypto' THEN upper(split_part(raw, ':', 1)) WHEN suffix(raw, '-USD') OR suffix(raw, '-USDT') THEN upper(raw) ELSE upper(raw) || '-USD' END AS ticker,
  replace(replace(upper(raw), '-USD', ''), '-USDT', '') || 'USDT' AS pair
FROM (SELECT DISTINCT CASE c_custkey % 5 WHEN 0 THEN 'btc' WHEN 1 THEN c_mktsegment || ':NYSE' WHEN 2 THEN 'eth-USD' WHEN 3 THEN lower(c_mktsegment) ELSE 'Sol-USDT' END AS raw, CASE WHEN c_custkey % 5 IN (1, 3) THEN 'stock' ELSE 'crypto' END AS category FROM customer)''')
def symbols(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    m = F.col("c_custkey") % 5
    raw = F.when(m == 0, "btc").when(m == 1, F.concat("c_mktsegment", F.lit(":NYSE"))).when(m == 2, "eth-USD").when(m == 3, F.lower("c_mktsegment")).otherwise("Sol-USDT")
    out = c.select(raw.alias("raw"), F.when(m.isin(1, 3), "stock").otherwise("crypto").alias("category")).distinct()
    return out.select("raw", "category", *[v.alias(k) for k, v in C.symbol_columns(F.col("raw"), F.col("category")).items()])


@query("candles_by_interval", f"SELECT Ticker, date_trunc('day', Datetime) AS Datetime, first(Open ORDER BY Datetime) AS Open, max(High) AS High, min(Low) AS Low, last(Close ORDER BY Datetime) AS Close, sum(Volume) AS Volume FROM ({EC}) GROUP BY ALL")
def candles_by_interval(spark, sf_dir):
    return C.event_candles(spark, sf_dir, bucket=C.BUCKETS[C.interval("1day")])


# Features ------------------------------------------------------------------

_LAGS, _WINDOWS = [1, 2, 5, 10], [5, 20]


@query("lag_features", f"SELECT Ticker, Datetime, {', '.join(f'R(lag({c}, {k}) OVER {OVER}) AS {c}_lag_{k}' for c in ('Close', 'Volume') for k in _LAGS)} FROM ({EC})")
def lag_features(spark, sf_dir):
    c = C.event_candles(spark, sf_dir)
    out = X.lag_features(c, _LAGS, ["Close", "Volume"])
    return out.select("Ticker", "Datetime", *out.columns[len(c.columns) :])


_DUCK_FN = {"mean": "avg({x}) OVER {w}", "std": "stddev_samp({x}) OVER {w}", "var": "var_samp({x}) OVER {w}", "min": "min({x}) OVER {w}", "max": "max({x}) OVER {w}", "median": "median({x}) OVER {w}",
            "skew": "CASE WHEN count({x}) OVER {w} >= 3 THEN CASE WHEN max({x}) OVER {w} = min({x}) OVER {w} THEN 0.0 ELSE skewness({x}) OVER {w} END END",
            "kurt": "CASE WHEN count({x}) OVER {w} >= 4 THEN CASE WHEN max({x}) OVER {w} = min({x}) OVER {w} THEN -3.0 ELSE kurtosis({x}) OVER {w} END END"}

for _fn, _text in _DUCK_FN.items():

    def _rolling(spark, sf_dir, fn=_fn):
        c = C.event_candles(spark, sf_dir)
        out = X.rolling_features(c, _WINDOWS, [fn], ["Close", "Volume"])
        return out.select("Ticker", "Datetime", *out.columns[len(c.columns) :])

    query(f"rolling_{_fn}", f"SELECT Ticker, Datetime, {', '.join('R(' + _text.format(x=c, w=_frame(w, 1)) + f') AS {c}_rolling_{w}_{_fn}' for c in ('Close', 'Volume') for w in _WINDOWS)} FROM ({EC})")(_rolling)


def _l(k: int) -> str:
    return f"lag(Close, {k}) OVER {OVER}"


_CLOSE_SQL = ", ".join(
    [f"R({_l(k)}) AS Close_lag_{k}" for k in (1, 2)]
    + [f"R({_l(1)} / nullif({_l(k + 1)}, 0) - 1) AS Close_return_{k}" for k in (1, 5, 10)]
    + [f"R(CASE WHEN {_l(1)} / nullif({_l(2)}, 0) > 0 THEN ln({_l(1)} / nullif({_l(2)}, 0)) END) AS Close_log_return"]
    + [f"R({f}(Close) OVER {_frame(w, 1)}) AS Close_rolling_{n}_{w}" for w in _WINDOWS for n, f in (("mean", "avg"), ("std", "stddev_samp"))]
    + [f"R(avg(Close) OVER {_frame(5, 1)} / nullif(avg(Close) OVER {_frame(20, 1)}, 0)) AS Close_ma_ratio", f"R(100 * ({_l(1)} - {_l(11)}) / nullif({_l(11)}, 0)) AS Close_ROC_10", f"R({_l(1)} - {_l(11)}) AS Close_momentum_10",
       f"R(({_l(1)} - {_l(2)}) - ({_l(2)} - {_l(3)})) AS Close_acceleration"]
)


@query("close_features", f"SELECT Ticker, Datetime, {_CLOSE_SQL} FROM ({EC})")
def close_features(spark, sf_dir):
    c = C.event_candles(spark, sf_dir)
    out = X.close_features(c, [1, 2], _WINDOWS)
    return out.select("Ticker", "Datetime", *out.columns[len(c.columns) :])


@query("price_vector", f"""SELECT Ticker, Datetime, R(h[-1]) AS lag_1, R(h[-3]) AS lag_3, R((h[-1] - h[-2]) / nullif(h[-2], 0)) AS return_1, R(list_avg(h[-5:])) AS rolling_mean_5, R(list_stddev_pop(h[-5:])) AS rolling_std_5,
  R(list_avg(h[-5:]) / nullif(list_avg(h[-20:]), 0)) AS ma_ratio, R(100 * (h[-2] - h[-12]) / nullif(h[-12], 0)) AS ROC_10, R(h[-2] - h[-12]) AS momentum_10, R(h[-1] - 2 * h[-2] + h[-3]) AS acceleration
FROM (SELECT Ticker, Datetime, list(Close) OVER {_frame(29, 0).replace('0 PRECEDING)', 'CURRENT ROW)')} AS h FROM ({EC})) WHERE len(h) = 30""")
def price_vector(spark, sf_dir):
    c = C.event_candles(spark, sf_dir).withColumn("h", F.collect_list("Close").over(series().rowsBetween(-29, 0))).where(F.size("h") == 30)
    v = X.price_vector(F.col("h"), [1, 3], [5, 20])
    names = ["lag_1", "lag_3", "return_1", "rolling_mean_5", "rolling_std_5", "ma_ratio", "ROC_10", "momentum_10", "acceleration"]
    return c.select("Ticker", "Datetime", *[v[n].alias(n) for n in names])


for _m, (_a, _b) in {"standard": ("avg({c})", "stddev_pop({c})"), "minmax": ("min({c})", "max({c}) - min({c})"), "robust": ("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)")}.items():

    def _scaled(spark, sf_dir, method=_m):
        c = C.event_candles(spark, sf_dir)
        return X.apply_scaler(c, X.fit_scaler(c, ["Close", "Volume"], method), ["Close", "Volume"]).select("Ticker", "Datetime", "Close", "Volume")

    _one = {c: f"CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END" for c in ("Close", "Volume")}
    query(f"scale_{_m}", f"SELECT Ticker, Datetime, R((Close - a_Close) / {_one['Close']}) AS Close, R((Volume - a_Volume) / {_one['Volume']}) AS Volume FROM ({EC}), (SELECT {', '.join(f'{_a.format(c=c)} AS a_{c}, {_b.format(c=c)} AS s_{c}' for c in ('Close', 'Volume'))} FROM ({EC}))")(_scaled)


@query("impute_train_means", f"SELECT Ticker, Datetime, R(coalesce(x, m)) AS x FROM (SELECT *, lag(Close, 3) OVER {OVER} AS x, row_number() OVER {OVER} AS i, count(*) OVER (PARTITION BY Ticker) AS n FROM ({EC})), (SELECT avg(x) AS m FROM (SELECT lag(Close, 3) OVER {OVER} AS x, row_number() OVER {OVER} AS i, count(*) OVER (PARTITION BY Ticker) AS n FROM ({EC})) WHERE i - 1 < floor(n * 0.8))")
def impute_train_means(spark, sf_dir):
    c = S.time_split(C.event_candles(spark, sf_dir).withColumn("x", F.lag("Close", 3).over(series())), 0.2)
    return X.impute(c, X.fit_means(c.where("split = 'train'"), ["x"]), ["x"]).select("Ticker", "Datetime", "x")


@query("drop_incomplete", f"SELECT * FROM (SELECT Ticker, Datetime, R(ln(Close)) AS x FROM ({EC}) WHERE Close > 0)")
def drop_incomplete(spark, sf_dir):
    c = C.event_candles(spark, sf_dir).select("Ticker", "Datetime", F.when(F.col("Close") == 0, F.lit(float("-inf"))).otherwise(F.ln(F.when(F.col("Close") > 0, F.col("Close")))).alias("x"))
    return X.drop_incomplete(c, ["x"])


# Written by hand from the rules' meaning, not made from them: the class of every indicator that is not "other".
_SCALES = """absolute: sma_5 sma_10 sma_20 sma_50 sma_200 ema_5 ema_10 ema_20 ema_50 ema_200 wma_20 vwma_20 hma_20 dema_20 tema_20 kama_10 kama_20 atr_14 true_range momentum_10 momentum_20 intraday_range
gap_open_close dpo_20 elder_ray_bull_13 elder_ray_bear_13 awesome_osc
relative: log_return_1 log_return_5 log_return_10 pct_return_1 pct_return_5 pct_return_10 realized_vol_5 realized_vol_10 realized_vol_20 zscore_close_5 zscore_close_10 zscore_close_20 price_acceleration
sma_5_ratio sma_10_ratio sma_20_ratio sma_50_ratio sma_200_ratio ema_5_ratio ema_10_ratio ema_20_ratio ema_50_ratio ema_200_ratio price_to_sma_20_ratio price_to_ema_20_ratio atr_normalized_14 keltner_width_20
keltner_position_20 donchian_width_20 donchian_position_20 parkinson_volatility_20 garman_klass_volatility_20 chaikin_volatility_10 rsi_14 rsi_28 stoch_rsi_14 cci_20 williams_r_14 roc_10 roc_20 adx_14 aroon_up_25
aroon_down_25 aroon_osc_25 mfi_14 cmf_20 body_to_range_ratio hurst_100 skew_return_20 kurt_return_20
volume: obv ad_line force_index_13 volume_roc_10 volume_zscore_20 volume_spike_20"""
_CLOSE_SCALES = """absolute: Close Open High Low Close_lag_5 Close_rolling_20_mean Close_rolling_20_std Close_rolling_std_20 Close_momentum_10 High_x
relative: Close_return_5 Close_log_return Close_ma_ratio Close_ROC_10 Close_acceleration
volume: Volume Volume_lag_1
other: Datetime high_x Ticker"""


def _scale_rows(text: str) -> str:
    scale, rows = "", []
    for word in text.split():
        scale, rows = (word[:-1], rows) if word.endswith(":") else (scale, [*rows, f"('{word}', '{scale}')"])
    return ", ".join(rows)


_ENDS = ["_lag_5", "_rolling_20_mean", "_ratio", "_t+1", "_future_x", "_volume"]
_COLUMN_SQL = f"SELECT DISTINCT event_type || s AS name FROM events, (SELECT unnest({_ENDS}) AS s)"
_ALL_NAMES = ", ".join(f"('{n}')" for n in REGISTRY.indicators)


def _event_names(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct()
    return e.select("event_type", F.explode(F.array(*map(F.lit, _ENDS))).alias("s")).select(F.concat("event_type", "s").alias("name"))


@query("classify_features", f"""WITH known(name, scale) AS (VALUES {_scale_rows(_SCALES)}), own(name, scale) AS (VALUES {_scale_rows(_CLOSE_SCALES)})
SELECT name, CASE WHEN suffix(name, '_ratio') THEN 'relative' ELSE 'other' END AS scale FROM ({_COLUMN_SQL})
UNION ALL SELECT n.name, coalesce(known.scale, 'other') AS scale FROM (VALUES {_ALL_NAMES}) n(name) LEFT JOIN known USING (name) UNION ALL SELECT * FROM own""")
def classify_features(spark, sf_dir):
    own = [w for w in _CLOSE_SCALES.split() if not w.endswith(":")]
    return X.classify(_event_names(spark, sf_dir).union(spark.createDataFrame([(n,) for n in [*REGISTRY.indicators, *own]], "name string")))


@query("leak_rules", f"""WITH n AS (SELECT name FROM ({_COLUMN_SQL}) UNION ALL SELECT unnest(['Close', 'Close_lag_1', 'Close_ma_ratio', 'Close_log_return', 'Close_ROC_10', 'Close_x_ahead']))
SELECT name, 'ERROR' AS level, 'the name speaks of the future' AS message FROM n WHERE contains(name, '_t+') OR contains(name, '_future') OR contains(name, '_ahead')
UNION ALL SELECT 'Close', 'ERROR', 'the raw target is a feature' UNION ALL SELECT unnest(['Close_ma_ratio', 'Close_log_return', 'Close_x_ahead']), 'WARNING', 'a feature of the close that may not look back'""")
def leak_rules(spark, sf_dir):
    own = spark.createDataFrame([(n,) for n in ("Close", "Close_lag_1", "Close_ma_ratio", "Close_log_return", "Close_ROC_10", "Close_x_ahead")], "name string")
    return X.leak_messages(_event_names(spark, sf_dir).union(own))


_GAP = ["pct_return_1", "rsi_14", "sma_20", "atr_14"]


@query("first_row_gaps", f"SELECT Ticker, R((CASE WHEN pct_return_1 IS NULL THEN 1 ELSE 0 END + CASE WHEN rsi_14 IS NULL THEN 1 ELSE 0 END + CASE WHEN sma_20 IS NULL THEN 1 ELSE 0 END + CASE WHEN atr_14 IS NULL THEN 1 ELSE 0 END) / 4.0) AS null_share, true AS safe FROM ({compute_sql(EC, _GAP, Duck())}) QUALIFY row_number() OVER {OVER} = 1")
def first_row_gaps(spark, sf_dir):
    return X.first_row_gaps(compute(C.event_candles(spark, sf_dir), _GAP), _GAP)


@query("pipeline_features", f"SELECT Ticker, Datetime, R(sma_20_ratio) AS sma_20_ratio, R(rsi_14) AS rsi_14 FROM ({compute_sql(EC, ['sma_20_ratio', 'rsi_14'], Duck())})")
def pipeline_features(spark, sf_dir):
    out = compute(C.event_candles(spark, sf_dir), ["sma_20", "sma_20_ratio", "rsi_14"])
    return X.keep_scale_free(out).select("Ticker", "Datetime", "sma_20_ratio", "rsi_14")


# Targets -------------------------------------------------------------------

_Y = lambda k: f"lead(Close, {k}) OVER {OVER}"


@query("multistep_targets", f"SELECT * FROM (SELECT Ticker, Datetime, R({_Y(1)}) AS y1, R({_Y(2)}) AS y2, R({_Y(3)}) AS y3 FROM ({EC})) WHERE y3 IS NOT NULL")
def multistep_targets(spark, sf_dir):
    return Y.multistep_targets(C.event_candles(spark, sf_dir), 3).select("Ticker", "Datetime", *[F.get("y", F.lit(k)).alias(f"y{k + 1}") for k in range(3)])


@query("labelled_targets", f'SELECT Ticker, Datetime, R({_Y(1)}) AS t1, R({_Y(5)}) AS t5 FROM ({EC})')
def labelled_targets(spark, sf_dir):
    out = Y.labelled_targets(C.event_candles(spark, sf_dir), 5)
    return out.select("Ticker", "Datetime", F.col("`target_Close_t+1`").alias("t1"), F.col("`target_Close_t+5`").alias("t5"))


_BASE = "CASE WHEN Close = 0 THEN 1e-8 ELSE Close END"
for _t, _sql in {"pct_change": "({y} - {b}) / {b}", "log_return": "ln(greatest({y}, 1e-8) / greatest({b}, 1e-8))"}.items():

    def _to(spark, sf_dir, t=_t):
        y = Y.to_target(F.col("y"), t, F.col("Close"))
        return Y.multistep_targets(C.event_candles(spark, sf_dir), 3).select("Ticker", "Datetime", *[F.get(y, F.lit(k)).alias(f"y{k + 1}") for k in range(3)])

    query(f"to_target_{_t}", f"SELECT Ticker, Datetime, {', '.join(f'R({_sql.format(y=f'y{k}', b=_BASE)}) AS y{k}' for k in (1, 2, 3))} FROM (SELECT *, {', '.join(f'{_Y(k)} AS y{k}' for k in (1, 2, 3))} FROM ({EC})) WHERE y3 IS NOT NULL")(_to)

    def _back(spark, sf_dir, t=_t):
        y = Y.from_target(Y.to_target(F.col("y"), t, F.col("Close")), t, F.col("Close"))
        return Y.multistep_targets(C.event_candles(spark, sf_dir).where("Close > 0"), 3).select("Ticker", "Datetime", *[F.get(y, F.lit(k)).alias(f"y{k + 1}") for k in range(3)])

    query(f"from_target_{_t}", f"SELECT Ticker, Datetime, {', '.join(f'R(y{k}) AS y{k}' for k in (1, 2, 3))} FROM (SELECT *, {', '.join(f'{_Y(k)} AS y{k}' for k in (1, 2, 3))} FROM ({EC}) WHERE Close > 0) WHERE y3 IS NOT NULL")(_back)


@query("from_target_cumulative", f"SELECT Ticker, Datetime, R(Close * (1 + r1)) AS p1, R(Close * (1 + r1) * (1 + r2)) AS p2 FROM (SELECT *, Volume / 100 AS r1, -Volume / 200 AS r2 FROM ({EC}) WHERE Close > 0)")
def from_target_cumulative(spark, sf_dir):
    c = C.event_candles(spark, sf_dir).where("Close > 0")
    p = Y.from_target_cumulative(F.array(F.col("Volume") / 100, -F.col("Volume") / 200), "pct_change", F.col("Close"))
    return c.select("Ticker", "Datetime", F.get(p, F.lit(0)).alias("p1"), F.get(p, F.lit(1)).alias("p2"))


def _trend_sql(h: int, t: float) -> str:
    r = f"(lead(Close, {h}) OVER {OVER} - Close) / nullif(Close, 0)"
    return f"coalesce(CASE WHEN {r} > {t} THEN 2 WHEN {r} < -{t} THEN 0 ELSE 1 END, 1)"


@query("trend_labels", f"SELECT Ticker, Datetime, CAST({_trend_sql(5, 0.03)} AS INT) AS trend, CAST({_trend_sql(10, 0.02)} AS INT) AS trend_h10 FROM ({EC})")
def trend_labels(spark, sf_dir):
    c = Y.trend_labels(Y.trend_labels(C.event_candles(spark, sf_dir), 5, 0.03), 10, 0.02, "trend_h10")
    return c.select("Ticker", "Datetime", "trend", "trend_h10")


@query("ten_day_labels", f"SELECT Ticker, Datetime, R(r) AS change, CAST(CASE WHEN r >= 0.02 THEN 2 WHEN r <= -0.02 THEN 0 ELSE 1 END AS INT) AS trend FROM (SELECT *, (lead(Close, 10) OVER {OVER} - Close) / nullif(Close, 0) AS r FROM ({EC})) WHERE r IS NOT NULL")
def ten_day_labels(spark, sf_dir):
    return Y.ten_day_labels(C.event_candles(spark, sf_dir)).select("Ticker", "Datetime", "change", "trend")


# Splits and outliers ---------------------------------------------------------


@query("holdout_split", f"SELECT Ticker, Datetime, idx, CASE WHEN idx >= s THEN 'holdout' WHEN idx < greatest(s - 5, least(50, s)) THEN 'train' ELSE 'gap' END AS split FROM (SELECT *, row_number() OVER {OVER} - 1 AS idx, count(*) OVER (PARTITION BY Ticker) - 40 AS s FROM ({EC}))")
def holdout_split(spark, sf_dir):
    return S.holdout_split(C.event_candles(spark, sf_dir), 40, 5).select("Ticker", "Datetime", "idx", "split")


@query("time_split", f"SELECT Ticker, Datetime, CASE WHEN row_number() OVER {OVER} - 1 < floor(count(*) OVER (PARTITION BY Ticker) * 0.8) THEN 'train' ELSE 'test' END AS split FROM ({EC})")
def time_split(spark, sf_dir):
    return S.time_split(C.event_candles(spark, sf_dir), 0.2).select("Ticker", "Datetime", "split")


_SCORE = {"max_abs": "greatest(abs(y1), abs(y2))", "mean": "(y1 + y2) / 2", "max": "greatest(y1, y2)", "min": "least(y1, y2)"}
_KEEP = {"max_abs": "s <= h", "max": "s <= h", "min": "s >= l", "mean": "s >= l AND s <= h"}
for _how in _SCORE:

    def _outliers(spark, sf_dir, how=_how):
        c = Y.multistep_targets(C.event_candles(spark, sf_dir), 2).withColumn("y", Y.to_target(F.col("y"), "pct_change", F.col("Close") + 1))
        return S.outlier_filter(c, 0.95, how).select("Ticker", "Datetime", F.get("y", F.lit(0)).alias("y1"))

    _rows = f"SELECT Ticker, Datetime, (a - Close - 1) / (Close + 1) AS y1, (b - Close - 1) / (Close + 1) AS y2 FROM (SELECT *, {_Y(1)} AS a, {_Y(2)} AS b FROM ({EC})) WHERE b IS NOT NULL"
    query(f"outliers_{_how}", f"WITH t AS (SELECT *, {_SCORE[_how]} AS s FROM ({_rows})), q AS (SELECT quantile_cont(s, 0.05) AS l, quantile_cont(s, 0.95) AS h FROM t) SELECT Ticker, Datetime, R(y1) AS y1 FROM t, q WHERE {_KEEP[_how]}")(_outliers)


@query("postprocess_forecast", f"""SELECT Ticker, Datetime, R(p1) AS p1, R(greatest(least(greatest(b, p1 * 0.9), p1 * 1.1), 0.5 * Close)) AS p2 FROM
  (SELECT *, greatest(least(greatest(a, Close * 0.9), Close * 1.1), 0.5 * Close) AS p1 FROM (SELECT *, {_Y(1)} AS a, {_Y(2)} AS b FROM ({EC})) WHERE b IS NOT NULL)""")
def postprocess_forecast(spark, sf_dir):
    c = Y.multistep_targets(C.event_candles(spark, sf_dir), 2)
    p = S.postprocess(F.col("y"), F.col("Close"))
    return c.select("Ticker", "Datetime", F.get(p, F.lit(0)).alias("p1"), F.get(p, F.lit(1)).alias("p2"))


@query("sample_rows", f"""SELECT Ticker, Datetime, R(Close) AS Close, len(h) AS n_history, R(list_sum(h)) AS sum_history FROM (SELECT *, list(Close) OVER (PARTITION BY Ticker ORDER BY Datetime ROWS 29 PRECEDING) AS h FROM ({EC}))
  QUALIFY row_number() OVER (PARTITION BY Ticker ORDER BY md5(concat_ws('|', '42', Ticker, CAST(Datetime AS VARCHAR)))) <= 10""")
def sample_rows(spark, sf_dir):
    out = S.sample_rows(C.event_candles(spark, sf_dir), 10)
    return out.select("Ticker", "Datetime", "Close", F.size("history").cast("long").alias("n_history"), F.aggregate("history", F.lit(0.0), lambda s, x: s + x).alias("sum_history"))


@query("preflight", f"""SELECT 'ERROR' AS level, 'unknown indicator ' || event_type AS message FROM (SELECT DISTINCT event_type FROM events) UNION ALL SELECT 'ERROR', 'unknown group colour' UNION ALL SELECT 'INFO', 'sma_20 is in price units'
  UNION ALL SELECT 'WARNING', CAST(n * 14 AS VARCHAR) || ' cells' FROM (SELECT count(*) AS n FROM ({EC})) WHERE n * 14 > 1000""")
def preflight(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    asked = [r[0] for r in e.select("event_type").distinct().collect()]  # a handful of names
    groups = {n: i.group for n, i in REGISTRY.indicators.items()}
    return S.preflight(spark, [*asked, "sma_20", "rsi_14"], groups, C.event_candles(spark, sf_dir).count(), ["volume", "colour"], limit=1000)


# Pruning -----------------------------------------------------------------------

_PR = ["log_return_1", "sma_20_ratio", "rsi_14", "atr_14", "bbands_width_20"]
_PR_SQL = compute_sql(EC, _PR, Duck())


@query("column_statistics", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", coalesce(min({c}) = max({c}), true) AS constant, R(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)) AS null_share FROM p" for c in _PR).join([f"WITH p AS ({_PR_SQL}) ", ""]))
def column_statistics(spark, sf_dir):
    return P.column_statistics(compute(C.event_candles(spark, sf_dir), _PR), _PR)


_PAIRS = [(a, b) for i, a in enumerate(_PR) for b in _PR[i + 1 :]]


@query("correlation_pearson", f"WITH p AS ({_PR_SQL}) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, R(corr({a}, {b})) AS corr FROM p" for a, b in _PAIRS))
def correlation_pearson(spark, sf_dir):
    return P.correlations(compute(C.event_candles(spark, sf_dir), _PR), _PR)


_RANK = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (ORDER BY {c} NULLS LAST) + (count({c}) OVER (PARTITION BY {c}) - 1) / 2.0 END AS {c}" for c in ("Close", "Volume", "Open"))


@query("correlation_spearman", f"WITH p AS (SELECT {_RANK} FROM ({EC})) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, R(corr({a}, {b})) AS corr FROM p" for a, b in (("Close", "Volume"), ("Close", "Open"), ("Volume", "Open"))))
def correlation_spearman(spark, sf_dir):
    return P.correlations(C.event_candles(spark, sf_dir), ["Close", "Volume", "Open"], "spearman")


_KENDALL = ("Close", "Volume", "Open")


@query("correlation_kendall", f"WITH p AS (SELECT row_number() OVER () AS i, * FROM ({EC})) " + " UNION ALL ".join(f"""SELECT '{a}' AS a, '{b}' AS b, R(sum(sign(x.{a} - y.{a}) * sign(x.{b} - y.{b})) / sqrt(sum(CAST(x.{a} <> y.{a} AS INT)) * sum(CAST(x.{b} <> y.{b} AS INT)))) AS corr FROM p x JOIN p y ON x.i < y.i""" for a, b in (("Close", "Volume"), ("Close", "Open"), ("Volume", "Open"))))
def correlation_kendall(spark, sf_dir):
    return P.correlations(C.event_candles(spark, sf_dir), list(_KENDALL), "kendall")


# Columns of known fate: constant, mostly missing on training rows, and twice the same; judged on the first four fifths of each series.
_FATE = f"""SELECT Ticker, Close, High AS first, 2 * High + 1 AS twin, 7.0 AS same, CASE WHEN idx % 3 = 0 THEN Low END AS gap, CASE WHEN idx >= floor(n * 0.8) THEN 5.0 ELSE 1.0 END AS late FROM (SELECT *, row_number() OVER {OVER} - 1 AS idx, count(*) OVER (PARTITION BY Ticker) AS n FROM ({EC})) WHERE idx < floor(n * 0.8)"""


@query("prune_decisions", f"""WITH t AS ({_FATE}) SELECT 'same' AS "column", 'constant' AS reason, '' AS detail FROM t HAVING min(same) = max(same) UNION ALL SELECT 'late', 'constant', '' FROM t HAVING min(late) = max(late)
  UNION ALL SELECT 'gap', 'nulls', printf('%.6f', avg(CASE WHEN gap IS NULL THEN 1.0 ELSE 0.0 END)) FROM t HAVING avg(CASE WHEN gap IS NULL THEN 1.0 ELSE 0.0 END) > 0.5 UNION ALL SELECT 'twin', 'correlated', 'first ' || printf('%.6f', corr(first, twin)) FROM t HAVING abs(corr(first, twin)) > 0.95""")
def prune_decisions(spark, sf_dir):
    c = S.time_split(C.event_candles(spark, sf_dir), 0.2)
    late = F.when(F.col("split") == "test", 5.0).otherwise(1.0)
    c = c.select("Ticker", "split", "Close", F.col("High").alias("first"), (2 * F.col("High") + 1).alias("twin"), F.lit(7.0).alias("same"), F.when(F.col("idx") % 3 == 0, F.col("Low")).alias("gap"), late.alias("late"))
    return P.Pruner().fit(c.where("split = 'train'"), ["Close", "first", "same", "gap", "twin", "late"]).summary(spark)


@query("leak_audit", f"SELECT unnest({list(REGISTRY.indicators)!r}) AS name, CAST(0 AS BIGINT) AS moved")
def leak_audit(spark, sf_dir):
    return indicators.leak_audit(C.event_candles(spark, sf_dir), list(REGISTRY.indicators))


@query("indicator_variant", f"SELECT Ticker, Datetime, R(lag(a, 1) OVER {OVER}) AS sma_7_ratio FROM (SELECT *, CASE WHEN count(Close) OVER w = 7 THEN Close / avg(Close) OVER w - 1 END AS a FROM ({EC}) WINDOW w AS (PARTITION BY Ticker ORDER BY Datetime ROWS 6 PRECEDING))")
def indicator_variant(spark, sf_dir):
    names = indicators.Registry()
    names.indicators, names.helpers = dict(REGISTRY.indicators), dict(REGISTRY.helpers)  # the shared registry stays as it is
    name = names.variant("sma_20_ratio", 7)
    return compute(C.event_candles(spark, sf_dir), [name], registry=names).select("Ticker", "Datetime", name)


@query("indicator_summary", "SELECT category, CAST(n AS BIGINT) AS n FROM (VALUES ('candle', 9), ('momentum', 31), ('regime', 9), ('returns', 16), ('trend', 32), ('volatility', 14), ('volume', 12)) v(category, n) WHERE (SELECT count(*) FROM events) > 0")
def indicator_summary(spark, sf_dir):
    out = REGISTRY.summary(spark).groupBy("category").agg(F.count("*").alias("n"))
    return out.where(F.lit(spark.read.parquet(f"{sf_dir}/events.parquet").limit(1).count() > 0))


@query("indicator_features", f"SELECT DISTINCT Ticker, CAST(1 AS DOUBLE) AS null_share, true AS safe FROM ({EC})")
def indicator_features(spark, sf_dir):
    """Every indicator looks back, so that each series' first row has none."""
    return indicators.indicator_features(C.event_candles(spark, sf_dir), ["candle", "volatility"], P.Pruner())[2]


# Augmentation --------------------------------------------------------------------


def _samples(spark, sf_dir) -> DataFrame:
    c = C.event_candles(spark, sf_dir)
    c = c.withColumn("f", F.col("Close") - F.coalesce(F.lag("Close", 1).over(series()), F.col("Close")))
    return S.row_index(Y.multistep_targets(c, 2)).select("Ticker", "idx", "Close", "f", "y")


_SAMPLES = f"SELECT Ticker, row_number() OVER {OVER} - 1 AS idx, Close, f, y1, y2 FROM (SELECT *, Close - coalesce(lag(Close, 1) OVER {OVER}, Close) AS f, {_Y(1)} AS y1, {_Y(2)} AS y2 FROM ({EC})) WHERE y2 IS NOT NULL"


def _u(tag: str, *key: str) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws('|', '42', '{tag}', {', '.join(f'CAST({k} AS VARCHAR)' for k in key)})), 1, 8)) AS BIGINT) / 4294967296.0)"


def _beta(a: float, tag: str, *key: str) -> str:
    u, v, p, q = (_u(f"{tag}/{c}", *key) for c in "uvpq")
    x = f"((1 + sqrt(1 - pow(1 - {u}, {2 / (2 * a + 1)!r})) * cos(2 * pi() * {v})) / 2)"
    return f"(1 / (1 + exp(-greatest(least(ln({x} / (1 - {x})) + (ln(1 - {p}) - ln(1 - {q})) / {a}, 700.0), -700.0))))"


def _n(tag: str, *key: str) -> str:
    return f"(sqrt(-2 * ln(1 - {_u(tag + '/a', *key)})) * cos(2 * pi() * {_u(tag + '/b', *key)}))"


@query("augment_jitter", f"WITH s AS ({_SAMPLES}), d AS (SELECT stddev_pop(f) AS sd FROM s) SELECT Ticker, idx, R(f + 0.01 * sd * {_n('jitter/0/f', 'Ticker', 'idx')}) AS f FROM s, d")
def augment_jitter(spark, sf_dir):
    return A.jitter(_samples(spark, sf_dir), ["f"]).select("Ticker", "idx", "f")


@query("augment_scale", f"SELECT Ticker, idx, R(f * (0.95 + (1.05 - 0.95) * {_u('scale/0', 'Ticker', 'idx')})) AS f FROM ({_SAMPLES})")
def augment_scale(spark, sf_dir):
    return A.scale(_samples(spark, sf_dir), ["f"]).select("Ticker", "idx", "f")


@query("augment_window_crop", f"SELECT Ticker, idx FROM (SELECT *, floor(0.9 * n) AS z, floor({_u('crop/0', 'Ticker')} * (n - floor(0.9 * n) + 1)) AS a FROM (SELECT *, count(*) OVER (PARTITION BY Ticker) AS n FROM ({_SAMPLES}))) WHERE z < 10 OR (idx >= a AND idx < a + z)")
def augment_window_crop(spark, sf_dir):
    return A.window_crop(_samples(spark, sf_dir)).select("Ticker", "idx")


@query("augment_mixup", f"""WITH s AS ({_SAMPLES}), q AS (SELECT Ticker, row_number() OVER (PARTITION BY Ticker ORDER BY md5(concat_ws('|', '42', 'mixup/0', Ticker, CAST(idx AS VARCHAR)))) - 1 AS idx, f AS g, y1 AS z1 FROM s)
SELECT Ticker, idx, R(l * f + (1 - l) * g) AS f, R(l * y1 + (1 - l) * z1) AS y1 FROM (SELECT *, {_beta(0.2, 'mixup/l/0', 'Ticker', 'idx')} AS l FROM s JOIN q USING (Ticker, idx))""")
def augment_mixup(spark, sf_dir):
    return A.mixup(_samples(spark, sf_dir), ["f"]).select("Ticker", "idx", "f", F.get("y", F.lit(0)).alias("y1"))


@query("augment_block_bootstrap", f"""WITH s AS ({_SAMPLES}), n AS (SELECT Ticker, count(*) AS n FROM s GROUP BY 1), p AS (SELECT s.Ticker, s.idx AS i, n.n AS n, CASE WHEN n.n < 20 THEN 1 ELSE 10 END AS b FROM s JOIN n USING (Ticker)),
k AS (SELECT Ticker, i, CAST((floor({_u('boot/0', 'Ticker', 'CAST(floor(i / b) AS BIGINT)')} * n) + i % b) AS BIGINT) % n AS j FROM p) SELECT k.Ticker, k.i AS idx, R(s.f) AS f FROM k JOIN s ON s.Ticker = k.Ticker AND s.idx = k.j""")
def augment_block_bootstrap(spark, sf_dir):
    return A.block_bootstrap(_samples(spark, sf_dir)).select("Ticker", "idx", "f")


@query("augment_trend_inject", f"WITH s AS (SELECT *, idx / greatest(count(*) OVER (PARTITION BY Ticker) - 1, 1) AS t FROM ({_SAMPLES})), d AS (SELECT stddev_pop(f) AS sd FROM s) SELECT Ticker, idx, R(f + 0.1 * t * t * sd) AS f FROM s, d")
def augment_trend_inject(spark, sf_dir):
    return A.trend_inject(_samples(spark, sf_dir), ["f"], "quadratic").select("Ticker", "idx", "f")


@query("augment_regime_noise", f"""WITH s AS (SELECT *, stddev_pop(f) OVER (PARTITION BY Ticker ORDER BY idx ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS v FROM ({_SAMPLES})), t AS (SELECT *, min(v) OVER (PARTITION BY Ticker) AS a, max(v) OVER (PARTITION BY Ticker) AS b FROM s)
SELECT Ticker, idx, R(f + (0.005 + 0.025 * coalesce((v - a) / nullif(b - a, 0), 0)) * {_n('regime/0/f', 'Ticker', 'idx')}) AS f FROM t""")
def augment_regime_noise(spark, sf_dir):
    return A.regime_noise(_samples(spark, sf_dir), ["f"]).select("Ticker", "idx", "f")


@query("augment_tail", f"WITH s AS (SELECT *, greatest(abs(y1), abs(y2)) AS z FROM ({_SAMPLES})), q AS (SELECT quantile_cont(z, 0.1) AS a, quantile_cont(z, 0.9) AS b, avg(f) AS m FROM s) SELECT Ticker, idx, R(f) AS f FROM s UNION ALL SELECT Ticker, idx, R(m + 1.2 * (f - m)) AS f FROM s, q WHERE z <= a OR z >= b")
def augment_tail(spark, sf_dir):
    return A.tail_augment(_samples(spark, sf_dir), ["f"]).select("Ticker", "idx", "f")


@query("augment_magnitude_warp", f"""WITH s AS (SELECT *, idx / greatest(count(*) OVER (PARTITION BY Ticker) - 1, 1) * 3 AS p FROM ({_SAMPLES})), t AS (SELECT *, CAST(least(floor(p), 2) AS BIGINT) AS k FROM s), u AS (SELECT *, 0.8 + 0.4 * {_u('warp/0', 'Ticker', 'k')} AS a, 0.8 + 0.4 * {_u('warp/0', 'Ticker', '(k + 1)')} AS b FROM t)
SELECT Ticker, idx, R(f * (a + (b - a) * (p - k))) AS f FROM u""")
def augment_magnitude_warp(spark, sf_dir):
    return A.magnitude_warp(_samples(spark, sf_dir), ["f"]).select("Ticker", "idx", "f")


_Z = f"SELECT *, {_n('vol/0', 'Ticker', 'idx')} AS z FROM ({_SAMPLES})"
_AB = f"SELECT *, CASE WHEN idx = 0 THEN 0.0 ELSE 0.85 END AS a, CASE WHEN idx = 0 THEN 1.0 ELSE 0.01 + 0.1 * z1 * z1 END AS b FROM (SELECT *, coalesce(lag(z, 1) OVER (PARTITION BY Ticker ORDER BY idx), 0.0) AS z1 FROM ({_Z}))"
_VOL = f"SELECT *, sqrt({Duck().recurrence('a', 'b').replace('ORDER BY Datetime', 'ORDER BY idx')}) AS v FROM ({_AB})"


@query("augment_volatility_regime", f"SELECT Ticker, idx, R(f * greatest(least(v / avg(v) OVER (PARTITION BY Ticker), 2.0), 0.5)) AS f FROM ({_VOL})")
def augment_volatility_regime(spark, sf_dir):
    return A.volatility_regime(_samples(spark, sf_dir), ["f"]).select("Ticker", "idx", "f")


@query("augment_presets", f"SELECT method, 0 AS copy, n FROM (SELECT unnest(['original', 'jitter', 'scale', 'magnitude_warp', 'trend_inject', 'regime_noise']) AS method), (SELECT count(*) AS n FROM ({_SAMPLES}))")
def augment_presets(spark, sf_dir):
    return A.augment(_samples(spark, sf_dir), ["f"], A.PRESETS["strong"]).groupBy("method", "copy").agg(F.count("*").alias("n"))


from tallow.operators import neighbours as N  # noqa: E402


def _two(spark, sf_dir) -> DataFrame:
    return _samples(spark, sf_dir).withColumns({"g": F.col("Close") / 2 + F.col("f"), "h": F.sqrt("Close")})


# The last fifth of the bins of each series, summed and taken off bin by bin.
@query("augment_frequency_mask", f"""WITH s AS (SELECT Ticker, idx, f, Close / 2 + f AS g, y1, count(*) OVER (PARTITION BY Ticker) AS n FROM ({_SAMPLES})),
b AS (SELECT Ticker, n, n // 2 + 1 AS m, unnest(range(n // 2 + 1 - greatest(1, CAST(floor((n // 2 + 1) * 0.2) AS BIGINT)), n // 2 + 1)) AS k FROM (SELECT DISTINCT Ticker, n FROM s)),
c AS (SELECT b.Ticker, b.k, sum(f * cos(2 * pi() * (b.k * idx % b.n) / b.n)) AS fc, sum(f * sin(2 * pi() * (b.k * idx % b.n) / b.n)) AS fs, sum(g * cos(2 * pi() * (b.k * idx % b.n) / b.n)) AS gc, sum(g * sin(2 * pi() * (b.k * idx % b.n) / b.n)) AS gs FROM s JOIN b USING (Ticker) GROUP BY 1, 2),
w AS (SELECT s.Ticker, idx, sum(t * (fc * cos(x) + fs * sin(x))) AS wf, sum(t * (gc * cos(x) + gs * sin(x))) AS wg FROM (SELECT s.Ticker, idx, fc, fs, gc, gs, 2 * pi() * (k * idx % n) / n AS x, CASE WHEN k = 0 OR 2 * k = n THEN 1.0 ELSE 2.0 END / n AS t FROM s JOIN c USING (Ticker)) s GROUP BY 1, 2)
SELECT Ticker, idx, R(f - wf) AS f, R(g - wg) AS g, R(y1) AS y1 FROM s JOIN w USING (Ticker, idx)""")
def augment_frequency_mask(spark, sf_dir):
    return N.frequency_mask(_two(spark, sf_dir), ["f", "g"]).select("Ticker", "idx", "f", "g", F.get("y", F.lit(0)).alias("y1"))


for _name, _make in {
    "augment_feature_rotation": lambda d: N.feature_rotation(d, ["f", "g", "h"]),
    "augment_pattern_morph": lambda d: N.pattern_morph(d, ["f", "g"]),
    "augment_smote": lambda d: N.smote(d, ["f", "g"]),
}.items():

    def _neighbours(spark, sf_dir, make=_make):
        return make(_two(spark, sf_dir)).select("Ticker", "idx", "f", "g", F.get("y", F.lit(0)).alias("y1"))

    query(_name, None)(_neighbours)
