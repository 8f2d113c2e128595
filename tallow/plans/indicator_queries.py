"""Candles and indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow.functions.dialect import Duck
from tallow.operators.indicators import REGISTRY, compute, compute_sql
from tallow.plans.oracle import EVENT_CANDLES, ITEM_CANDLES, ORDER_CANDLES, USER_CANDLES, rounded
from tallow.sources.candles import event_candles, item_candles, order_candles

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _round(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if c in cols else F.col(c) for c in df.columns])


def _indicators(names: list[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = compute(event_candles(spark, sf_dir), names)
        return _round(out.select("Ticker", "Datetime", *names), names)

    return run


# One query for each registered indicator family, by the stem of its names.
def _families() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for n, i in REGISTRY.indicators.items():
        stem = n.rstrip("0123456789_") if n != "macd_12_26_9" else "macd"
        stem = {"macd_12_26_9_signal": "macd", "macd_12_26_9_hist": "macd"}.get(n, stem)
        out.setdefault(f"ind_{i.group}_{stem}", []).append(n)
    return out


FAMILIES = _families()
for _name, _members in FAMILIES.items():
    QUERIES[_name] = _indicators(_members)
    ORACLES[_name] = rounded(compute_sql(EVENT_CANDLES, _members, Duck()), _members)
for _group in REGISTRY.categories():
    _members = REGISTRY.by_category(_group)
    QUERIES[f"group_{_group}"] = _indicators(_members)
    ORACLES[f"group_{_group}"] = rounded(compute_sql(EVENT_CANDLES, _members, Duck()), _members)

#: Rows of a stretch of the long-series queries: a tenth of a series of the smallest tables.
STRETCH = 256


def _long(names: list[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = compute(item_candles(spark, sf_dir), names, stretch=STRETCH)
        return _round(out.select("Ticker", "Datetime", *names), names, 4)

    return run


for _group in REGISTRY.categories():
    _members = REGISTRY.by_category(_group)
    QUERIES[f"long_series_{_group}"] = _long(_members)
    ORACLES[f"long_series_{_group}"] = rounded(compute_sql(ITEM_CANDLES, _members, Duck()), _members, digits=4)


def candles_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_candles(spark, sf_dir)


def candles_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_candles(spark, sf_dir, by="user_id", bucket="day")


def candles_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_candles(spark, sf_dir)


def candles_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_candles(spark, sf_dir)


QUERIES |= {"candles_items": candles_items, "candles_hourly": candles_hourly, "candles_by_user": candles_by_user, "candles_orders": candles_orders}
ORACLES |= {"candles_items": ITEM_CANDLES, "candles_hourly": EVENT_CANDLES, "candles_by_user": USER_CANDLES, "candles_orders": ORDER_CANDLES}

_SLICE = ["log_return_1", "sma_20_ratio", "rsi_14", "atr_14"]


def candle_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly candles, four shifted indicators and the log returns of the next three closes."""
    from tallow.operators.targets import multistep_targets, to_target

    out = multistep_targets(compute(event_candles(spark, sf_dir), _SLICE), 3)
    steps = to_target(F.col("y"), "log_return", F.col("Close"))
    out = out.select("Ticker", "Datetime", *_SLICE, *[F.get(steps, k).alias(f"y{k + 1}") for k in range(3)])
    return _round(out, [*_SLICE, "y1", "y2", "y3"])


def _slice_sql() -> str:
    base = compute_sql(EVENT_CANDLES, _SLICE, Duck())
    w = "OVER (PARTITION BY Ticker ORDER BY Datetime)"
    y = ", ".join(f"ln(greatest(lead(Close, {k}) {w}, 1e-8) / CASE WHEN Close = 0 THEN 1e-8 ELSE Close END) AS y{k}" for k in (1, 2, 3))
    return f"SELECT Ticker, Datetime, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in [*_SLICE, 'y1', 'y2', 'y3'])} FROM ({base}) JOIN (SELECT Ticker, Datetime, {y}, lead(Close, 3) {w} AS c3 FROM ({EVENT_CANDLES})) USING (Ticker, Datetime) WHERE c3 IS NOT NULL"


QUERIES["candle_slice"] = candle_slice
ORACLES["candle_slice"] = _slice_sql()
