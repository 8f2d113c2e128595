"""Candle tables: Ticker, Datetime, Open, High, Low, Close, Volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

SCHEMA = T.StructType([T.StructField("Ticker", T.StringType()), T.StructField("Datetime", T.TimestampType()), *[T.StructField(c, T.DoubleType()) for c in ("Open", "High", "Low", "Close", "Volume")]])
PRICES = ("Open", "High", "Low", "Close", "Volume")

# Canonical intervals with the longest history in days, and what else they are called.
INTERVALS = {"1m": 6, "2m": 58, "5m": 58, "15m": 58, "30m": 58, "60m": 58, "90m": 58, "1h": 725, "1d": 36500, "5d": 36500, "1wk": 36500, "1mo": 36500, "3mo": 36500}
ALIASES = {"1min": "1m", "2min": "2m", "5min": "5m", "15min": "15m", "30min": "30m", "60min": "60m", "90min": "90m", "1hour": "1h", "1day": "1d", "5day": "5d", "1week": "1wk", "1month": "1mo", "3month": "3mo"}
#: Buckets that candles can be made in.
BUCKETS = {"1m": "minute", "60m": "hour", "1h": "hour", "1d": "day", "1wk": "week", "1mo": "month", "3mo": "quarter"}


def finite(c: Column | str) -> Column:
    """NaN and infinities become null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def read_candles(spark: SparkSession, path: str, fmt: str = "parquet", tickers: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Landed candle files; Date is renamed Datetime, the date range and tickers reach the scan."""
    df = spark.read.options(header=True).format(fmt).load(path) if fmt != "csv" else spark.read.csv(path, header=True, schema=SCHEMA)
    if "Date" in df.columns and "Datetime" not in df.columns:
        df = df.withColumnRenamed("Date", "Datetime")
    if tickers:
        df = df.where(F.col("Ticker").isin(tickers))
    if start:
        df = df.where(F.col("Datetime") >= F.lit(start).cast("timestamp"))
    if end:
        df = df.where(F.col("Datetime") < F.lit(end).cast("timestamp"))
    return df.select("Ticker", F.col("Datetime").cast("timestamp").alias("Datetime"), *[finite(F.col(c).cast("double")).alias(c) for c in PRICES])


def normalise_klines(rows: DataFrame, ticker: str | Column) -> DataFrame:
    """Kline arrays ``k`` of strings (epoch milliseconds, open, high, low, close, volume, ...) to candles of one ticker or of a column's."""
    at = lambda i: F.get("k", i)
    name = F.lit(ticker) if isinstance(ticker, str) else ticker
    return rows.select(name.alias("Ticker"), F.timestamp_millis(at(0).cast("long")).alias("Datetime"), *[finite(at(i + 1).cast("double")).alias(c) for i, c in enumerate(PRICES)])


def keep_last(chunks: DataFrame, chunk: str = "chunk") -> DataFrame:
    """Overlapping downloads: of rows with one (Ticker, Datetime) that of the last chunk."""
    w = Window.partitionBy("Ticker", "Datetime").orderBy(F.desc(chunk))
    return chunks.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", chunk)


def interval(name: str) -> str:
    """The canonical interval; an unknown one raises."""
    found = ALIASES.get(name.strip().lower(), name.strip().lower())
    if found not in INTERVALS:
        raise ValueError(f"unknown interval {name!r}; one of {', '.join(INTERVALS)}")
    return found


def clamp_history(candles: DataFrame, name: str) -> DataFrame:
    """The interval's longest history of each ticker, counted back from its last candle."""
    last = candles.groupBy("Ticker").agg(F.max("Datetime").alias("__last"))
    days = INTERVALS[interval(name)]
    return candles.join(last.hint("merge"), "Ticker").where(F.col("Datetime") >= F.col("__last") - F.expr(f"INTERVAL {days} DAYS")).drop("__last")


def symbol_columns(raw: Column, category: Column | str = "crypto") -> dict[str, Column]:
    """ticker: crypto ends in -USD or -USDT, other assets lose their :EXCHANGE; pair: the base with USDT.

    The pair drops -USD first and -USDT then, so that A-USDT gives ATUSDT.
    """
    kind = F.lit(category) if isinstance(category, str) else category
    upper = F.upper(raw)
    crypto = F.when(raw.endswith("-USD") | raw.endswith("-USDT"), upper).otherwise(F.concat(upper, F.lit("-USD")))
    base = F.replace(F.replace(upper, F.lit("-USD"), F.lit("")), F.lit("-USDT"), F.lit(""))
    return {"ticker": F.when(kind == "crypto", crypto).otherwise(F.upper(F.split(raw, ":")[0])), "pair": F.concat(base, F.lit("USDT"))}


def combine(frames: list[DataFrame]) -> DataFrame:
    """All tickers' rows under one schema; columns that one lacks are null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def summary(candles: DataFrame) -> DataFrame:
    """Per ticker: rows, first and last time, column names."""
    return candles.groupBy("Ticker").agg(F.count("*").alias("n_rows"), F.min("Datetime").alias("first_time"), F.max("Datetime").alias("last_time")).withColumn("columns", F.lit(",".join(candles.columns)))


def candles_from_events(rows: DataFrame, ticker: Column, time: Column, price: Column, tie: list[Column], bucket: str = "hour") -> DataFrame:
    """Candles per ticker and bucket; first and last price by time, then tie. One shuffle of partial aggregates."""
    each = rows.select(ticker.cast("string").alias("Ticker"), F.date_trunc(bucket, time).alias("Datetime"), price.cast("double").alias("p"), F.struct(time.alias("t"), *[c.alias(f"c{i}") for i, c in enumerate(tie)]).alias("o"))
    return each.groupBy("Ticker", "Datetime").agg(
        F.min_by("p", "o").alias("Open"), F.max("p").alias("High"), F.min("p").alias("Low"), F.max_by("p", "o").alias("Close"), F.count("*").cast("double").alias("Volume")
    )


def event_candles(spark: SparkSession, sf_dir: str, by: str = "event_type", bucket: str = "hour") -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return candles_from_events(e, F.col(by), F.col("ts"), F.col("value"), [F.col("event_id")], bucket)


def order_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return candles_from_events(o, F.col("o_orderpriority"), F.col("o_orderdate").cast("timestamp"), F.col("o_totalprice"), [F.col("o_orderkey")], "day")


def item_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily candles of the price of a piece, by return flag: few and long series."""
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    tie = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    price = F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")
    return candles_from_events(i, F.col("l_returnflag"), F.col("l_shipdate").cast("timestamp"), price, tie, "day")


def write_candles(candles: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per ticker."""
    candles.write.mode("overwrite").partitionBy("Ticker").format(fmt).options(header=True).save(path)
