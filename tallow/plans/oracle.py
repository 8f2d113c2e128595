"""Candle queries in the checking engine's SQL."""

EVENT_CANDLES = """SELECT event_type AS Ticker, date_trunc('hour', ts) AS Datetime, first(value ORDER BY ts, event_id) AS Open, max(value) AS High,
  min(value) AS Low, last(value ORDER BY ts, event_id) AS Close, CAST(count(*) AS DOUBLE) AS Volume FROM events GROUP BY ALL"""
USER_CANDLES = """SELECT CAST(user_id AS VARCHAR) AS Ticker, date_trunc('day', ts) AS Datetime, first(value ORDER BY ts, event_id) AS Open, max(value) AS High,
  min(value) AS Low, last(value ORDER BY ts, event_id) AS Close, CAST(count(*) AS DOUBLE) AS Volume FROM events GROUP BY ALL"""
ORDER_CANDLES = """SELECT o_orderpriority AS Ticker, date_trunc('day', CAST(o_orderdate AS TIMESTAMP)) AS Datetime, first(CAST(o_totalprice AS DOUBLE) ORDER BY o_orderdate, o_orderkey) AS Open,
  max(CAST(o_totalprice AS DOUBLE)) AS High, min(CAST(o_totalprice AS DOUBLE)) AS Low, last(CAST(o_totalprice AS DOUBLE) ORDER BY o_orderdate, o_orderkey) AS Close,
  CAST(count(*) AS DOUBLE) AS Volume FROM orders GROUP BY ALL"""

_PIECE = "CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE)"
_BY = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
ITEM_CANDLES = f"""SELECT l_returnflag AS Ticker, date_trunc('day', CAST(l_shipdate AS TIMESTAMP)) AS Datetime, first({_PIECE} ORDER BY {_BY}) AS Open,
  max({_PIECE}) AS High, min({_PIECE}) AS Low, last({_PIECE} ORDER BY {_BY}) AS Close, CAST(count(*) AS DOUBLE) AS Volume FROM lineitem GROUP BY ALL"""


def rounded(sql: str, cols: list[str], keys: str = "Ticker, Datetime", digits: int = 6) -> str:
    return f"SELECT {keys}, {', '.join(f'round({c}, {digits}) + 0.0 AS {c}' for c in cols)} FROM ({sql})"
