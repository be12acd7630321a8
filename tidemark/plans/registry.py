"""Queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# The adapters of tidemark.sources.adapters in SQL.
_SYM = "['click','error','purchase','signup','view']"
_E = "e AS (SELECT *, epoch_us(ts) // 60000 AS ms, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
TRADES = _E + """,
trades AS (SELECT event_type AS symbol, event_id AS agg_id, ms, CAST(ts AS DATE) AS day, value AS price, CAST(k % 10 + 1 AS DOUBLE) AS quantity,
  CASE WHEN k % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CAST(CAST(value AS DECIMAL(18,6)) * (k % 10 + 1) AS DECIMAL(28,6)) AS notional,
  CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * CAST(CAST(value AS DECIMAL(18,6)) * (k % 10 + 1) AS DECIMAL(28,6)) AS signed,
  ms * 100000000 + event_id AS seq FROM e)"""
SWEEPS = f"sweeps AS (SELECT event_id AS sweep_id, {_SYM}[user_id % 5 + 1] AS symbol, ms, CASE WHEN k % 2 = 0 THEN 'BULLISH' ELSE 'BEARISH' END AS direction, value AS level FROM e WHERE event_type = 'signup')"
ALERTS = f"""alerts AS (SELECT event_id AS alert_id, {_SYM}[user_id % 5 + 1] AS symbol, ms,
  ['SELL_AGGRESSION','BUY_AGGRESSION','POSSIBLE_BULLISH_ABSORPTION','CONFIRMED_BEARISH_ABSORPTION','BULLISH_DIVERGENCE','BEARISH_DIVERGENCE'][k % 6 + 1] AS type,
  CASE WHEN k % 3 = 0 THEN '5m' ELSE '1m' END AS win, value AS price FROM e WHERE event_type = 'error')"""
SIGNALS = f"signals AS (SELECT event_id AS signal_id, {_SYM}[user_id % 5 + 1] AS symbol, ms, CASE WHEN k % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction, value AS price FROM e WHERE event_type = 'purchase')"
LEVELS = f"""lv0 AS (SELECT {_SYM}[(l_suppkey % 5) + 1] AS symbol, 28401120000 + (epoch_us(l_shipdate) // 2592000000000 - 304) * 500000 AS snap_ms,
  l_partkey % 101 - 50 AS tick, l_quantity FROM lineitem WHERE l_partkey % 101 <> 50),
levels AS (SELECT symbol, snap_ms, CASE WHEN tick < 0 THEN 'BID' ELSE 'ASK' END AS side, CAST(100 + tick * CAST(0.02 AS DECIMAL(4,2)) AS DECIMAL(10,2)) AS price,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS qty FROM lv0 GROUP BY ALL)"""
RANKED = LEVELS + """,
ranked AS (SELECT *, CAST(price * qty AS DECIMAL(28,6)) AS notional, row_number() OVER (PARTITION BY symbol, snap_ms, side ORDER BY CASE WHEN side = 'BID' THEN -price ELSE price END) AS rank FROM levels),
mids AS (SELECT *, (best_bid + best_ask) / 2 AS mid FROM (SELECT symbol, snap_ms, CAST(max(CASE WHEN side = 'BID' THEN price END) AS DOUBLE) AS best_bid, CAST(min(CASE WHEN side = 'ASK' THEN price END) AS DOUBLE) AS best_ask FROM levels GROUP BY ALL)
  WHERE best_bid IS NOT NULL AND best_ask IS NOT NULL),
lm AS (SELECT ranked.*, best_bid, best_ask, mid, round((CASE WHEN side = 'BID' THEN mid - CAST(price AS DOUBLE) ELSE CAST(price AS DOUBLE) - mid END) / mid * 10000, 6) AS bps FROM ranked JOIN mids USING (symbol, snap_ms))"""
BOOK = RANKED + """,
book AS (SELECT *, CASE WHEN bid_depth + ask_depth <> 0 THEN (bid_depth - ask_depth) / (bid_depth + ask_depth) ELSE 0 END AS imbalance FROM (
  SELECT symbol, snap_ms, max(best_bid) AS best_bid, max(best_ask) AS best_ask, max(mid) AS mid,
    CAST(coalesce(sum(notional) FILTER (WHERE side = 'BID' AND rank <= 5), 0) AS DOUBLE) AS bid_depth, CAST(coalesce(sum(notional) FILTER (WHERE side = 'ASK' AND rank <= 5), 0) AS DOUBLE) AS ask_depth,
    CAST(max(qty) FILTER (WHERE side = 'BID' AND rank = 1) AS DOUBLE) AS bid_qty, CAST(max(qty) FILTER (WHERE side = 'ASK' AND rank = 1) AS DOUBLE) AS ask_qty
  FROM lm GROUP BY ALL))"""
STACKING = """seqs AS (SELECT a.symbol, a.snap_ms, arg_min(b.snap_ms, abs(b.snap_ms - (a.snap_ms - 1000000)) * 1000000000000 + b.snap_ms) AS hist_ms
  FROM mids a JOIN mids b ON a.symbol = b.symbol AND b.snap_ms BETWEEN a.snap_ms - 2000000 AND a.snap_ms GROUP BY ALL),
chg AS (SELECT symbol, snap_ms, side, price, sum(d) AS d FROM (
    SELECT l.symbol, l.snap_ms, side, price, CASE WHEN s.hist_ms = s.snap_ms THEN 0 ELSE qty END AS d FROM levels l JOIN seqs s ON l.symbol = s.symbol AND l.snap_ms = s.snap_ms
    UNION ALL SELECT l.symbol, s.snap_ms, side, price, -qty FROM levels l JOIN seqs s ON l.symbol = s.symbol AND l.snap_ms = s.hist_ms AND s.hist_ms <> s.snap_ms) GROUP BY ALL),
cv AS (SELECT c.*, c.d * c.price AS v, CASE WHEN side = 'BID' AND CAST(price AS DOUBLE) >= mid * 0.99 AND CAST(price AS DOUBLE) <= mid THEN 'B' WHEN side = 'ASK' AND CAST(price AS DOUBLE) <= mid * 1.01 AND CAST(price AS DOUBLE) >= mid THEN 'A' END AS z FROM chg c JOIN mids USING (symbol, snap_ms)),
stack AS (SELECT *, bids_added + asks_pulled - bids_pulled - asks_added AS net_shift FROM (SELECT symbol, snap_ms,
  CAST(coalesce(sum(greatest(v, 0)) FILTER (WHERE z = 'B'), 0) AS DOUBLE) AS bids_added, CAST(coalesce(sum(greatest(-v, 0)) FILTER (WHERE z = 'B'), 0) AS DOUBLE) AS bids_pulled,
  CAST(coalesce(sum(greatest(v, 0)) FILTER (WHERE z = 'A'), 0) AS DOUBLE) AS asks_added, CAST(coalesce(sum(greatest(-v, 0)) FILTER (WHERE z = 'A'), 0) AS DOUBLE) AS asks_pulled FROM cv GROUP BY ALL))"""
