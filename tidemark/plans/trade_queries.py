"""Registered queries over trades and book snapshots, at thresholds that fit the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions import labels
from tidemark.functions.scalars import compact_usdt, price_bucket
from tidemark.operators import book, trades
from tidemark.plans.registry import ALERTS, BOOK, LEVELS, RANKED, STACKING, SWEEPS, TRADES, query
from tidemark.sources import adapters as src

CFG = Config(
    large_trade=2000.0, burst_multiple=1.5, burst_floor=1.0, burst_recent_ms=60_000, burst_back_ms=600_000, absorption_short=300.0, absorption_long=800.0, least_trades=5,
    divergence=500.0, divergence_trades=10, cooldown_ms=120_000, cooldown_move=0.5, stale_ms=600_000, sweep_pressure=2000.0, sweep_recovery=500.0, sweep_score=5,
    sweep_active_ms=300_000, conflict_ms=100_000, bias_delta=1000.0, watch_delta=300.0, wall_least=5000.0, wall_multiple=0.25, iceberg_multiple=0.02, spoof_pulled=8000.0, spoof_ms=1_000_000,
)
WINS = ("1m", "5m", "15m")
_MS = {"1m": 60000, "5m": 300000, "15m": 900000}


def r6(c: str):
    return F.round(c, 6).alias(c)


def _window_sql() -> str:
    over = {w: f"(PARTITION BY symbol ORDER BY ms RANGE BETWEEN {ms} PRECEDING AND CURRENT ROW)" for w, ms in _MS.items()}
    part = "coalesce(sum(notional) FILTER (WHERE side = '{s}') OVER {o}, 0)"
    cols = ", ".join(f"{part.format(s='BUY', o=o)} AS buy_{w}, {part.format(s='SELL', o=o)} AS sell_{w}, count(*) OVER {o} AS n_{w}" for w, o in over.items())
    out = ", ".join(
        f"round(CAST(buy_{w} - sell_{w} AS DOUBLE), 6) AS delta_{w}, round(CASE WHEN buy_{w} + sell_{w} <> 0 THEN CAST(buy_{w} AS DOUBLE) / CAST(buy_{w} + sell_{w} AS DOUBLE) ELSE 0.5 END, 6) AS buy_ratio_{w}, n_{w}, "
        f"CASE WHEN ms - start < {_MS[w]} THEN 'WARMING_UP' ELSE 'VALID' END AS status_{w}" for w in WINS)
    return f"""WITH {TRADES}, w AS (SELECT *, min(ms) OVER (PARTITION BY symbol) AS start, {cols} FROM trades)
SELECT symbol, agg_id, ms, {out}, buy_5m - sell_5m = buy_15m - sell_15m AND ms - start >= 900000 AS duplicated FROM w"""


@query("a1_window_metrics", _window_sql())
def a1(spark, d):
    x = trades.window_metrics(src.trades(spark, d), cfg=CFG)
    return x.select("symbol", "agg_id", "ms", *[c for w in WINS for c in (r6(f"delta_{w}"), r6(f"buy_ratio_{w}"), F.col(f"n_{w}"), F.col(f"status_{w}"))], "duplicated")


_LATEST = TRADES + """,
en AS (SELECT symbol, max(ms) AS fin, min(ms) AS start FROM trades GROUP BY symbol),
latest AS (SELECT symbol, arg_max(price, seq) AS price, """ + ", ".join(
    f"CAST(coalesce(sum(signed) FILTER (WHERE ms >= fin - {ms}), 0) AS DOUBLE) AS delta_{w}, coalesce(CAST(sum(notional) FILTER (WHERE ms >= fin - {ms} AND side = 'BUY') AS DOUBLE), 0) / nullif(CAST(sum(notional) FILTER (WHERE ms >= fin - {ms}) AS DOUBLE), 0) AS br_{w}, max(CASE WHEN fin - start < {ms} THEN 'WARMING_UP' ELSE 'VALID' END) AS status_{w}"
    for w, ms in _MS.items()) + " FROM trades JOIN en USING (symbol) GROUP BY symbol)"


@query("a1_latest_windows", f"WITH {_LATEST} SELECT symbol, price, " + ", ".join(f"round(delta_{w}, 6) AS delta_{w}, round(coalesce(br_{w}, 0.5), 6) AS buy_ratio_{w}, status_{w}" for w in WINS) + " FROM latest")
def a1_latest(spark, d):
    x = trades.latest_metrics(src.trades(spark, d))
    return x.select("symbol", "price", *[c for w in WINS for c in (r6(f"delta_{w}"), r6(f"buy_ratio_{w}"), F.col(f"status_{w}"))])


@query("k3_radar", f"""WITH {_LATEST}, {BOOK}, {SWEEPS}, {ALERTS}, lb AS (SELECT symbol, arg_max(imbalance, snap_ms) AS imbalance FROM book GROUP BY symbol),
lg AS (SELECT symbol, min(fin - ms) AS large_ms FROM trades JOIN en USING (symbol) WHERE notional >= 2000 GROUP BY symbol), ev AS (SELECT symbol, min(fin - ms) AS event_ms FROM alerts JOIN en USING (symbol) WHERE ms <= fin GROUP BY symbol),
sw AS (SELECT symbol, min(fin - ms) AS sweep_ms, arg_max(direction, ms * 100000000 + sweep_id) AS direction FROM sweeps JOIN en USING (symbol) WHERE ms <= fin GROUP BY symbol)
SELECT symbol, price, round(delta_1m, 6) AS delta_1m, round(delta_5m, 6) AS delta_5m, round(delta_15m, 6) AS delta_15m, round(coalesce(imbalance, 0), 6) AS imbalance, large_ms, event_ms,
  CASE WHEN sweep_ms <= 300000 THEN CASE direction WHEN 'BULLISH' THEN 'LONG (SWEEP)' ELSE 'SHORT (SWEEP)' END ELSE 'WAITING' END AS action,
  CASE WHEN coalesce(br_5m, 0.5) >= 0.58 THEN 'BUYERS' WHEN coalesce(br_5m, 0.5) <= 0.42 THEN 'SELLERS' ELSE 'NEUTRAL' END AS aggression,
  round(abs(delta_1m) / 10000 + abs(delta_5m) / 25000 + abs(coalesce(imbalance, 0)) * 100 + CASE WHEN large_ms <= 60000 THEN 50 ELSE 0 END + CASE WHEN event_ms <= 60000 THEN 100 ELSE 0 END + CASE WHEN sweep_ms <= 300000 THEN 500 ELSE 0 END, 6) AS activity
FROM latest LEFT JOIN lb USING (symbol) LEFT JOIN lg USING (symbol) LEFT JOIN ev USING (symbol) LEFT JOIN sw USING (symbol)""")
def k3(spark, d):
    t = src.trades(spark, d)
    snaps = book.book_metrics(src.book_levels(spark, d)).groupBy("symbol").agg(F.max_by("imbalance", "snap_ms").alias("imbalance"))
    latest = trades.latest_metrics(t)
    ends = t.groupBy("symbol").agg(F.max("ms").alias("fin"))
    age = lambda rows, name, *more: rows.join(ends, "symbol").where("ms <= fin").groupBy("symbol").agg(F.min(F.col("fin") - F.col("ms")).alias(name), *more)
    swept = age(src.sweeps(spark, d), "sweep_ms", F.max_by("direction", F.struct("ms", "sweep_id")).alias("direction"))
    x = latest.join(age(trades.large_trades(t, CFG), "large_ms"), "symbol", "left").join(age(src.alerts(spark, d), "event_ms"), "symbol", "left").join(swept, "symbol", "left")
    side = F.when(F.col("direction") == "BULLISH", "LONG (SWEEP)").otherwise("SHORT (SWEEP)")
    x = trades.radar(x.withColumn("action", F.when(F.col("sweep_ms") <= CFG.sweep_active_ms, side).otherwise("WAITING")), snaps, CFG)
    return x.select("symbol", "price", r6("delta_1m"), r6("delta_5m"), r6("delta_15m"), r6("imbalance"), "large_ms", "event_ms", "action", "aggression", r6("activity"))


@query("k11_first_seen", f"WITH {TRADES}, f AS (SELECT symbol, min(seq) AS s, min(ms) AS first_ms FROM trades GROUP BY symbol) SELECT symbol, first_ms, row_number() OVER (ORDER BY s) AS position FROM f")
def k11(spark, d):
    return trades.first_seen_order(src.trades(spark, d)).select("symbol", "first_ms", F.col("position").cast("long").alias("position"))


@query("a2_a3_cumulative_delta", f"""WITH {TRADES} SELECT symbol, agg_id, round(CAST(sum(signed) OVER (PARTITION BY symbol ORDER BY seq) AS DOUBLE), 6) AS cvd,
  round(CAST(sum(signed) OVER (PARTITION BY symbol, day ORDER BY seq) AS DOUBLE), 6) AS session_cvd FROM trades""")
def a2(spark, d):
    x = trades.cumulative_delta(src.trades(spark, d), CFG)
    return x.select("symbol", "agg_id", F.round(F.col("cvd").cast("double"), 6).alias("cvd"), F.round(F.col("session_cvd").cast("double"), 6).alias("session_cvd"))


@query("a4_trade_burst", f"""WITH {TRADES}, c AS (SELECT symbol, agg_id, count(*) OVER (PARTITION BY symbol ORDER BY ms RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW) AS n_recent,
  count(*) OVER (PARTITION BY symbol ORDER BY ms RANGE BETWEEN 600000 PRECEDING AND CURRENT ROW) AS n_back FROM trades)
SELECT symbol, agg_id, n_recent, round((n_back - n_recent) / 9.0::DOUBLE, 6) AS average, n_recent > 1.5 * greatest(1.0::DOUBLE, (n_back - n_recent) / 9.0::DOUBLE) AS burst FROM c""")
def a4(spark, d):
    return trades.bursts(src.trades(spark, d), CFG).select("symbol", "agg_id", "n_recent", r6("average"), "burst")


@query("a5_absorption", f"""WITH {TRADES}, t AS (SELECT trades.*, unnest(range(ms // 60000 + 1, ms // 60000 + 6)) * 60000 AS tick FROM trades),
g AS (SELECT symbol, tick, arg_min(price, seq) AS open, arg_max(price, seq) AS close, max(price) AS high, min(price) AS low, count(*) AS n,
  coalesce(sum(notional) FILTER (WHERE side = 'BUY'), 0) AS buy, coalesce(sum(notional) FILTER (WHERE side = 'SELL'), 0) AS sell FROM t GROUP BY ALL HAVING count(*) >= 5),
m AS (SELECT *, CAST(buy - sell AS DOUBLE) AS delta, (close - open) / nullif(open, 0) * 100 AS chg, CAST(buy AS DOUBLE) / CAST(buy + sell AS DOUBLE) AS br, CAST(sell AS DOUBLE) / CAST(buy + sell AS DOUBLE) AS sr FROM g)
SELECT symbol, tick, open, close, high, low, n, round(delta, 6) AS delta, CASE WHEN delta < -800 AND sr >= 0.6 AND (chg >= -0.02 OR (close - low) / nullif(low, 0) * 100 >= 0.04) THEN 'BULLISH_ABSORPTION'
  WHEN delta > 800 AND br >= 0.6 AND (chg <= 0.02 OR (high - close) / nullif(high, 0) * 100 >= 0.04) THEN 'BEARISH_ABSORPTION' END AS event FROM m""")
def a5(spark, d):
    return trades.absorption(src.trades(spark, d), 300_000, 60_000, CFG).select("symbol", "tick", "open", "close", "high", "low", "n", r6("delta"), "event")


@query("a6_cvd_divergence", f"""WITH {TRADES}, t AS (SELECT trades.*, unnest(range((ms + 299999) // 300000, (ms + 900000) // 300000 + 1)) * 300000 AS tick FROM trades),
o AS (SELECT *, row_number() OVER (PARTITION BY symbol, tick ORDER BY seq) AS i, count(*) OVER (PARTITION BY symbol, tick) AS n FROM t),
h AS (SELECT symbol, tick, max(n) AS n, CAST(sum(CAST(price AS DECIMAL(18,6))) FILTER (WHERE i <= n // 2) AS DOUBLE) / count(*) FILTER (WHERE i <= n // 2) AS price_1,
  CAST(sum(CAST(price AS DECIMAL(18,6))) FILTER (WHERE i > n // 2) AS DOUBLE) / count(*) FILTER (WHERE i > n // 2) AS price_2,
  CAST(sum(signed) FILTER (WHERE i <= n // 2) AS DOUBLE) AS delta_1, CAST(sum(signed) FILTER (WHERE i > n // 2) AS DOUBLE) AS delta_2 FROM o WHERE n >= 10 GROUP BY ALL)
SELECT symbol, tick, n, round(price_1, 6) AS price_1, round(price_2, 6) AS price_2, round(delta_1, 6) AS delta_1, round(delta_2, 6) AS delta_2,
  CASE WHEN price_2 > price_1 AND delta_2 < delta_1 - 500 THEN 'BEARISH_DIVERGENCE' WHEN NOT price_2 > price_1 AND delta_2 > delta_1 + 500 THEN 'BULLISH_DIVERGENCE' END AS event FROM h""")
def a6(spark, d):
    x = trades.divergence(src.trades(spark, d), 900_000, 300_000, CFG)
    return x.select("symbol", "tick", "n", r6("price_1"), r6("price_2"), r6("delta_1"), r6("delta_2"), "event")


@query("p6_large_trades", f"WITH {TRADES} SELECT symbol, agg_id, side, round(CAST(notional AS DOUBLE), 6) AS notional FROM trades WHERE notional >= 2000")
def p6(spark, d):
    return trades.large_trades(src.trades(spark, d), CFG).select("symbol", "agg_id", "side", F.round(F.col("notional").cast("double"), 6).alias("notional"))


@query("p7_p9_aggression", f"""WITH x AS ({_window_sql()}) SELECT symbol, agg_id, CASE WHEN buy_ratio_1m >= 0.65 THEN 'BUY_AGGRESSION' WHEN round(1 - buy_ratio_1m, 6) >= 0.65 THEN 'SELL_AGGRESSION' END AS event,
  CASE WHEN buy_ratio_5m >= 0.58 THEN 'BUYERS' WHEN buy_ratio_5m <= 0.42 THEN 'SELLERS' ELSE 'NEUTRAL' END AS side FROM x""")
def p7(spark, d):
    x = trades.window_metrics(src.trades(spark, d), cfg=CFG)
    one, five = F.round("buy_ratio_1m", 6), F.round("buy_ratio_5m", 6)
    return x.select("symbol", "agg_id", labels.aggression_event(one, F.round(1 - one, 6), CFG).alias("event"), labels.aggression_side(five).alias("side"))


@query("a20_p10_stream_health", f"""WITH {TRADES}, h AS (SELECT symbol, greatest(0, 28444000000 - max(ms)) AS age_ms, count(*) FILTER (WHERE ms >= 28444000000 - 600000) / 600.0::DOUBLE AS eps FROM trades WHERE ms <= 28444000000 GROUP BY symbol)
SELECT symbol, age_ms, round(eps, 6) AS events_per_second, CASE WHEN age_ms <= 1000 THEN 'HEALTHY' WHEN age_ms <= 2500 THEN 'DEGRADED' ELSE 'STALE' END AS status FROM h""")
def a20(spark, d):
    x = trades.stream_health(src.trades(spark, d), 28_444_000_000, 600_000)
    return x.select("symbol", F.col("age_ms").cast("long").alias("age_ms"), r6("events_per_second"), "status")


@query("x1_tumbling_bars", f"""WITH {TRADES} SELECT symbol, ms // 600000 * 600000 AS bar, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close,
  round(CAST(sum(notional) AS DOUBLE), 6) AS volume, count(*) AS n FROM trades GROUP BY ALL""")
def x1(spark, d):
    return trades.bars(src.trades(spark, d), 600_000).select("symbol", "bar", "open", "high", "low", "close", r6("volume"), "n")


@query("p22_price_bucket", f"WITH {TRADES} SELECT agg_id, round_even(price / 10.0, 0) * 10.0 AS bucket, price >= 100 AS dear FROM trades")
def p22(spark, d):
    return src.trades(spark, d).select("agg_id", price_bucket(F.col("price"), 10.0).alias("bucket"), (F.col("price") >= 100).alias("dear"))


@query("f1_compact_format", f"""WITH {TRADES}, s AS (SELECT symbol, CAST(sum(signed) AS DOUBLE) AS v FROM trades GROUP BY symbol) SELECT symbol, CASE WHEN v < 0 THEN '-' ELSE '+' END ||
  CASE WHEN abs(v) >= 1000000 THEN printf('$%.2fM', abs(v) / 1000000) WHEN abs(v) >= 1000 THEN printf('$%.1fK', abs(v) / 1000) ELSE printf('$%.1f', abs(v)) END AS shown FROM s""")
def f1(spark, d):
    x = src.trades(spark, d).groupBy("symbol").agg(F.sum(F.when(F.col("side") == "BUY", F.col("notional")).otherwise(-F.col("notional"))).cast("double").alias("v"))
    return x.select("symbol", compact_usdt(F.col("v")).alias("shown"))


# --- book -------------------------------------------------------------------------------------


@query("k1_top_levels", f"WITH {RANKED} SELECT symbol, snap_ms, side, CAST(price AS DOUBLE) AS price, CAST(qty AS DOUBLE) AS qty, CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank <= 5")
def k1(spark, d):
    x = book.top_levels(src.book_levels(spark, d), 5)
    return x.select("symbol", "snap_ms", "side", F.col("price").cast("double").alias("price"), F.col("qty").cast("double").alias("qty"), F.col("rank").cast("long").alias("rank"))


def _bands() -> str:
    amount = {"0_5": ("bps <= 5", "notional"), "5_15": ("bps > 5 AND bps <= 15", "notional"), "15_30": ("bps > 15 AND bps <= 30", "notional"), "total": ("true", "notional"),
              "weighted": ("bps <= 30", "CAST(1 - bps / 30 AS DECIMAL(20,10)) * CAST(notional AS DECIMAL(18,4))")}
    cols = ", ".join(f"CAST(coalesce(sum({a}) FILTER (WHERE side = 'BID' AND {c}), 0) AS DOUBLE) AS b_{n}, CAST(coalesce(sum({a}) FILTER (WHERE side = 'ASK' AND {c}), 0) AS DOUBLE) AS a_{n}" for n, (c, a) in amount.items())
    out = ", ".join(f"round(CASE WHEN b_{n} + a_{n} <> 0 THEN (b_{n} - a_{n}) / (b_{n} + a_{n}) ELSE 0 END, 6) AS imbalance_{n}" for n in amount)
    return f"WITH {RANKED}, s AS (SELECT symbol, snap_ms, {cols} FROM lm WHERE rank <= 100 GROUP BY ALL) SELECT symbol, snap_ms, {out} FROM s"


@query("a10_a11_banded_imbalance", _bands())
def a10(spark, d):
    x = book.book_metrics(src.book_levels(spark, d))
    return x.select("symbol", "snap_ms", *[r6(f"imbalance_{n}") for n in ("0_5", "5_15", "15_30", "total", "weighted")])


@query("a7_a9_book_metrics", f"""WITH {BOOK}, m AS (SELECT *, CASE WHEN bid_qty + ask_qty > 0 THEN (best_bid * ask_qty + best_ask * bid_qty) / (bid_qty + ask_qty) ELSE mid END AS micro FROM book)
SELECT symbol, snap_ms, best_bid, best_ask, round(best_ask - best_bid, 6) AS spread, round((best_ask - best_bid) / mid * 10000, 6) AS spread_bps, round(bid_depth, 6) AS bid_depth, round(ask_depth, 6) AS ask_depth,
  round(imbalance, 6) AS imbalance, round(micro, 6) AS microprice, round((micro - mid) / mid * 10000, 6) AS microprice_bps FROM m""")
def a7(spark, d):
    x = book.book_metrics(src.book_levels(spark, d))
    return x.select("symbol", "snap_ms", "best_bid", "best_ask", *[r6(c) for c in ("spread", "spread_bps", "bid_depth", "ask_depth", "imbalance", "microprice", "microprice_bps")])


@query("a12_liquidity_vacuum", f"""WITH {RANKED}, s AS (SELECT symbol, snap_ms, CAST(coalesce(sum(notional) FILTER (WHERE side = 'BID' AND CAST(price AS DOUBLE) >= mid * 0.9985 AND CAST(price AS DOUBLE) <= mid), 0) AS DOUBLE) AS bn,
  CAST(coalesce(sum(notional) FILTER (WHERE side = 'ASK' AND CAST(price AS DOUBLE) <= mid * 1.0015 AND CAST(price AS DOUBLE) >= mid), 0) AS DOUBLE) AS an,
  CAST(coalesce(sum(notional) FILTER (WHERE side = 'BID' AND rank <= 5), 0) AS DOUBLE) AS ref FROM lm WHERE rank <= 100 GROUP BY ALL)
SELECT symbol, snap_ms, ref > 0 AND an < ref * 2.0 AS up, ref > 0 AND bn < ref * 2.0 AS down FROM s""")
def a12(spark, d):
    return book.vacuum(src.book_levels(spark, d), Config(vacuum_share=2.0)).select("symbol", "snap_ms", "up", "down")


@query("a14_j2_j3_stacking_pulling", f"WITH {RANKED}, {STACKING} SELECT symbol, snap_ms, round(bids_added, 6) AS bids_added, round(bids_pulled, 6) AS bids_pulled, round(asks_added, 6) AS asks_added, round(asks_pulled, 6) AS asks_pulled, round(net_shift, 6) AS net_shift FROM stack")
def a14(spark, d):
    x = book.stacking(src.book_levels(spark, d), 1_000_000, 2_000_000)
    return x.select("symbol", "snap_ms", *[r6(c) for c in ("bids_added", "bids_pulled", "asks_added", "asks_pulled", "net_shift")])


_WALLS = RANKED + """,
rf AS (SELECT *, CAST(coalesce(sum(notional) FILTER (WHERE side = 'BID' AND rank <= 5) OVER (PARTITION BY symbol, snap_ms), 0) AS DOUBLE) AS ref FROM ranked WHERE rank <= 100),
sq AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY snap_ms) AS i, lead(snap_ms) OVER (PARTITION BY symbol ORDER BY snap_ms) AS next_ms FROM (SELECT DISTINCT symbol, snap_ms FROM levels)),
wl AS (SELECT rf.*, i, next_ms, i - row_number() OVER (PARTITION BY symbol, price ORDER BY i) AS run FROM rf JOIN sq USING (symbol, snap_ms) WHERE CAST(notional AS DOUBLE) >= greatest(5000.0, ref * 0.25)),
wp AS (SELECT *, lag(notional) OVER (PARTITION BY symbol, price, run ORDER BY i) AS prev, max(notional) OVER (PARTITION BY symbol, price, run ORDER BY i) AS most FROM wl),
walls AS (SELECT symbol, price, run, min(side) AS side, min(snap_ms) AS first_ms, max(snap_ms) AS last_ms, arg_max(CAST(next_ms AS VARCHAR), i) AS gone0, count(*) AS updates, CAST(max(notional) AS DOUBLE) AS largest,
  CAST(sum(notional) AS DOUBLE) / count(*) AS average, CAST(arg_max(notional, i) AS DOUBLE) AS current, CAST(coalesce(sum(greatest(notional - prev, 0)) FILTER (WHERE prev IS NOT NULL), 0) AS DOUBLE) AS added,
  CAST(coalesce(sum(greatest(prev - notional, 0)) FILTER (WHERE prev IS NOT NULL), 0) AS DOUBLE) AS removed,
  count(*) FILTER (WHERE CAST(prev AS DOUBLE) < CAST(most AS DOUBLE) * 0.2 AND CAST(notional - prev AS DOUBLE) > CAST(most AS DOUBLE) * 0.3) AS refills,
  max(next_ms) FILTER (WHERE true) AS nx, count(*) FILTER (WHERE next_ms IS NULL) AS last_here FROM wp GROUP BY ALL),
wf AS (SELECT *, CASE WHEN last_here > 0 THEN NULL ELSE nx END AS gone_ms FROM walls)"""


@query("a15_wall_lifetime", f"""WITH {_WALLS} SELECT symbol, CAST(price AS DOUBLE) AS price, side, first_ms, coalesce(gone_ms, last_ms) - first_ms AS life_ms, gone_ms IS NULL AS standing, updates, round(largest, 6) AS most, round(average, 6) AS average,
  round(current, 6) AS current, round(added, 6) AS added, round(removed, 6) AS removed, refills FROM wf""")
def a15(spark, d):
    x = book.walls(src.book_levels(spark, d), CFG)
    return x.select("symbol", F.col("price").cast("double").alias("price"), "side", "first_ms", "life_ms", "standing", "updates", *[r6(c) for c in ("most", "average", "current", "added", "removed")], "refills")


@query("k2_wall_scores", f"""WITH {_WALLS}, {BOOK.removeprefix(RANKED + ',')}, lb AS (SELECT symbol, arg_max(mid, snap_ms) AS m, arg_max(bid_depth, snap_ms) AS ref, max(snap_ms) AS now FROM book GROUP BY symbol)
SELECT symbol, CAST(price AS DOUBLE) AS price, side, round(least(current / ref, 5.0) * least((now - first_ms) / 60000.0::DOUBLE, 1.0) * greatest(0.0, 1 - abs(CAST(price AS DOUBLE) - m) / m / 0.02) * (average / largest), 5) AS score
FROM wf JOIN lb USING (symbol) WHERE gone_ms IS NULL""")
def k2(spark, d):
    return book.wall_scores(src.book_levels(spark, d), CFG).select("symbol", F.col("price").cast("double").alias("price"), "side", F.round("score", 5).alias("score"))


@query("j10_iceberg", f"""WITH {TRADES}, {LEVELS}, ex AS (SELECT symbol, round_even(price / 0.5, 0) * 0.5 AS bucket, CAST(sum(notional) AS DOUBLE) AS executed FROM trades GROUP BY ALL),
la AS (SELECT symbol, max(snap_ms) AS snap_ms FROM levels GROUP BY symbol), sh AS (SELECT symbol, round_even(CAST(price AS DOUBLE) / 0.5, 0) * 0.5 AS bucket, CAST(sum(CAST(price * qty AS DECIMAL(28,6))) AS DOUBLE) AS displayed FROM levels JOIN la USING (symbol, snap_ms) GROUP BY ALL)
SELECT symbol, bucket, round(executed, 6) AS executed, round(displayed, 6) AS displayed, executed > 0.02 * displayed AS iceberg FROM ex JOIN sh USING (symbol, bucket)""")
def j10(spark, d):
    return book.icebergs(src.trades(spark, d), src.book_levels(spark, d), 0.5, CFG).select("symbol", "bucket", r6("executed"), r6("displayed"), "iceberg")


@query("p20_spoof_risk", f"""WITH {TRADES}, {_WALLS}, ex AS (SELECT symbol, round_even(price / 0.5, 0) * 0.5 AS bucket, CAST(sum(notional) AS DOUBLE) AS executed FROM trades GROUP BY ALL),
g AS (SELECT w.symbol, w.price, first_ms, gone_ms - first_ms AS life_ms, removed + current AS pulled, coalesce(executed, 0) AS executed FROM wf w LEFT JOIN ex ON ex.symbol = w.symbol AND ex.bucket = round_even(CAST(w.price AS DOUBLE) / 0.5, 0) * 0.5 WHERE gone_ms IS NOT NULL)
SELECT symbol, CAST(price AS DOUBLE) AS price, first_ms, life_ms, round(pulled, 6) AS pulled, round(executed, 6) AS executed, pulled >= 8000 AND life_ms <= 1000000 AND executed < 0.05 * pulled AS spoof FROM g""")
def p20(spark, d):
    t, lv = src.trades(spark, d), src.book_levels(spark, d)
    x = book.spoofs(book.walls(lv, CFG), book.executed_by_price(t, 0.5), 0.5, CFG)
    return x.select("symbol", F.col("price").cast("double").alias("price"), "first_ms", "life_ms", r6("pulled"), r6("executed"), "spoof")


@query("k9_ladder", f"""WITH {RANKED}, la AS (SELECT symbol, max(snap_ms) AS snap_ms FROM levels GROUP BY symbol) SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY price DESC) AS line, side, CAST(price AS DOUBLE) AS price, CAST(qty AS DOUBLE) AS qty
FROM ranked JOIN la USING (symbol, snap_ms) WHERE rank <= 15""")
def k9(spark, d):
    return book.ladder(src.book_levels(spark, d)).select("symbol", F.col("line").cast("long").alias("line"), "side", F.col("price").cast("double").alias("price"), F.col("qty").cast("double").alias("qty"))


@query("k10_a30_heatmap", f"""WITH {LEVELS}, x AS (SELECT symbol, min(price) AS low, max(price) AS high, min(snap_ms) AS from_ms, max(snap_ms) AS to_ms FROM levels GROUP BY symbol)
SELECT symbol, snap_ms, CAST(price AS DOUBLE) AS price, round(least(1.0::DOUBLE, CAST(qty AS DOUBLE) / 50), 6) AS heat, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, from_ms, to_ms FROM levels JOIN x USING (symbol)""")
def k10(spark, d):
    x = book.heatmap(src.book_levels(spark, d))
    return x.select("symbol", "snap_ms", F.col("price").cast("double").alias("price"), r6("heat"), F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), "from_ms", "to_ms")
