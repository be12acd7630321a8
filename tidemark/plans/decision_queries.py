"""Registered queries over joins, folds, decisions, outcomes, reports, context and interpretations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.config import BEARISH_CONFLICTS, BULLISH_CONFLICTS
from tidemark.functions import labels, scalars
from tidemark.operators import book, context, decisions, depth, folds, interpret, outcomes, reports
from tidemark.plans.registry import ALERTS, BOOK, LEVELS, RANKED, SIGNALS, STACKING, SWEEPS, TRADES, query
from tidemark.plans.trade_queries import CFG, r6
from tidemark.session import written
from tidemark.sources import adapters as src

GRID = 60_000


def _book_features(spark, d):
    return _features_of(written(src.book_levels(spark, d)))


def _features_of(lv):
    """Snapshots with imbalance, spread, net shift and validity, written once; every 13th snapshot counts as out of sync."""
    x = book.book_metrics(lv).select("symbol", "snap_ms", F.round("imbalance", 9).alias("imbalance"), F.round("spread_bps", 6).alias("spread_bps"))
    shift = book.stacking(lv, 1_000_000, 2_000_000).select("symbol", "snap_ms", F.round("net_shift", 6).alias("net_shift"))
    return written(x.join(shift, ["symbol", "snap_ms"]).withColumn("valid", F.col("snap_ms") / 500_000 % 13 != 0))


def _parts(spark, d):
    return src.trades(spark, d), src.alerts(spark, d), _book_features(spark, d)


_FEATURES = f"{TRADES}, {SWEEPS}, {ALERTS}, {BOOK}, {STACKING}, bf AS (SELECT symbol, snap_ms, round(imbalance, 9) AS imbalance, round(net_shift, 6) AS net_shift, round((best_ask - best_bid) / mid * 10000, 6) AS spread_bps, snap_ms / 500000 % 13 <> 0 AS valid FROM (SELECT symbol, snap_ms, imbalance, best_bid, best_ask, mid FROM book) JOIN stack USING (symbol, snap_ms))"


def _points(cte: str, key: str) -> str:
    """CTEs that add to the points of ``cte`` what decisions need."""
    flow = ", ".join(
        f"CAST(coalesce(sum(t.signed) FILTER (WHERE p.ms - t.ms <= {ms}), 0) AS DOUBLE) AS delta_{w}, coalesce(CAST(sum(t.notional) FILTER (WHERE t.side = 'BUY' AND p.ms - t.ms <= {ms}) AS DOUBLE), 0) / nullif(CAST(sum(t.notional) FILTER (WHERE p.ms - t.ms <= {ms}) AS DOUBLE), 0) AS br_{w}"
        for w, ms in (("1m", 60000), ("5m", 300000), ("15m", 900000)))
    return f"""pf AS (SELECT p.{key}, {flow} FROM {cte} p LEFT JOIN trades t ON t.symbol = p.symbol AND t.ms BETWEEN p.ms - 900000 AND p.ms GROUP BY p.{key}),
pa AS (SELECT p.{key}, list(DISTINCT a.type) FILTER (WHERE a.type IS NOT NULL) AS types, list(DISTINCT a.type) FILTER (WHERE p.ms - a.ms <= 100000) AS fresh FROM {cte} p LEFT JOIN alerts a ON a.symbol = p.symbol AND a.ms BETWEEN p.ms - 900000 AND p.ms GROUP BY p.{key}),
pb AS (SELECT p.{key}, max(b.snap_ms) AS snap_ms FROM {cte} p LEFT JOIN bf b ON b.symbol = p.symbol AND b.snap_ms BETWEEN p.ms - 600000 AND p.ms GROUP BY p.{key}),
px AS (SELECT p.*, pf.* EXCLUDE ({key}), coalesce(pf.br_5m, 0.5) AS buy_ratio_5m, coalesce(types, []) AS types, coalesce(fresh, []) AS fresh, pb.snap_ms, bf.imbalance, bf.net_shift, bf.spread_bps, bf.valid
  FROM {cte} p JOIN pf USING ({key}) JOIN pa USING ({key}) JOIN pb USING ({key}) LEFT JOIN bf ON bf.symbol = p.symbol AND bf.snap_ms = pb.snap_ms)"""


_SCORED = _points("sweeps", "sweep_id") + """,
parts AS (SELECT *, CASE WHEN direction = 'BULLISH' THEN delta_15m <= -2000 OR list_contains(types, 'SELL_AGGRESSION') ELSE delta_15m >= 2000 OR list_contains(types, 'BUY_AGGRESSION') END AS pressure,
  CASE WHEN direction = 'BULLISH' THEN delta_5m >= -500 OR delta_1m > 0 ELSE delta_5m <= 500 OR delta_1m < 0 END AS recovering,
  CASE WHEN direction = 'BULLISH' THEN list_contains(types, 'POSSIBLE_BULLISH_ABSORPTION') ELSE list_contains(types, 'CONFIRMED_BEARISH_ABSORPTION') END AS absorbed,
  list_contains(types, direction || '_DIVERGENCE') AS diverged, CASE WHEN direction = 'BULLISH' THEN coalesce(imbalance >= 0.15, false) ELSE coalesce(imbalance <= -0.15, false) END AS leans FROM px),
scored AS (SELECT sweep_id, symbol, ms, direction, snap_ms, CASE WHEN pressure AND recovering THEN 2 WHEN recovering THEN 1 ELSE 0 END AS exhaustion, CASE WHEN absorbed THEN 3 ELSE 0 END AS absorption,
  CASE WHEN diverged THEN 2 ELSE 0 END AS divergence, CASE WHEN leans THEN 3 ELSE 0 END AS leaning FROM parts)"""


def _scored(spark, d, parts=None):
    t, a, b = parts or _parts(spark, d)
    return decisions.score_sweeps(src.sweeps(spark, d), t, a, b, CFG)


def _inputs(spark, d):
    """What the state machine knows at every tick; book features and scored sweeps are made once."""
    t, a, b = parts = _parts(spark, d)
    return decisions.decision_inputs(t, a, b, written(_scored(spark, d, parts)), GRID, CFG)


@query("a27_j4_sweep_score", f"""WITH {_FEATURES}, {_SCORED} SELECT sweep_id, symbol, direction, CAST(exhaustion AS BIGINT) AS exhaustion, CAST(absorption AS BIGINT) AS absorption, CAST(divergence AS BIGINT) AS divergence, CAST(leaning AS BIGINT) AS leaning,
  snap_ms IS NULL AS stale, CAST(exhaustion + absorption + divergence + leaning AS BIGINT) AS score, CASE WHEN exhaustion + absorption + divergence + leaning >= 5 THEN 'SWEEP_CONFLUENCE' ELSE 'LOW_CONFLUENCE' END AS status FROM scored""")
def a27(spark, d):
    return _scored(spark, d).select("sweep_id", "symbol", "direction", *[F.col(c).cast("long").alias(c) for c in ("exhaustion", "absorption", "divergence", "leaning")], "stale", F.col("score").cast("long").alias("score"), "status")


def _decided(spark, d):
    return decisions.evaluate(_inputs(spark, d), CFG)


def _in(types) -> str:
    return " OR ".join(f"list_contains(fresh, '{t}')" for t in types)


_DECIDED = f"""sc AS (SELECT sweep_id, symbol, ms, direction, exhaustion + absorption + divergence + leaning AS score FROM scored),
tk AS (SELECT symbol, (ms // 60000 + 1) * 60000 AS ms, arg_max(price, seq) AS price, symbol || ':' || ((ms // 60000 + 1) * 60000) AS tick FROM trades GROUP BY symbol, ms // 60000),
{_points("tk", "tick").replace("pf AS", "tf AS").replace("pa AS", "ta AS").replace("pb AS", "tb AS").replace("px AS", "tx AS").replace("JOIN pf ", "JOIN tf ").replace("JOIN pa ", "JOIN ta ").replace("JOIN pb ", "JOIN tb ").replace("pf.", "tf.").replace("pb.snap_ms", "tb.snap_ms")},
ts AS (SELECT p.tick, arg_max(s.score, s.ms * 100000000 + s.sweep_id) AS sscore, arg_max(s.direction, s.ms * 100000000 + s.sweep_id) AS sdir FROM tk p LEFT JOIN sc s ON s.symbol = p.symbol AND s.ms BETWEEN p.ms - 300000 AND p.ms GROUP BY p.tick),
ti AS (SELECT tx.*, coalesce(sscore >= 5, false) AND sdir = 'BULLISH' AS sl, coalesce(sscore >= 5, false) AND sdir = 'BEARISH' AS ss, tx.ms - (SELECT min(ms) FROM trades t WHERE t.symbol = tx.symbol) < 900000 AS warming,
  (SELECT max(b.snap_ms) FROM bf b WHERE b.symbol = tx.symbol AND b.snap_ms <= tx.ms) AS seen_ms,
  {_in(BEARISH_CONFLICTS)} AS bearish, {_in(BULLISH_CONFLICTS)} AS bullish FROM tx JOIN ts USING (tick)),
tg AS (SELECT *, coalesce(sl, false) AS swl, coalesce(ss, false) AS sws, coalesce(imbalance, 0) AS imb, coalesce(net_shift, 0) AS shift FROM ti),
th AS (SELECT *, delta_5m >= 1000 OR swl AS bl, delta_5m <= -1000 OR sws AS bs FROM tg),
tp AS (SELECT *,
  CASE WHEN bearish THEN 0 WHEN swl AND delta_1m > 0 THEN 2 WHEN swl THEN 1 WHEN bl AND buy_ratio_5m >= 0.58 AND imb >= 0.15 THEN CASE WHEN shift > 0 AND delta_1m > 0 THEN 2 ELSE 1 END WHEN bl OR (delta_5m > 300 AND buy_ratio_5m >= 0.55) THEN 1 ELSE 0 END AS lp,
  CASE WHEN bullish THEN 0 WHEN sws AND delta_1m < 0 THEN 2 WHEN sws THEN 1 WHEN bs AND buy_ratio_5m <= 0.42 AND imb <= -0.15 THEN CASE WHEN shift < 0 AND delta_1m < 0 THEN 2 ELSE 1 END WHEN bs OR (delta_5m < -300 AND buy_ratio_5m <= 0.45) THEN 1 ELSE 0 END AS sp FROM th),
decided AS (SELECT symbol, ms, price,
  CASE WHEN valid = false THEN 'DATA_INVALID' WHEN snap_ms IS NULL THEN 'DATA_STALE' WHEN warming THEN 'WARMING_UP' WHEN lp > 0 AND lp = sp THEN 'WAITING'
    WHEN lp > sp THEN CASE lp WHEN 2 THEN 'CONFIRMED_LONG' ELSE 'WATCH_LONG' END WHEN sp > lp THEN CASE sp WHEN 2 THEN 'CONFIRMED_SHORT' ELSE 'WATCH_SHORT' END ELSE 'WAITING' END AS action,
  CASE WHEN valid = false THEN 'Book sync invalid or sequence gap active' WHEN snap_ms IS NULL THEN 'Depth stale (age: ' || coalesce(ms - seen_ms, 9999) || 'ms)' WHEN warming THEN 'Rolling window is warming up' WHEN lp > 0 AND lp = sp THEN 'AMBIGUOUS_DIRECTIONAL_CONFLICT'
    WHEN lp > sp THEN CASE WHEN swl AND lp = 2 THEN 'Bullish sweep confluence confirmed' WHEN swl THEN 'Bullish sweep waiting for confirmation gates' WHEN lp = 2 THEN 'Bullish order flow bias confirmed'
      WHEN bl AND buy_ratio_5m >= 0.58 AND imb >= 0.15 THEN 'Flow bias watching stacking/pulling details' ELSE 'Delta/Aggression turning bullish' END
    WHEN sp > lp THEN CASE WHEN sws AND sp = 2 THEN 'Bearish sweep confluence confirmed' WHEN sws THEN 'Bearish sweep waiting for confirmation gates' WHEN sp = 2 THEN 'Bearish order flow bias confirmed'
      WHEN bs AND buy_ratio_5m <= 0.42 AND imb <= -0.15 THEN 'Flow bias watching stacking/pulling details' ELSE 'Delta/Aggression turning bearish' END
    WHEN bl AND bearish THEN 'LONG_SUPPRESSED:Bearish conflict active' WHEN bs AND bullish THEN 'SHORT_SUPPRESSED:Bullish conflict active' ELSE 'No active signal triggers' END AS reason,
  coalesce(valid = false, false) OR snap_ms IS NULL OR warming AS gated FROM tp)"""
_ALL = f"{_FEATURES}, {_SCORED}, {_DECIDED}"


_COMMITTED = """od AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ms) AS i FROM decided),
co AS (SELECT symbol, i, ms, price, 'WARMING_UP' AS old_action, action AS committed, CAST(CASE WHEN action <> 'WARMING_UP' THEN 1 ELSE 0 END AS BIGINT) AS version, CAST(CASE WHEN action LIKE 'CONFIRMED%' THEN ms + 180000 ELSE -1 END AS BIGINT) AS until FROM od WHERE i = 1
  UNION ALL SELECT o.symbol, o.i, o.ms, o.price, c.committed, CASE WHEN o.gated OR o.ms >= c.until THEN o.action ELSE 'COOLDOWN' END,
    c.version + CASE WHEN CASE WHEN o.gated OR o.ms >= c.until THEN o.action ELSE 'COOLDOWN' END <> c.committed THEN 1 ELSE 0 END,
    CASE WHEN (o.gated OR o.ms >= c.until) AND o.action LIKE 'CONFIRMED%' AND o.action <> c.committed THEN o.ms + 180000 ELSE c.until END
  FROM co c JOIN od o ON o.symbol = c.symbol AND o.i = c.i + 1)"""


# What a tick shows once the cooldown is known.
_REASON = "CASE WHEN committed = 'COOLDOWN' THEN printf('Signal cooldown active (%.1fs remaining)', (until - co.ms) / 1000.0) ELSE reason END"


def _committed(spark, d):
    return decisions.with_cooldowns(folds.commit_decisions(_decided(spark, d), CFG))


@query("t10_p18_bias_state", f"WITH RECURSIVE {_ALL}, {_COMMITTED} SELECT symbol, ms, committed AS action, {_REASON} AS reason, gated FROM co JOIN decided USING (symbol, ms)")
def t10(spark, d):
    return _committed(spark, d).select("symbol", "ms", F.col("committed").alias("action"), "reason", "gated")


@query("t4_w8_committed_decisions", f"WITH RECURSIVE {_ALL}, {_COMMITTED} SELECT symbol, ms, committed, version, CASE WHEN until >= 0 THEN until END AS cooldown_until FROM co")
def t4(spark, d):
    return _committed(spark, d).select("symbol", "ms", "committed", "version", "cooldown_until")


@query("w6_p26_transitions", f"""WITH RECURSIVE {_ALL}, {_COMMITTED} SELECT symbol, ms, old_action, committed AS new_action, round(price, 6) AS price,
  CASE committed WHEN 'CONFIRMED_LONG' THEN 'BUY' WHEN 'CONFIRMED_SHORT' THEN 'SELL' WHEN 'WATCH_LONG' THEN 'WATCH_LONG' WHEN 'WATCH_SHORT' THEN 'WATCH_SHORT' END AS alert FROM co WHERE committed <> old_action""")
def w6(spark, d):
    x = decisions.transitions(_committed(spark, d))
    return x.select("symbol", "ms", "old_action", F.col("committed").alias("new_action"), r6("price"), labels.transition_alert(F.col("old_action"), F.col("committed")).alias("alert"))


@query("a28_replay_summary", f"""WITH RECURSIVE {_ALL}, {_COMMITTED}, fl AS (SELECT symbol, count(*) AS trades, round(CAST(sum(signed) AS DOUBLE), 6) AS cvd FROM trades GROUP BY symbol),
cc AS (SELECT symbol, count(*) AS ticks, count(*) FILTER (WHERE committed <> old_action) AS transitions, arg_max(committed, ms) AS action FROM co GROUP BY symbol) SELECT * FROM fl LEFT JOIN cc USING (symbol)""")
def a28(spark, d):
    return reports.replay_summary(_committed(spark, d), src.trades(spark, d)).select("symbol", "trades", r6("cvd"), "ticks", "transitions", "action")


@query("j5_conflict_flags", f"""WITH {_ALL} SELECT symbol, ms, bearish, bullish, coalesce(snap_ms, -1) AS book_ms FROM ti""")
def j5(spark, d):
    x = _inputs(spark, d)
    return x.select("symbol", "ms", "bearish", "bullish", F.coalesce(F.col("ms") - F.col("book_age"), F.lit(-1)).alias("book_ms"))


@query("j6_latest_sweep", f"WITH {_ALL} SELECT tk.symbol, tk.ms, ts.sdir AS direction, CAST(ts.sscore AS BIGINT) AS score FROM tk JOIN ts USING (tick)")
def j6(spark, d):
    x = _inputs(spark, d)
    return x.select("symbol", "ms", F.col("sweep_direction").alias("direction"), F.col("sweep_score").cast("long").alias("score"))


@query("j15_decision_asof", f"WITH {_ALL} SELECT symbol, ms, round(delta_5m, 6) AS delta_5m, round(buy_ratio_5m, 6) AS buy_ratio_5m, imbalance, net_shift FROM tx")
def j15(spark, d):
    t, a, b = _parts(spark, d)
    ticks = t.groupBy("symbol", (F.floor(F.col("ms") / GRID) + 1).alias("cell")).count().select("symbol", (F.col("cell") * GRID).alias("ms"))
    return decisions.features_at(ticks, t, a, b, None, CFG).select("symbol", "ms", r6("delta_5m"), r6("buy_ratio_5m"), "imbalance", "net_shift")


# --- folds --------------------------------------------------------------------------------------


_DIFFS = """dd0 AS (SELECT ['click','error','purchase','signup','view'][(l_suppkey % 5) + 1] AS symbol, l_orderkey * 10 + l_linenumber AS pos, min(l_partkey) AS part FROM lineitem GROUP BY ALL),
diffs AS (SELECT symbol, pos, pos - CASE WHEN part % 89 = 0 THEN 200 ELSE 0 END AS u, CASE WHEN part % 97 = 0 THEN pos - 3 END AS pu, row_number() OVER (PARTITION BY symbol ORDER BY pos) AS i FROM dd0),
vd AS (SELECT symbol, i, pos, u AS seen, CAST(0 AS BIGINT) AS epoch, 'OK' AS verdict FROM diffs WHERE i = 1
  UNION ALL SELECT d.symbol, d.i, d.pos,
    CASE WHEN v.seen IS NULL THEN d.u WHEN d.u <= v.seen THEN v.seen WHEN d.pu < v.seen THEN v.seen WHEN d.pu > v.seen THEN NULL ELSE d.u END,
    v.epoch + CASE WHEN v.seen IS NOT NULL AND d.u > v.seen AND d.pu > v.seen THEN 1 ELSE 0 END,
    CASE WHEN v.seen IS NULL THEN 'OK' WHEN d.u <= v.seen THEN 'DUPLICATE' WHEN d.pu < v.seen THEN 'OUT_OF_ORDER' WHEN d.pu > v.seen THEN 'GAP' ELSE 'OK' END
  FROM vd v JOIN diffs d ON d.symbol = v.symbol AND d.i = v.i + 1)"""


@query("t2_w9_sequence_verdicts", f"WITH RECURSIVE {_DIFFS} SELECT symbol, pos, verdict, epoch FROM vd")
def t2(spark, d):
    return folds.sequence_verdicts(src.depth_diffs(spark, d), width=50_000).select("symbol", "pos", "verdict", "epoch")


@query("a21_sync_counters", f"WITH RECURSIVE {_DIFFS} SELECT symbol, count(*) AS messages, count(*) FILTER (WHERE verdict = 'GAP') AS gaps, count(*) FILTER (WHERE verdict = 'DUPLICATE') AS duplicates, count(*) FILTER (WHERE verdict = 'OUT_OF_ORDER') AS out_of_order, max(epoch) AS resyncs FROM vd GROUP BY symbol")
def a21(spark, d):
    return reports.sync_counters(folds.sequence_verdicts(src.depth_diffs(spark, d)))


@query("a23_global_status", f"""WITH RECURSIVE {_DIFFS}, la AS (SELECT symbol, arg_max(verdict, pos) AS v FROM vd GROUP BY symbol), s AS (SELECT symbol, CASE WHEN v = 'GAP' THEN 'RESYNCING' ELSE 'HEALTHY' END AS st FROM la)
SELECT false AS gap, bool_or(st = 'RESYNCING') AS resync, bool_and(st = 'HEALTHY') AS synced, CASE WHEN bool_or(st = 'RESYNCING') THEN 'RESYNCING' WHEN bool_and(st = 'HEALTHY') THEN 'SYNCED' ELSE 'INITIALISING' END AS status FROM s""")
def a23(spark, d):
    x = depth.book_states(folds.sequence_verdicts(src.depth_diffs(spark, d))).groupBy("symbol").agg(F.max_by("book_state", "pos").alias("book_state")).withColumn("warming", F.lit(False))
    return reports.global_status(x).select("gap", "resync", "synced", "status")


@query("t1_order_book", f"""WITH RECURSIVE {_DIFFS}, ch AS (SELECT v.symbol, v.epoch, v.pos AS u, CASE WHEN l_partkey % 3 = 0 THEN 'ASK' ELSE 'BID' END AS side, l_partkey % 101 AS price, l_quantity % 7 AS qty FROM vd v JOIN (SELECT ['click','error','purchase','signup','view'][(l_suppkey % 5) + 1] AS symbol, l_orderkey * 10 + l_linenumber AS pos, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) l USING (symbol, pos) WHERE verdict = 'OK'),
le AS (SELECT symbol, max(epoch) AS epoch FROM ch GROUP BY symbol) SELECT symbol, side, price, arg_max(qty, u) AS qty FROM ch JOIN le USING (symbol, epoch) GROUP BY ALL HAVING arg_max(qty, u) > 0""")
def t1(spark, d):
    v = folds.sequence_verdicts(src.depth_diffs(spark, d)).where("verdict = 'OK'")
    rows = src.table(spark, d, "lineitem").select(src._symbol(F.col("l_suppkey") % 5).alias("symbol"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), "l_partkey", "l_quantity")
    rows = rows.groupBy("symbol", "pos").agg(F.min("l_partkey").alias("p"), F.min("l_quantity").alias("q"))
    ch = v.join(rows, ["symbol", "pos"]).select("symbol", "epoch", F.col("pos").alias("u"), F.when(F.col("p") % 3 == 0, "ASK").otherwise("BID").alias("side"), (F.col("p") % 101).alias("price"), (F.col("q") % 7).alias("qty"))
    return depth.book_at_end(ch).select("symbol", "side", "price", "qty")


_DEPTH = f"""{_DIFFS}, sz AS (SELECT ['click','error','purchase','signup','view'][(l_suppkey % 5) + 1] AS symbol, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_partkey % 3 = 0 THEN 'ASK' ELSE 'BID' END AS side,
  CAST(CASE WHEN l_partkey % 3 = 0 THEN 100.02 + l_partkey % 60 * 0.02 ELSE 100 - l_partkey % 60 * 0.02 END AS DECIMAL(10,2)) AS price, CAST(max(l_quantity % 7) AS DECIMAL(10,2)) AS qty FROM lineitem GROUP BY ALL),
br AS (SELECT symbol, epoch - 1 AS epoch, min(pos) AS brk FROM vd GROUP BY ALL),
lf AS (SELECT *, lead(pos) OVER (PARTITION BY symbol, epoch, side, price ORDER BY pos) AS nxt FROM sz JOIN (SELECT symbol, pos, epoch FROM vd WHERE verdict = 'OK') USING (symbol, pos)),
lives AS (SELECT lf.*, least(coalesce(nxt, brk), coalesce(brk, nxt)) AS fin FROM lf LEFT JOIN br USING (symbol, epoch) WHERE qty > 0),
tck AS (SELECT DISTINCT ['click','error','purchase','signup','view'][(o_custkey % 5) + 1] AS symbol, o_orderkey * 10 + 9 AS pos FROM orders),
stand AS (SELECT t.symbol, t.pos, side, price, qty, row_number() OVER (PARTITION BY t.symbol, t.pos, side ORDER BY CASE WHEN side = 'BID' THEN -price ELSE price END) AS rk
  FROM tck t JOIN lives l ON l.symbol = t.symbol AND l.pos <= t.pos AND t.pos < coalesce(l.fin, 9000000000000000000)),
top AS (SELECT symbol, pos, max(price) FILTER (WHERE side = 'BID') AS best_bid, min(price) FILTER (WHERE side = 'ASK') AS best_ask, coalesce(sum(price * qty) FILTER (WHERE side = 'BID'), 0) AS b, coalesce(sum(price * qty) FILTER (WHERE side = 'ASK'), 0) AS a FROM stand WHERE rk <= 5 GROUP BY ALL)"""


def _depth_lives(spark, d):
    """Lives of levels and ticks: every line sets a level, every order asks for the book."""
    part = F.col("l_partkey")
    away = part % 60 * F.lit(0.02).cast("decimal(4,2)")
    price = F.when(part % 3 == 0, F.lit(100.02).cast("decimal(10,2)") + away).otherwise(F.lit(100).cast("decimal(10,2)") - away).cast("decimal(10,2)")
    changes = src.table(spark, d, "lineitem").select(
        src._symbol(F.col("l_suppkey") % 5).alias("symbol"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.when(part % 3 == 0, "ASK").otherwise("BID").alias("side"),
        price.alias("price"), (F.col("l_quantity") % 7).cast("decimal(10,2)").alias("qty"),
    )
    messages = written(folds.sequence_verdicts(src.depth_diffs(spark, d), width=50_000))
    ticks = src.table(spark, d, "orders").select(src._symbol(F.col("o_custkey") % 5).alias("symbol"), (F.col("o_orderkey") * 10 + 9).alias("pos"))
    return depth.level_lives(messages, changes, 50_000), ticks


@query("t1_s7_book_over_time", f"""WITH RECURSIVE {_DEPTH} SELECT symbol, pos, best_bid, best_ask, round(CAST(best_bid + best_ask AS DOUBLE) / 2, 6) AS mid, round(CAST(best_ask - best_bid AS DOUBLE) / (CAST(best_bid + best_ask AS DOUBLE) / 2) * 10000, 6) AS spread_bps,
  CASE WHEN coalesce(a + b, 0) > 0 THEN round(CAST(b - a AS DOUBLE) / CAST(a + b AS DOUBLE), 6) ELSE 0 END AS imbalance FROM tck LEFT JOIN top USING (symbol, pos)""")
def t1_over_time(spark, d):
    """The top of the book at every tick, from differences alone."""
    lives, ticks = _depth_lives(spark, d)
    x = depth.top_of_book(depth.book_at(lives, ticks), ticks)
    return x.select("symbol", "pos", "best_bid", "best_ask", *[r6(c) for c in ("mid", "spread_bps", "imbalance")])


@query("j1_t12_snapshot_sync", """WITH d AS (SELECT ['click','error','purchase','signup','view'][(l_suppkey % 5) + 1] AS symbol, l_orderkey * 10 AS first_u, max(l_orderkey * 10 + l_linenumber) AS u FROM lineitem GROUP BY ALL),
s AS (SELECT DISTINCT ['click','error','purchase','signup','view'][(o_custkey % 5) + 1] AS symbol, o_orderkey * 10 + 1 AS last_id FROM orders),
f AS (SELECT s.symbol, last_id, u AS mu, first_u AS fu FROM s ASOF LEFT JOIN d ON d.symbol = s.symbol AND s.last_id < d.u)
SELECT symbol, last_id, fu AS first_u, CASE WHEN mu IS NULL THEN 'SYNCING' WHEN fu <= last_id + 1 AND last_id + 1 <= mu THEN 'HEALTHY' ELSE 'GAP' END AS state FROM f""")
def j1(spark, d):
    li = src.table(spark, d, "lineitem")
    diffs = li.groupBy(src._symbol(F.col("l_suppkey") % 5).alias("symbol"), (F.col("l_orderkey") * 10).alias("first_u")).agg(F.max(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("u"))
    snaps = src.table(spark, d, "orders").select(src._symbol(F.col("o_custkey") % 5).alias("symbol"), (F.col("o_orderkey") * 10 + 1).alias("last_id")).distinct()
    return depth.sync_start(snaps, diffs)


@query("t3_event_cooldown", f"""WITH RECURSIVE {TRADES}, {ALERTS}, oa AS (SELECT *, row_number() OVER (PARTITION BY symbol, type, win ORDER BY ms, alert_id) AS i FROM alerts),
f AS (SELECT symbol, type, win, i, alert_id, ms AS lm, price AS lp, true AS accepted FROM oa WHERE i = 1
  UNION ALL SELECT o.symbol, o.type, o.win, o.i, o.alert_id, CASE WHEN o.ms - f.lm >= 120000 OR (f.lp > 0 AND o.price > 0 AND abs(o.price - f.lp) / f.lp >= 0.5) THEN o.ms ELSE f.lm END,
    CASE WHEN o.ms - f.lm >= 120000 OR (f.lp > 0 AND o.price > 0 AND abs(o.price - f.lp) / f.lp >= 0.5) THEN o.price ELSE f.lp END, o.ms - f.lm >= 120000 OR (f.lp > 0 AND o.price > 0 AND abs(o.price - f.lp) / f.lp >= 0.5)
  FROM f JOIN oa o ON o.symbol = f.symbol AND o.type = f.type AND o.win = f.win AND o.i = f.i + 1)
SELECT alert_id, accepted FROM f""")
def t3(spark, d):
    return folds.event_cooldown(src.alerts(spark, d), CFG).select("alert_id", "accepted")


@query("t5_signal_registration", f"""WITH RECURSIVE {TRADES}, {SIGNALS}, o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ms, signal_id) AS i FROM signals),
f AS (SELECT symbol, i, signal_id, ms AS lm, true AS registered FROM o WHERE i = 1 UNION ALL SELECT o.symbol, o.i, o.signal_id, CASE WHEN o.ms - f.lm >= 300000 THEN o.ms ELSE f.lm END, o.ms - f.lm >= 300000 FROM f JOIN o ON o.symbol = f.symbol AND o.i = f.i + 1)
SELECT signal_id, registered FROM f""")
def t5(spark, d):
    return folds.register_signals(src.signals(spark, d)).select("signal_id", "registered")


# A position per symbol as a list; only the order's own symbol changes. Leverage is 5, cash starts at 10,000.
_FILL = """bad AS (SELECT *, held[sy] AS h FROM {rows}),
gains AS (SELECT *, h.side IS NOT NULL AND h.side <> side AS opp, least(qty, h.qty) AS part, least(qty, h.qty) * (price - h.entry) * CASE WHEN h.side = 'BUY' THEN 1 ELSE -1 END AS g, qty - h.qty AS rest FROM bad),
back AS (SELECT *, cash + (part * h.entry / 5.0 + g) AS back FROM gains),
kinds AS (SELECT *, CASE WHEN qty <= 0 OR price <= 0 THEN 'REJECTED' WHEN opp AND qty < h.qty THEN 'PARTIAL_CLOSE' WHEN opp AND rest > 0 AND back >= rest * price / 5.0 THEN 'FLIP' WHEN opp THEN 'CLOSE' WHEN cash < qty * price / 5.0 THEN 'REJECTED' ELSE 'OPEN' END AS kind FROM back),
filled AS (SELECT *, CASE WHEN opp AND kind <> 'REJECTED' THEN g ELSE 0.0 END AS gain,
  CASE kind WHEN 'FLIP' THEN back - rest * price / 5.0 WHEN 'CLOSE' THEN back WHEN 'PARTIAL_CLOSE' THEN back WHEN 'OPEN' THEN cash - qty * price / 5.0 ELSE cash END AS cash_after,
  CASE kind WHEN 'FLIP' THEN {{'side': side, 'qty': rest, 'entry': price}} WHEN 'OPEN' THEN {{'side': side, 'qty': qty, 'entry': price}} WHEN 'PARTIAL_CLOSE' THEN {{'side': h.side, 'qty': h.qty - qty, 'entry': h.entry}} WHEN 'REJECTED' THEN h END AS pos FROM kinds)"""
_NONE = "CAST([NULL, NULL, NULL, NULL, NULL] AS STRUCT(side VARCHAR, qty DOUBLE, entry DOUBLE)[])"


def _orders(spark, d):
    """Purchases as orders; five users, who trade in a symbol each, share an account."""
    e = src._timed(spark, d).where("event_type = 'purchase'")
    return e.select(
        F.expr("user_id div 5").alias("account"), src._symbol(F.col("user_id") % 5).alias("symbol"), "ms", F.col("event_id").alias("order_id"),
        F.when(F.col("k") % 2 == 0, "BUY").otherwise("SELL").alias("side"), (F.col("k") % 10 + 1).cast("double").alias("qty"), F.col("value").alias("price"))


@query("t7_paper_orders", f"""WITH RECURSIVE {TRADES},
o AS (SELECT user_id // 5 AS account, user_id % 5 + 1 AS sy, event_id AS order_id, CASE WHEN k % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CAST(k % 10 + 1 AS DOUBLE) AS qty, value AS price, row_number() OVER (PARTITION BY user_id // 5 ORDER BY ms, event_id) AS i FROM e WHERE event_type = 'purchase'),
f AS (SELECT account, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS order_id, CAST(NULL AS VARCHAR) AS kind, 0.0::DOUBLE AS gain, 10000.0::DOUBLE AS cash, 0.0::DOUBLE AS realized, {_NONE} AS held FROM (SELECT DISTINCT account FROM o)
  UNION ALL (WITH {_FILL.format(rows="(SELECT o.*, f.cash, f.realized, f.held FROM f JOIN o ON o.account = f.account AND o.i = f.i + 1)")}
  SELECT account, i, order_id, kind, gain, cash_after, realized + gain, list_transform(held, lambda x, j: CASE WHEN j = sy THEN pos ELSE x END) FROM filled))
SELECT account, order_id, kind, round(gain, 6) AS gain, round(cash, 6) AS cash, round(realized, 6) AS realized, CAST(len(list_filter(held, lambda x: x IS NOT NULL)) AS BIGINT) AS n_held FROM f WHERE i > 0""")
def t7(spark, d):
    return folds.paper_orders(_orders(spark, d)).select("account", "order_id", "kind", r6("gain"), r6("cash"), r6("realized"), "n_held")


def _session_delta(spark, d):
    """(symbol, ms, cvd): the day's cumulative delta at every tick."""
    t = src.trades(spark, d).withColumn("v", scalars.signed(F.col("side"), F.col("notional")))
    cells = t.groupBy("symbol", "day", (F.floor(F.col("ms") / GRID) + 1).alias("cell")).agg(F.sum("v").alias("v"))
    run = Window.partitionBy("symbol", "day").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("cum", F.sum("v").over(run))
    return cells.groupBy("symbol", (F.col("cell") * GRID).alias("ms")).agg(F.max_by("cum", "day").cast("double").alias("cvd"))


_ENTRY = """cs AS (SELECT symbol, ms // 60000 + 1 AS cell, day, sum(signed) AS v FROM trades GROUP BY ALL),
cr AS (SELECT symbol, cell, day, sum(v) OVER (PARTITION BY symbol, day ORDER BY cell) AS cum FROM cs),
cd AS (SELECT symbol, cell * 60000 AS ms, CAST(arg_max(cum, day) AS DOUBLE) AS cvd FROM cr GROUP BY ALL),
en AS (SELECT co.symbol, co.ms, co.price, committed AS action,
  coalesce(valid, false) AND coalesce(spread_bps, 0) < 15 AND NOT (NOT warming AND delta_5m = delta_15m AND coalesce(br_5m, 0.5) = coalesce(br_15m, 0.5) AND delta_15m <> 0) AS usable,
  buy_ratio_5m AS r, coalesce(imbalance, 0) AS imb, cvd FROM co JOIN ti USING (symbol, ms) JOIN cd USING (symbol, ms))"""


@query("p24_p25_auto_trader", f"""WITH RECURSIVE {_ALL}, {_COMMITTED}, {_ENTRY},
ac AS (SELECT DISTINCT s_nationkey AS account, s_suppkey % 5 + 1 AS sy FROM supplier),
o AS (SELECT account, sy, symbol, ms, price, action, CASE WHEN usable AND action = 'CONFIRMED_LONG' AND r >= 0.58 AND imb >= 0.2 AND cvd > 0 THEN 'BUY' WHEN usable AND action = 'CONFIRMED_SHORT' AND r <= 0.42 AND imb <= -0.2 AND cvd < 0 THEN 'SELL' END AS entry,
  row_number() OVER (PARTITION BY account ORDER BY ms, symbol) AS i FROM ac JOIN en ON en.symbol = ['click','error','purchase','signup','view'][sy]),
f AS (SELECT account, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS symbol, CAST(NULL AS BIGINT) AS ms, CAST(NULL AS VARCHAR) AS closed, CAST(NULL AS VARCHAR) AS opened, 0.0::DOUBLE AS gain, 10000.0::DOUBLE AS cash, 0.0::DOUBLE AS realized,
    {_NONE} AS held, CAST([NULL, NULL, NULL, NULL, NULL] AS DOUBLE[]) AS marks FROM (SELECT DISTINCT account FROM o)
  UNION ALL (WITH r0 AS (SELECT o.*, f.cash, f.realized, f.held, f.held[o.sy] AS h, list_transform(f.marks, lambda x, j: CASE WHEN j = o.sy THEN o.price ELSE x END) AS marks FROM f JOIN o ON o.account = f.account AND o.i = f.i + 1),
  r1 AS (SELECT *, (price - h.entry) / h.entry * CASE WHEN h.side = 'BUY' THEN 1 ELSE -1 END AS profit FROM r0),
  r2 AS (SELECT *, CASE WHEN profit >= 0.01 THEN 'TAKE' WHEN profit <= -0.10 THEN 'STOP' WHEN h.side = 'BUY' AND action IN ('CONFIRMED_SHORT','WATCH_SHORT') THEN 'OPPOSITE' WHEN h.side = 'SELL' AND action IN ('CONFIRMED_LONG','WATCH_LONG') THEN 'OPPOSITE' END AS closed FROM r1),
  r3 AS (SELECT *, CASE WHEN closed IS NOT NULL AND price > 0 THEN h.qty * (price - h.entry) * CASE WHEN h.side = 'BUY' THEN 1 ELSE -1 END ELSE 0.0 END AS gain FROM r2),
  r4 AS (SELECT * EXCLUDE (cash, realized, held), CASE WHEN closed IS NOT NULL AND price > 0 THEN cash + (h.qty * h.entry / 5.0 + gain) ELSE cash END AS cash, realized + gain AS realized,
    CASE WHEN closed IS NOT NULL AND price > 0 THEN list_transform(held, lambda x, j: CASE WHEN j = sy THEN NULL ELSE x END) ELSE held END AS held FROM r3),
  r5 AS (SELECT *, CASE WHEN held[sy] IS NULL AND entry IS NOT NULL AND price > 0 THEN (cash + coalesce(list_sum(list_transform(held, lambda x, j: x.qty * (marks[j] - x.entry) * CASE WHEN x.side = 'BUY' THEN 1 ELSE -1 END)), 0)) * 0.10 * 5.0 / price END AS qty FROM r4),
  r6 AS (SELECT *, qty > 0 AND cash >= qty * price / 5.0 AS ok FROM r5)
  SELECT account, i, symbol, ms, closed, CASE WHEN ok THEN entry END, gain, CASE WHEN ok THEN cash - qty * price / 5.0 ELSE cash END, realized,
    CASE WHEN ok THEN list_transform(held, lambda x, j: CASE WHEN j = sy THEN {{'side': entry, 'qty': qty, 'entry': price}} ELSE x END) ELSE held END, marks FROM r6))
SELECT account, symbol, ms, closed, opened, round(gain, 6) AS gain, round(cash, 6) AS cash, round(realized, 6) AS realized FROM f WHERE i > 0""")
def p24(spark, d):
    """Every supplier nation is an account that trades in the symbols of its suppliers."""
    x = _committed(spark, d).join(_session_delta(spark, d), ["symbol", "ms"])
    doubled = ~F.col("warming") & (F.col("delta_5m") == F.col("delta_15m")) & (F.col("buy_ratio_5m") == F.col("buy_ratio_15m")) & (F.col("delta_15m") != 0)
    side = labels.entry_side(F.col("committed"), F.col("buy_ratio_5m"), F.coalesce("imbalance", F.lit(0.0)), F.col("cvd"), F.coalesce("valid", F.lit(False)), F.coalesce("spread_bps", F.lit(0.0)), doubled)
    accounts = src.table(spark, d, "supplier").select(F.col("s_nationkey").alias("account"), src._symbol(F.col("s_suppkey") % 5).alias("symbol")).distinct()
    ticks = x.select("symbol", "ms", "price", F.col("committed").alias("action"), side.alias("entry")).join(accounts, "symbol")
    return folds.auto_trader(ticks).select("account", "symbol", "ms", "closed", "opened", r6("gain"), r6("cash"), r6("realized"))


@query("t13_cached_interpretations", f"""WITH RECURSIVE {TRADES}, {ALERTS}, o AS (SELECT symbol AS scope, alert_id, ms, type, price > 20 AS ok, row_number() OVER (PARTITION BY symbol ORDER BY ms, alert_id) AS i FROM alerts),
f AS (SELECT scope, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS BIGINT) AS ms, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS BIGINT) AS at, CAST(NULL AS VARCHAR) AS hash FROM (SELECT DISTINCT scope FROM o)
  UNION ALL SELECT o.scope, o.i, o.alert_id, o.ms, CASE WHEN coalesce(o.ms - f.at <= 60000 AND f.hash = o.type, false) THEN 'CACHE' WHEN o.ok THEN 'CALL' WHEN f.at IS NOT NULL THEN 'FALLBACK' ELSE 'FAILED' END,
    CASE WHEN NOT coalesce(o.ms - f.at <= 60000 AND f.hash = o.type, false) AND o.ok THEN o.ms ELSE f.at END, CASE WHEN NOT coalesce(o.ms - f.at <= 60000 AND f.hash = o.type, false) AND o.ok THEN o.type ELSE f.hash END
  FROM f JOIN o ON o.scope = f.scope AND o.i = f.i + 1)
SELECT scope, request_id, ms, source FROM f WHERE i > 0""")
def t13(spark, d):
    a = src.alerts(spark, d)
    return folds.cached_interpretations(a.select(F.col("symbol").alias("scope"), "ms", F.col("alert_id").alias("request_id"), F.col("type").alias("input_hash"), (F.col("price") > 20).alias("ok"))).select("scope", "request_id", "ms", "source")


@query("t14_rate_limit", f"WITH {TRADES}, {ALERTS} SELECT symbol AS scope, ms, coalesce(ms - lag(ms) OVER (PARTITION BY symbol ORDER BY ms) >= 30000, true) AS allowed FROM (SELECT DISTINCT symbol, ms FROM alerts)")
def t14(spark, d):
    return interpret.rate_limited(src.alerts(spark, d).select(F.col("symbol").alias("scope"), "ms").distinct())


# --- outcomes and reports ---------------------------------------------------------------------


_H = (("5m", 300000), ("15m", 900000), ("1h", 3600000))
_OUT = f"{TRADES}, {SIGNALS}, mv AS (SELECT s.signal_id, t.ms - s.ms AS gap, t.seq, (t.price - s.price) / nullif(s.price, 0) * 100 * CASE WHEN direction = 'LONG' THEN 1 ELSE -1 END AS m FROM signals s JOIN trades t ON t.symbol = s.symbol AND t.ms > s.ms AND t.ms <= s.ms + 3600000), ma AS (SELECT signal_id, " + ", ".join(
    f"max(m) FILTER (WHERE gap <= {ms}) AS b_{h}, min(m) FILTER (WHERE gap <= {ms}) AS w_{h}, arg_max(m, seq) FILTER (WHERE gap <= {ms}) AS f_{h}" for h, ms in _H) + " FROM mv GROUP BY signal_id), outc AS (SELECT signal_id, symbol, direction, " + ", ".join(
    f"round(coalesce(b_{h}, 0), 4) + 0.0 AS best_{h}, round(coalesce(w_{h}, 0), 4) + 0.0 AS worst_{h}, round(coalesce(f_{h}, 0), 4) + 0.0 AS final_{h}, round(coalesce(f_{h}, 0), 4) > 0 AS win_{h}" for h, _ in _H) + " FROM signals LEFT JOIN ma USING (signal_id))"


def _outcomes(spark, d):
    return outcomes.forward_excursion(src.signals(spark, d), src.trades(spark, d))


@query("j7_a16_forward_excursion", f"WITH {_OUT} SELECT * FROM outc")
def j7(spark, d):
    return _outcomes(spark, d).select("signal_id", "symbol", "direction", *[f"{c}_{h}" for h, _ in _H for c in ("best", "worst", "final", "win")])


@query("a17_performance_report", f"WITH {_OUT} " + " UNION ALL ".join(
    f"SELECT '{h}' AS horizon, count(*) AS signals, round(count(*) FILTER (WHERE win_{h}) * 100 / count(*), 2) AS precision, " + ", ".join(f"round(CAST(sum(CAST({c}_{h} AS DECIMAL(18,4))) AS DOUBLE) / count(*), 4) AS {c}" for c in ("best", "worst", "final")) + " FROM outc" for h, _ in _H))
def a17(spark, d):
    return outcomes.performance_report(_outcomes(spark, d))


@query("a18_bias_performance", f"""WITH {_OUT} SELECT symbol, count(*) AS signals, count(*) FILTER (WHERE direction = 'LONG') AS longs, count(*) FILTER (WHERE direction = 'SHORT') AS shorts, round(count(*) FILTER (WHERE win_15m) * 100 / count(*), 4) AS win_rate,
  round(CAST(sum(CAST(final_15m AS DECIMAL(18,4))) AS DOUBLE) / count(*), 6) AS final, round(CAST(sum(CAST(best_15m AS DECIMAL(18,4))) AS DOUBLE) / count(*), 6) AS best, round(CAST(sum(CAST(worst_15m AS DECIMAL(18,4))) AS DOUBLE) / count(*), 6) AS worst FROM outc GROUP BY ROLLUP (symbol)""")
def a18(spark, d):
    return outcomes.bias_performance(_outcomes(spark, d))


@query("j8_horizon_prices", f"""WITH {TRADES}, {SIGNALS}, p AS (SELECT s.signal_id, t.ms - s.ms AS gap, t.seq, t.price AS tp FROM signals s JOIN trades t ON t.symbol = s.symbol AND t.ms BETWEEN s.ms + 60000 AND s.ms + 1200000),
a AS (SELECT signal_id, arg_min(tp, seq) FILTER (WHERE gap BETWEEN 60000 AND 360000) AS after_1m, arg_min(tp, seq) FILTER (WHERE gap BETWEEN 300000 AND 600000) AS after_5m, arg_min(tp, seq) FILTER (WHERE gap BETWEEN 900000 AND 1200000) AS after_15m FROM p GROUP BY signal_id)
SELECT signal_id, after_1m, after_5m, after_15m FROM signals LEFT JOIN a USING (signal_id)""")
def j8(spark, d):
    return outcomes.horizon_prices(src.signals(spark, d), src.trades(spark, d), cfg=CFG).select("signal_id", "after_1m", "after_5m", "after_15m")


@query("a19_event_totals", f"WITH {_FEATURES}, {_SCORED} SELECT count(*) AS events, count(DISTINCT symbol) AS symbols, count(exhaustion) AS scored, count(*) FILTER (WHERE exhaustion + absorption + divergence + leaning >= 5) AS confluences, round(CAST(sum(CAST(exhaustion + absorption + divergence + leaning AS DECIMAL(18,4))) AS DOUBLE) / count(*), 6) AS average_score FROM scored")
def a19(spark, d):
    return reports.event_totals(_scored(spark, d), 5)


@query("w12_k5_event_shares", f"WITH {TRADES}, {ALERTS}, c AS (SELECT type, count(*) AS n FROM alerts GROUP BY type) SELECT type, n, round(n * 100 / sum(n) OVER (), 4) AS percent FROM c")
def w12(spark, d):
    return reports.share_by(src.alerts(spark, d), "type")


@query("k4_notional_flow", f"WITH {TRADES}, f AS (SELECT symbol, sum(notional) AS v FROM trades GROUP BY symbol) SELECT symbol, CAST(v AS DOUBLE) AS notional, round(CAST(v AS DOUBLE) * 100 / CAST(sum(v) OVER () AS DOUBLE), 4) AS percent FROM f ORDER BY v DESC, symbol LIMIT 3")
def k4(spark, d):
    return reports.notional_flow(src.trades(spark, d), 3)


@query("p27_category_hotspots", f"""WITH {TRADES}, {ALERTS}, c AS (SELECT CASE WHEN contains(type, 'ABSORPTION') THEN 'ABSORPTION' WHEN contains(type, 'DIVERGENCE') THEN 'DIVERGENCE' WHEN contains(type, 'BURST') THEN 'BURST' WHEN contains(type, 'AGGRESSION') THEN 'AGGRESSION' END AS category, symbol FROM alerts),
n AS (SELECT category, symbol, count(*) AS n FROM c WHERE category IS NOT NULL GROUP BY ALL) SELECT category, symbol, n, row_number() OVER (PARTITION BY category ORDER BY n DESC, symbol) AS rank FROM n QUALIFY rank <= 5""")
def p27(spark, d):
    return reports.category_hotspots(src.alerts(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query("k6_tail", f"WITH {TRADES} SELECT symbol, agg_id, ms, price FROM trades QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) <= 20")
def k6(spark, d):
    return reports.tail(src.trades(spark, d), ["symbol"], ["ms", "agg_id"], 20).select("symbol", "agg_id", "ms", "price")


@query("a22_j13_portfolio", f"""WITH {TRADES}, {SIGNALS}, po AS (SELECT symbol, signal_id, CASE direction WHEN 'LONG' THEN 'BUY' ELSE 'SELL' END AS side, 2.0::DOUBLE AS qty, price AS entry FROM signals),
mk AS (SELECT symbol, arg_max(price, seq) AS mark FROM trades WHERE symbol <> 'view' GROUP BY symbol), r AS (SELECT qty * (coalesce(mark, entry) - entry) * CASE side WHEN 'BUY' THEN 1 ELSE -1 END AS pnl, qty * coalesce(mark, entry) AS val FROM po LEFT JOIN mk USING (symbol)),
s AS (SELECT count(*) AS n, CAST(sum(CAST(round(pnl, 6) AS DECIMAL(28,6))) AS DOUBLE) AS unrealized, CAST(sum(CAST(round(val, 6) AS DECIMAL(28,6))) AS DOUBLE) AS value FROM r)
SELECT n, round(unrealized, 4) AS unrealized, round(value, 4) AS value, round(5000 + unrealized, 4) AS equity FROM s""")
def a22(spark, d):
    pos = src.signals(spark, d).select("symbol", F.when(F.col("action") == "CONFIRMED_LONG", "BUY").otherwise("SELL").alias("side"), F.lit(2.0).alias("qty"), F.col("price").alias("entry"))
    marks = src.trades(spark, d).where("symbol <> 'view'").groupBy("symbol").agg(F.max_by("price", F.struct("ms", "agg_id")).alias("mark"))
    return reports.portfolio(pos, marks, 5000.0).select("n", *[F.round(c, 4).alias(c) for c in ("unrealized", "value", "equity")])


@query("j14_u3_new_sweeps", f"WITH {TRADES}, {SWEEPS} SELECT sweep_id, symbol FROM sweeps WHERE sweep_id NOT IN (SELECT event_id FROM e WHERE k % 3 = 0)")
def j14(spark, d):
    s = src.sweeps(spark, d)
    done = src._timed(spark, d).where("k % 3 = 0").select(F.col("event_id").alias("sweep_id"))
    return reports.new_rows(s.unionByName(s), done, "sweep_id").select("sweep_id", "symbol")


@query("j12_symbol_keys", "SELECT c_custkey, CASE WHEN regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') LIKE '%USDT' THEN regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') ELSE regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') || 'USDT' END AS key FROM customer")
def j12(spark, d):
    return src.table(spark, d, "customer").select("c_custkey", scalars.symbol_key(F.col("c_name")).alias("key"))


# --- context and interpretations ------------------------------------------------------------------


_KL = f"{TRADES}, kl AS (SELECT symbol, arg_min(price, seq) AS o, arg_max(price, seq) AS c, ms // {{w}} AS bar FROM trades GROUP BY symbol, ms // {{w}})"


def _trend(p: str) -> str:
    return f"CASE WHEN {p}.o <= 0 THEN 'flat' WHEN ({p}.c - {p}.o) / {p}.o * 100 >= 0.02 THEN 'up' WHEN ({p}.c - {p}.o) / {p}.o * 100 <= -0.02 THEN 'down' ELSE 'flat' END"


_K = TRADES + ", " + ", ".join(
    f"k{w} AS (SELECT symbol, arg_max(o, bar) AS o, arg_max(c, bar) AS c FROM (SELECT symbol, ms // {ms} AS bar, arg_min(price, seq) AS o, arg_max(price, seq) AS c FROM trades GROUP BY ALL) GROUP BY symbol)" for w, ms in (("1m", 60000), ("5m", 300000), ("15m", 900000)))
_TRENDS = _K + f", tr AS (SELECT symbol, {_trend('k1m')} AS trend_1m, {_trend('k5m')} AS trend_5m, {_trend('k15m')} AS trend_15m FROM k1m JOIN k5m USING (symbol) JOIN k15m USING (symbol))"


def _trends(spark, d):
    t, at = src.trades(spark, d), F.struct("ms", "agg_id")
    parts = [t.groupBy("symbol", F.floor(F.col("ms") / ms).alias("ms")).agg(F.min_by("price", at).alias("open"), F.max_by("price", at).alias("close")).withColumn("interval", F.lit(w)) for w, ms in (("1m", 60_000), ("5m", 300_000), ("15m", 900_000))]
    return context.kline_trends(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("p12_kline_trend", f"WITH {_TRENDS} SELECT * FROM tr")
def p12(spark, d):
    return _trends(spark, d)


_CTX = _TRENDS + f""", {BOOK}, lb AS (SELECT symbol, arg_max(imbalance, snap_ms) AS imbalance FROM book GROUP BY symbol),
rw AS (SELECT c_custkey, symbol, ['CONFIRMED_LONG','WATCH_SHORT','WAITING'][c_custkey % 3 + 1] AS action, CASE WHEN c_custkey % 11 <> 0 THEN 100 + c_acctbal / 50000 END AS mark, CAST(100 AS DOUBLE) AS idx, c_acctbal / 500000 * 1.0 AS funding, CAST(5 AS DOUBLE) AS oi, c_acctbal AS oi_change, c_acctbal / 10000 AS rest
  FROM (SELECT *, ['click','error','purchase','signup','view'][c_nationkey % 5 + 1] AS symbol FROM customer)),
cx AS (SELECT rw.*, trend_5m, trend_15m, round(imbalance, 9) AS imbalance, (mark - idx) / idx * 100 AS premium, funding * 100 AS fpct, CASE WHEN mark IS NULL OR trend_5m IS NULL THEN 'STALE' ELSE 'OK' END AS quality FROM rw LEFT JOIN tr USING (symbol) LEFT JOIN lb USING (symbol)),
cs AS (SELECT *, CAST(trend_5m = 'up' AS INT) + CAST(trend_15m = 'up' AS INT) + CAST(rest > 0 AS INT) + CAST(oi_change > 0 AS INT) AS ls, CAST(trend_5m = 'down' AS INT) + CAST(trend_15m = 'down' AS INT) + CAST(rest < 0 AS INT) + CAST(oi_change > 0 AS INT) AS sh, coalesce(premium, 0) AS p FROM cx)"""


def _contexts(spark, d):
    c = src.table(spark, d, "customer")
    snaps = book.book_metrics(src.book_levels(spark, d)).groupBy("symbol").agg(F.round(F.max_by("imbalance", "snap_ms"), 9).alias("imbalance"))
    rows = c.select(
        "c_custkey", src._symbol(F.col("c_nationkey") % 5).alias("symbol"), F.get(F.array(F.lit("CONFIRMED_LONG"), F.lit("WATCH_SHORT"), F.lit("WAITING")), (F.col("c_custkey") % 3).cast("int")).alias("action"),
        F.when(F.col("c_custkey") % 11 != 0, 100 + F.col("c_acctbal") / 50000).alias("mark"), F.lit(100.0).alias("index"), (F.col("c_acctbal") / 500000 * 1.0).alias("funding_rate"), F.lit(5.0).alias("open_interest"),
        F.col("c_acctbal").alias("oi_change_pct"), (F.col("c_acctbal") / 10000).alias("rest_imbalance"))
    return context.market_context(rows.join(_trends(spark, d), "symbol", "left").join(snaps, "symbol", "left"))


@query("p13_p16_market_context", f"""WITH {_CTX} SELECT c_custkey, round(premium, 6) AS premium_pct, quality,
  array_to_string(list_filter([CASE WHEN quality <> 'OK' THEN 'context quality ' || quality END, CASE WHEN abs(fpct) >= 0.02 THEN 'elevated funding' END, CASE WHEN abs(p) >= 0.10 THEN 'mark/index premium stretched' END,
    CASE WHEN abs(rest - imbalance) >= 0.3 THEN 'REST/WS book imbalance drift high' END, CASE WHEN imbalance IS NULL THEN 'local WS imbalance unavailable' END], lambda x: x IS NOT NULL), ';') AS warnings,
  CASE WHEN quality <> 'OK' THEN NULL WHEN action LIKE '%LONG%' THEN CASE WHEN ls >= 3 AND p > -0.05 THEN 'CONFIRMED' WHEN sh >= 2 OR p > 0.12 THEN 'CONFLICTING' ELSE 'MIXED' END
    WHEN action LIKE '%SHORT%' THEN CASE WHEN sh >= 3 AND p < 0.08 THEN 'CONFIRMED' WHEN ls >= 2 THEN 'CONFLICTING' ELSE 'MIXED' END ELSE 'INSUFFICIENT' END AS label FROM cs""")
def p13(spark, d):
    return _contexts(spark, d).select("c_custkey", r6("premium_pct"), "quality", F.array_join("warnings", ";").alias("warnings"), "label")


@query("a24_context_status", f"WITH {_CTX} SELECT count(*) AS symbols, count(*) FILTER (WHERE quality = 'OK') AS ok_count, CASE WHEN count(*) = count(*) FILTER (WHERE quality = 'OK') THEN 'OK' WHEN count(*) FILTER (WHERE quality = 'OK') > 0 THEN 'PARTIAL' ELSE 'STALE' END AS quality FROM cx")
def a24(spark, d):
    return reports.context_status(_contexts(spark, d))


@query("w7_open_interest_change", f"""WITH {TRADES}, b AS (SELECT symbol, ms // 600000 AS bar, CAST(sum(quantity) AS DOUBLE) AS oi FROM trades GROUP BY ALL), l AS (SELECT *, lag(oi) OVER (PARTITION BY symbol ORDER BY bar) AS prev FROM b)
SELECT symbol, bar AS ms, oi AS open_interest, round(CASE WHEN prev > 0 THEN (oi - prev) / prev * 100 END, 6) AS oi_change_pct FROM l""")
def w7(spark, d):
    x = src.trades(spark, d).groupBy("symbol", F.floor(F.col("ms") / 600_000).alias("ms")).agg(F.sum("quantity").alias("open_interest"))
    return context.open_interest_change(x).select("symbol", "ms", "open_interest", r6("oi_change_pct"))


@query("a26_rest_imbalance", "SELECT p_partkey, CASE WHEN b + a > 0 THEN round((b - a) / (b + a), 6) END AS imbalance FROM (SELECT p_partkey, CAST(p_size * 2 AS DOUBLE) * 3 AS b, p_retailprice * 1 AS a FROM part)")
def a26(spark, d):
    side = lambda p, q: F.array(F.array(p.cast("string"), q.cast("string")))
    x = src.table(spark, d, "part")
    return x.select("p_partkey", F.round(book.rest_imbalance(side(F.col("p_size") * 2, F.lit(3)), side(F.col("p_retailprice"), F.lit(1))), 6).alias("imbalance"))


@query("i1_compact_snapshot", f"""WITH {TRADES}, {SIGNALS}, s AS (SELECT symbol, signal_id, price, CAST(round_even(price * 77 / 1000, 0) * 1000 AS BIGINT) AS delta_1m FROM signals) SELECT signal_id, symbol, delta_1m FROM s""")
def i1(spark, d):
    x = src.signals(spark, d).select("signal_id", "symbol", "price", (F.col("price") * 77).alias("delta_1m"), F.lit(0.0).alias("delta_5m"), F.lit(0.0).alias("delta_15m"), F.lit(0.0).alias("cvd"), F.lit(0.125).alias("imbalance"), "action")
    y = interpret.compact_snapshot(x.withColumn("symbol", F.concat("symbol", F.lit(":"), "signal_id")))
    return y.select(F.split_part("symbol", F.lit(":"), F.lit(2)).cast("long").alias("signal_id"), F.split_part("symbol", F.lit(":"), F.lit(1)).alias("symbol"), "delta_1m")


@query("i5_j11_enforced_actions", f"""WITH {TRADES}, {SIGNALS}, la AS (SELECT symbol, arg_max('CONFIRMED_' || direction, ms * 100000000 + signal_id) AS action FROM signals WHERE symbol <> 'view' GROUP BY symbol)
SELECT signal_id, s.symbol, coalesce(action, 'CONFIRMED_' || direction) AS bias, CASE WHEN action <> 'CONFIRMED_' || direction THEN 'CONFIRMED_' || direction END AS reported_bias, coalesce(action <> 'CONFIRMED_' || direction, false) AS enforced FROM signals s LEFT JOIN la USING (symbol)""")
def i5(spark, d):
    s = src.signals(spark, d)
    la = s.where("symbol <> 'view'").groupBy("symbol").agg(F.max_by("action", F.struct("ms", "signal_id")).alias("action"))
    return interpret.enforce_actions(s.select("signal_id", "symbol", F.col("action").alias("bias")), la).select("signal_id", "symbol", "bias", "reported_bias", "enforced")


@query("i6_freshness", f"WITH {LEVELS}, m AS (SELECT max(snap_ms) AS now FROM levels), l AS (SELECT symbol, max(snap_ms) AS s FROM levels GROUP BY symbol) SELECT min(28450000000 - s) AS age_ms, coalesce(min(28450000000 - s) <= 30000, false) AS fresh FROM l")
def i6(spark, d):
    x = src.book_levels(spark, d).groupBy("symbol").agg(F.max("snap_ms").alias("depth_ms"))
    return interpret.freshness(x, F.lit(28_450_000_000))


@query("i8_provider_comparison", """WITH a AS (SELECT ['alpha','beta','gamma'][o_custkey % 3 + 1] AS provider, o_orderpriority AS model, o_orderkey AS ms, o_orderstatus <> 'P' AS ok, o_custkey % 7 = 0 AS rep, o_custkey % 5 = 0 AS fb, o_custkey % 1000 AS lat FROM orders)
SELECT provider, model, count(*) AS calls, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE rep) AS repaired, count(*) FILTER (WHERE fb) AS fallbacks, round(CAST(sum(lat) AS DOUBLE) / count(lat), 4) AS latency_ms, arg_max('e' || ms, ms) FILTER (WHERE NOT ok) AS last_error FROM a GROUP BY ALL""")
def i8(spark, d):
    o = src.table(spark, d, "orders")
    a = o.select(
        F.get(F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma")), (F.col("o_custkey") % 3).cast("int")).alias("provider"), F.col("o_orderpriority").alias("model"), F.col("o_orderkey").alias("ms"), (F.col("o_orderstatus") != "P").alias("ok"),
        (F.col("o_custkey") % 7 == 0).alias("schema_repaired"), (F.col("o_custkey") % 5 == 0).alias("fallback_used"), (F.col("o_custkey") % 1000).alias("latency_ms"), F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("error"))
    return interpret.provider_comparison(a)


_JSON = """SELECT c_custkey, '{"summary":"' || c_name || '","overall_risk":"' || CASE c_custkey % 3 WHEN 0 THEN 'High risk' WHEN 1 THEN 'low' ELSE 'x' END || '","market_regime":"' || CASE c_custkey % 2 WHEN 0 THEN 'CHOPPY market' ELSE '?' END || '","symbols":{"btc":"quiet"},"warnings":"w' || c_custkey || '"}' AS response FROM customer"""


@query("i3_schema_repair", f"""WITH j AS ({_JSON}) SELECT c_custkey, json_extract_string(response, '$.summary') AS market_summary, CASE c_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS overall_risk,
  CASE c_custkey % 2 WHEN 0 THEN 'choppy' ELSE 'mixed' END AS regime, 'quiet' AS btc, 'w' || c_custkey AS warning, true AS changed FROM j""")
def i3(spark, d):
    x = interpret.repair(src.table(spark, d, "customer").selectExpr(_JSON.removeprefix("SELECT ").split(",", 1)[0], _JSON.split(",", 1)[1].removesuffix(" FROM customer")))
    r = F.col("repaired")
    return x.select("c_custkey", r["market_summary"].alias("market_summary"), r["overall_risk"].alias("overall_risk"), r["regime"].alias("regime"), F.element_at(r["symbol_interpretations"], "BTC")["explanation"].alias("btc"), F.get(r["data_quality_warnings"], F.lit(0)).alias("warning"), "changed")


@query("i4_validation", f"WITH j AS ({_JSON}) SELECT c_custkey, 'Missing required JSON schema key: ''market_summary''.' AS error FROM j")
def i4(spark, d):
    x = src.table(spark, d, "customer").selectExpr("c_custkey", _JSON.split(",", 1)[1].removesuffix(" FROM customer"))
    return x.select("c_custkey", interpret.validation_error(F.col("response")).alias("error"))
