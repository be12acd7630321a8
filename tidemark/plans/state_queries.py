"""Registered queries over formats, predicates, logs and states: what consoles, logs and endpoints show."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import labels, scalars
from tidemark.operators import depth, interpret, reports, trades
from tidemark.plans.decision_queries import _ALL, _COMMITTED, _CTX, _OUT, _REASON, _committed, _contexts, _decided, _outcomes, _trends, _TRENDS
from tidemark.plans.registry import ALERTS, LEVELS, SIGNALS, TRADES, query
from tidemark.plans.trade_queries import CFG, r6
from tidemark.operators import outcomes as outc
from tidemark.session import shared_dir
from tidemark.sources import adapters as src
from tidemark.sources import readers, sinks

_SYMBOLS = "['click','error','purchase','signup','view']"
_ISO = "strftime(make_timestamp({ms} * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


def _pick(values, n):
    return F.get(F.array(*[F.lit(v) for v in values]), n.cast("int"))


# --- predicates and formats -----------------------------------------------------------------


@query("p8_absorption_upgrade", """WITH c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'BULLISH_ABSORPTION' WHEN 1 THEN 'BEARISH_ABSORPTION' END AS event, (c_acctbal - 4500) / 10000 AS imbalance FROM customer)
SELECT c_custkey, CASE WHEN event IS NOT NULL THEN CASE WHEN (event LIKE 'BULL%' AND imbalance >= 0.15) OR (event LIKE 'BEAR%' AND imbalance <= -0.15) THEN 'CONFIRMED_' ELSE 'POSSIBLE_' END || event END AS event FROM c""")
def p8(spark, d):
    c = src.table(spark, d, "customer")
    event = F.when(F.col("c_custkey") % 3 == 0, "BULLISH_ABSORPTION").when(F.col("c_custkey") % 3 == 1, "BEARISH_ABSORPTION")
    return c.select("c_custkey", labels.confirmed_absorption(event, (F.col("c_acctbal") - 4500) / 10000).alias("event"))


@query("p19_s1_s2_connection_status", """WITH o AS (SELECT o_orderkey, ['CONNECTED','RECONNECTING','DISCONNECTED','CONNECTED'][o_custkey % 4 + 1] AS status, o_orderkey % 9000 AS idle FROM orders)
SELECT o_orderkey, CASE WHEN status = 'CONNECTED' AND idle > 5000 THEN 'STALE' ELSE status END AS trades, CASE WHEN status = 'CONNECTED' AND idle > 3000 THEN 'STALE' ELSE status END AS depth FROM o""")
def p19(spark, d):
    o = src.table(spark, d, "orders")
    status, idle = _pick(("CONNECTED", "RECONNECTING", "DISCONNECTED", "CONNECTED"), F.col("o_custkey") % 4), F.col("o_orderkey") % 9000
    return o.select("o_orderkey", labels.connection(status, idle, 5000).alias("trades"), labels.connection(status, idle, 3000).alias("depth"))


@query("p10_p11_latencies", """WITH o AS (SELECT o_orderkey, o_orderkey * 10 AS event_ms, o_orderkey * 10 + o_custkey % 700 - 50 AS received, o_orderkey * 10 + o_custkey % 700 - 50 + o_orderkey % 3000 AS processed, o_custkey % 17 <> 0 AS valid FROM orders)
SELECT o_orderkey, greatest(0, received - event_ms) AS exchange_ms, greatest(0, processed - received) AS process_ms, CASE WHEN NOT valid THEN 'INVALID' WHEN greatest(0, processed - event_ms) <= 1000 THEN 'HEALTHY' WHEN greatest(0, processed - event_ms) <= 2500 THEN 'DEGRADED' ELSE 'STALE' END AS status FROM o""")
def p11(spark, d):
    event = F.col("o_orderkey") * 10
    received = event + F.col("o_custkey") % 700 - 50
    processed = received + F.col("o_orderkey") % 3000
    lag = labels.latency
    return src.table(spark, d, "orders").select("o_orderkey", lag(received, event).alias("exchange_ms"), lag(processed, received).alias("process_ms"), labels.health(F.col("o_custkey") % 17 != 0, lag(processed, event)).alias("status"))


@query("p28_order_quantity", "SELECT o_orderkey, CASE WHEN o_totalprice - 100000 > 0 AND o_custkey % 50 > 0 THEN round((o_totalprice - 100000) / (o_custkey % 50), 6) END AS quantity FROM orders")
def p28(spark, d):
    return src.table(spark, d, "orders").select("o_orderkey", F.round(labels.order_quantity(F.col("o_totalprice") - 100000, F.col("o_custkey") % 50), 6).alias("quantity"))


@query("p29_interpretation_age", "SELECT o_orderkey, o_orderkey % 200 > 60 OR o_custkey % 9 = 0 AS server, o_orderkey % 200 > 120 OR o_custkey % 9 = 0 AS browser FROM orders")
def p29(spark, d):
    age, fallback = F.col("o_orderkey") % 200, F.col("o_custkey") % 9 == 0
    return src.table(spark, d, "orders").select("o_orderkey", labels.expired(age, 60.0, fallback).alias("server"), labels.expired(age, 120.0, fallback).alias("browser"))


@query("f_compact_and_age", """WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 13 <> 0 THEN CAST(power(10, o_orderkey % 11) AS DOUBLE) * (o_custkey % 9 + 1) / 7 * CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE -1 END END AS v, CASE WHEN o_custkey % 7 <> 0 THEN o_orderkey * 37 % 20000 END AS s FROM orders)
SELECT o_orderkey, CASE WHEN v IS NULL THEN 'N/A' WHEN abs(v) >= 1e9 THEN printf('%.2fB', v / 1e9) WHEN abs(v) >= 1e6 THEN printf('%.2fM', v / 1e6) WHEN abs(v) >= 1e3 THEN printf('%.2fK', v / 1e3) ELSE printf('%.2f', v) END AS compact,
  CASE WHEN s IS NULL THEN 'N/A' WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago' ELSE (s // 3600) || 'h ago' END AS age, lpad(CAST(coalesce(s, 0) // 60 AS VARCHAR), CAST(greatest(2, len(CAST(coalesce(s, 0) // 60 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(coalesce(s, 0) % 60 AS VARCHAR), 2, '0') AS clock FROM o""")
def f_compact(spark, d):
    v = F.when(F.col("o_custkey") % 13 != 0, F.pow(F.lit(10.0), F.col("o_orderkey") % 11) * (F.col("o_custkey") % 9 + 1) / 7 * F.when(F.col("o_custkey") % 2 == 0, 1).otherwise(-1))
    s = F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderkey") * 37 % 20000)
    return src.table(spark, d, "orders").select("o_orderkey", scalars.compact_or_na(v).alias("compact"), scalars.age_text(s).alias("age"), scalars.clock(F.coalesce(s, F.lit(0))).alias("clock"))


_LEAKS = """['plain text ' || c_name, 'Authorization: Bearer ' || c_name || ' sent', '{"x-api-key": "' || c_name || '", "a": 1}', 'GET /v1?key=' || c_custkey || 'abc&x=1', 'failed with sk-' || 'proj-' || 'abcdefgh' || c_custkey || ' and own-' || c_custkey, 'AIza' || 'Sy0123456789' || c_custkey || ' refused'][c_custkey % 6 + 1]"""


@query("f_redact", f"""WITH t AS (SELECT c_custkey, replace({_LEAKS}, 'own-', '[REDACTED]') AS t FROM customer)
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN t WHEN 1 THEN 'Authorization: Bearer [REDACTED] sent' WHEN 2 THEN '{{"x-api-key": "[REDACTED]", "a": 1}}' WHEN 3 THEN 'GET /v1?key=[REDACTED]&x=1' WHEN 4 THEN 'failed with [REDACTED] and [REDACTED]' || c_custkey ELSE '[REDACTED] refused' END AS text FROM t""")
def f_redact(spark, d):
    # Invented credentials of the forms that are redacted; their heads stand apart so that scanners of this repository stay quiet.
    c, name, key = src.table(spark, d, "customer"), F.col("c_name"), F.col("c_custkey").cast("string")
    text = F.get(F.array(
        F.concat(F.lit("plain text "), name), F.concat(F.lit("Authorization: Bearer "), name, F.lit(" sent")), F.concat(F.lit('{"x-api-key": "'), name, F.lit('", "a": 1}')), F.concat(F.lit("GET /v1?key="), key, F.lit("abc&x=1")),
        F.concat(F.lit("failed with sk-"), F.lit("proj-abcdefgh"), key, F.lit(" and own-"), key), F.concat(F.lit("AIza"), F.lit("Sy0123456789"), key, F.lit(" refused"))), (F.col("c_custkey") % 6).cast("int"))
    return c.select("c_custkey", scalars.redact_credentials(text, ("own-",)).alias("text"))


@query("f_hash_stable_id", "SELECT o_orderkey, sha256(o_orderkey || '|' || o_orderstatus || '|' || o_custkey) AS id FROM orders")
def f_hash(spark, d):
    return src.table(spark, d, "orders").select("o_orderkey", scalars.stable_id(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_custkey")).alias("id"))


@query("u6_missing_header", "SELECT p_partkey, array_to_string(list_filter(['timestamp','symbol','price','reason'], lambda x: NOT list_contains(CASE p_partkey % 3 WHEN 0 THEN ['symbol','timestamp'] WHEN 1 THEN ['reason','price','symbol','timestamp'] ELSE ['other'] END, x)), ',') AS missing FROM part")
def u6(spark, d):
    names = lambda *x: F.array(*[F.lit(v) for v in x])
    found = F.when(F.col("p_partkey") % 3 == 0, names("symbol", "timestamp")).when(F.col("p_partkey") % 3 == 1, names("reason", "price", "symbol", "timestamp")).otherwise(names("other"))
    return src.table(spark, d, "part").select("p_partkey", F.array_join(sinks.missing_columns(names("timestamp", "symbol", "price", "reason"), found), ",").alias("missing"))


@query("t8_warm_up_text", f"""WITH {TRADES}, w AS (SELECT *, ms - min(ms) OVER (PARTITION BY symbol) AS seen FROM trades), c AS (SELECT *, CAST(floor(seen / 1000.0) AS BIGINT) AS s FROM w)
SELECT symbol, agg_id, """ + ", ".join(
    f"CASE WHEN seen < {ms} THEN 'WARMING ' || lpad(CAST(s // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || ' / {ms // 60000:02d}:00' ELSE 'READY' END AS warm_{w}" for w, ms in (("1m", 60000), ("5m", 300000), ("15m", 900000))) + " FROM c")
def t8(spark, d):
    t = src.trades(spark, d)
    return trades.warm_up(t, t, {"1m": 60_000, "5m": 300_000, "15m": 900_000}).select("symbol", "agg_id", "warm_1m", "warm_5m", "warm_15m")


# --- decisions, radar, interpretations --------------------------------------------------------


def _gate(name: str, test: str) -> str:
    return f"'{name}=' || CASE WHEN {test} THEN 'PASS' ELSE 'FAIL' END"


_LONG = ["1m_delta_positive", "delta_1m > 0"], ["buy_aggression", "buy_ratio_5m >= 0.58"], ["imbalance_bullish", "imb >= 0.15"], ["no_bearish_conflict", "NOT bearish"], ["stacking_bullish", "shift > 0"]
_SHORT = ["1m_delta_negative", "delta_1m < 0"], ["5m_delta_bias", "bs"], ["imbalance_bearish", "imb <= -0.15"], ["no_bullish_conflict", "NOT bullish"], ["sell_aggression", "buy_ratio_5m <= 0.42"], ["stacking_bearish", "shift < 0"]
_lists = {k: "[" + ", ".join(_gate(*g) for g in gates) + "]" for k, gates in {"long": (*_LONG, ["5m_delta_bias", "bl"]), "short": _SHORT, "both": (*_LONG, *_SHORT)}.items()}


@query("p18_u5_gates", f"""WITH RECURSIVE {_ALL}, {_COMMITTED} SELECT symbol, ms, array_to_string(list_sort(CASE WHEN valid = false THEN ['book_synced=FAIL'] WHEN snap_ms IS NULL THEN ['freshness=FAIL'] WHEN warming THEN ['warmup_complete=FAIL'] WHEN committed = 'COOLDOWN' THEN ['cooldown_inactive=FAIL'] WHEN lp > 0 AND lp = sp THEN {_lists['both']}
  WHEN lp > sp THEN {_lists['long']} WHEN sp > lp THEN {_lists['short']} WHEN bl AND bearish THEN {_lists['long']} WHEN bs AND bullish THEN {_lists['short']} ELSE {_lists['both']} END), ';') AS gates FROM tp JOIN (SELECT symbol, ms, committed FROM co) USING (symbol, ms)""")
def p18(spark, d):
    text = F.transform(F.array_sort(F.map_entries("gates")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return _committed(spark, d).select("symbol", "ms", F.array_join(text, ";").alias("gates"))


@query("a29_k7_interpretation_ranks", f"""WITH {TRADES}, {SIGNALS}, la AS (SELECT symbol, arg_max('CONFIRMED_' || direction, ms * 100000000 + signal_id) AS action FROM signals WHERE symbol <> 'view' GROUP BY symbol),
ef AS (SELECT signal_id, price, coalesce(action <> 'CONFIRMED_' || direction, false) AS enforced FROM signals s LEFT JOIN la USING (symbol)), n AS (SELECT count(*) FILTER (WHERE enforced) AS mismatches, count(*) AS symbols FROM ef)
SELECT CAST(signal_id AS VARCHAR) AS symbol, price AS confidence, mismatches, symbols FROM ef, n ORDER BY price DESC, CAST(signal_id AS VARCHAR) LIMIT 6""")
def a29(spark, d):
    """The six surest readings, with how many differ from the scanner's action."""
    s = src.signals(spark, d)
    la = s.where("symbol <> 'view'").groupBy("symbol").agg(F.max_by("action", F.struct("ms", "signal_id")).alias("action"))
    count = interpret.mismatches(interpret.enforce_actions(s.select("symbol", F.col("action").alias("bias")), la)).first()
    top = interpret.top_confidence(s.select(F.col("signal_id").cast("string").alias("symbol"), F.col("price").alias("confidence")), 6)
    return top.withColumns({"mismatches": F.lit(count.mismatches), "symbols": F.lit(count.symbols)})


@query("j9_s16_symbol_state", f"""WITH {_TRENDS}, f AS (SELECT symbol, count(*) AS trades, max(ms) AS last_ms FROM trades GROUP BY symbol), c AS (SELECT * FROM tr WHERE symbol <> 'view')
SELECT '{{"symbol":"' || symbol || '","trades":' || trades || ',"last_ms":' || last_ms || ',"trend_5m":' || coalesce('"' || trend_5m || '"', 'null') || ',"trend_15m":' || coalesce('"' || trend_15m || '"', 'null') || '}}' AS value FROM f LEFT JOIN c USING (symbol)""")
def j9(spark, d):
    """Every symbol as an endpoint would answer; one has no context."""
    flow = src.trades(spark, d).groupBy("symbol").agg(F.count("*").alias("trades"), F.max("ms").alias("last_ms"))
    return sinks.as_json(sinks.symbol_state(flow, _trends(spark, d).where("symbol <> 'view'").select("symbol", "trend_5m", "trend_15m")))


@query("w9_previous_ids", "WITH dd AS (SELECT ['click','error','purchase','signup','view'][(l_suppkey % 5) + 1] AS symbol, l_orderkey * 10 + l_linenumber AS pos, min(l_partkey) AS part FROM lineitem GROUP BY ALL), u AS (SELECT symbol, pos, pos - CASE WHEN part % 89 = 0 THEN 200 ELSE 0 END AS u FROM dd) SELECT symbol, pos, u, lag(u) OVER (PARTITION BY symbol ORDER BY pos) AS previous_u FROM u")
def w9(spark, d):
    return depth.previous_ids(src.depth_diffs(spark, d)).select("symbol", "pos", "u", "previous_u")


@query("a21_health_counters", """WITH h AS (SELECT ['click','error','purchase','signup','view'][(o_custkey % 5) + 1] AS symbol, o_orderkey AS ms, o_custkey % 11 AS kind, o_custkey % 400 AS value FROM orders)
SELECT symbol, count(*) FILTER (WHERE kind = 0) AS reconnects, coalesce(arg_max(value, ms) FILTER (WHERE kind BETWEEN 1 AND 5), 0) AS queue_depth FROM h GROUP BY symbol""")
def a21(spark, d):
    o = src.table(spark, d, "orders")
    kind = F.when(F.col("o_custkey") % 11 == 0, "RECONNECT").when(F.col("o_custkey") % 11 <= 5, "QUEUE").otherwise("PING")
    health = o.select(src._symbol(F.col("o_custkey") % 5).alias("symbol"), F.col("o_orderkey").alias("ms"), kind.alias("kind"), (F.col("o_custkey") % 400).alias("value"))
    quiet = health.select("symbol").distinct().select("symbol", F.lit("OK").alias("verdict"), F.lit(0).alias("epoch"))
    return reports.sync_counters(quiet, health).select("symbol", "reconnects", "queue_depth")


@query("a23_status_by_venue", """WITH s AS (SELECT n_regionkey AS venue, CASE WHEN n_regionkey = 0 AND n_nationkey % 3 = 0 THEN 'GAP' WHEN n_regionkey <= 1 AND n_nationkey % 2 = 0 THEN 'RESYNCING' WHEN n_regionkey = 2 THEN 'INITIALISING' ELSE 'HEALTHY' END AS st, n_regionkey = 3 AND n_nationkey % 4 = 0 AS warming FROM nation)
SELECT venue, bool_or(st = 'GAP') AS gap, bool_or(st = 'RESYNCING') AS resync, bool_and(st = 'HEALTHY') AS synced, bool_or(warming) AS warming,
  CASE WHEN bool_or(st = 'GAP') THEN 'SEQUENCE_GAP' WHEN bool_or(st = 'RESYNCING') THEN 'RESYNCING' WHEN bool_and(st = 'HEALTHY') THEN 'SYNCED' ELSE 'INITIALISING' END AS status, CASE WHEN bool_or(warming) THEN 'WARMING' ELSE 'VALID' END AS window_status FROM s GROUP BY venue""")
def a23(spark, d):
    r, n = F.col("n_regionkey"), F.col("n_nationkey")
    state = F.when((r == 0) & (n % 3 == 0), "GAP").when((r <= 1) & (n % 2 == 0), "RESYNCING").when(r == 2, "INITIALISING").otherwise("HEALTHY")
    x = src.table(spark, d, "nation").select(r.alias("venue"), state.alias("book_state"), ((r == 3) & (n % 4 == 0)).alias("warming"))
    return reports.global_status(x, ("venue",))


@query("k10_trade_bubbles", f"WITH {TRADES} SELECT symbol, agg_id, round(least(15.0, greatest(3.0, sqrt(CAST(notional * 400 AS DOUBLE)) / 100)), 6) AS radius FROM trades")
def k10(spark, d):
    t = src.trades(spark, d)
    return t.select("symbol", "agg_id", F.round(scalars.bubble_radius((F.col("notional") * 400).cast("double")), 6).alias("radius"))


# --- files ------------------------------------------------------------------------------------


_LI = """li AS (SELECT ['click','error','purchase','signup','view'][(l_suppkey % 5) + 1] AS symbol, l_orderkey * 10 + l_linenumber AS pos, min(l_partkey) AS part, min(l_quantity) AS q FROM lineitem GROUP BY ALL)"""


@query("s7_p5_depth_replay", f"""WITH {_LI}, good AS (SELECT * FROM li WHERE part % 23 <> 0)
SELECT symbol, pos AS u, pos * 2 AS ms, 'BID' AS side, CAST(part % 101 AS DOUBLE) AS price, CAST(q AS DOUBLE) AS qty FROM good UNION ALL SELECT symbol, pos, pos * 2, 'ASK', CAST(200 + part % 101 AS DOUBLE), CAST(0 AS DOUBLE) FROM good WHERE part % 2 = 0""")
def s7_depth(spark, d):
    """All depth messages through gzip JSON lines and back; every 23rd part's message is cut off and dropped."""
    path = shared_dir(spark)
    rows = src.table(spark, d, "lineitem").groupBy(src._symbol(F.col("l_suppkey") % 5).alias("symbol"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos")).agg(F.min("l_partkey").alias("part"), F.min("l_quantity").alias("q"))
    level = lambda p, q: F.array(F.array(p.cast("string"), q.cast("string")))
    asks = F.when(F.col("part") % 2 == 0, level(200 + F.col("part") % 101, F.lit(0))).otherwise(F.array().cast("array<array<string>>"))
    data = F.to_json(F.struct(F.lit("depthUpdate").alias("e"), (F.col("pos") * 2).alias("E"), (F.col("pos") - 1).alias("U"), F.col("pos").alias("u"), (F.col("pos") - 1).alias("pu"), level(F.col("part") % 101, F.col("q")).alias("b"), asks.alias("a")), {"ignoreNullFields": "true"})
    data = F.when(F.col("part") % 23 == 0, F.substring(data, 1, 20)).otherwise(data)
    sinks.write_recording(rows.select(F.concat("symbol", F.lit("@depth@100ms")).alias("stream"), data.alias("data"), (F.col("pos") * 0.002).alias("receive_time"), (F.col("pos") * 0.002).alias("exchange_time"), "symbol"), path)
    return readers.level_changes(readers.depth_of(readers.recordings(spark, path + "/*/*"))).select("symbol", "u", "ms", "side", "price", "qty")


@query("s3_rest_snapshots", f"""WITH {LEVELS}, l AS (SELECT symbol, max(snap_ms) AS snap_ms FROM levels GROUP BY symbol), x AS (SELECT * FROM levels JOIN l USING (symbol, snap_ms))
SELECT symbol, snap_ms AS last_id, side, CAST(price AS DOUBLE) AS price, CAST(qty AS DOUBLE) AS qty FROM x""")
def s3(spark, d):
    """The last book of each symbol as a REST snapshot, written and read back level by level."""
    path, lv = shared_dir(spark), src.book_levels(spark, d)
    last = lv.groupBy("symbol").agg(F.max("snap_ms").alias("snap_ms"))
    side = lambda s: F.collect_list(F.when(F.col("side") == s, F.array(F.col("price").cast("string"), F.col("qty").cast("string"))))
    snaps = lv.join(last, ["symbol", "snap_ms"]).groupBy(F.upper("symbol").alias("symbol"), F.col("snap_ms").alias("lastUpdateId")).agg(side("BID").alias("bids"), side("ASK").alias("asks"))
    snaps.write.json(path)
    x = readers.snapshots(spark, path).select("symbol", F.col("last_id").alias("u"), F.col("last_id").alias("ms"), "bids", "asks")
    return readers.level_changes(x).select("symbol", F.col("u").alias("last_id"), "side", "price", "qty")


@query("s9_transition_log", f"""WITH RECURSIVE {_ALL}, {_COMMITTED} SELECT {_ISO.format(ms='co.ms')} AS timestamp, symbol, old_action, committed AS new_action, round(co.price, 6) AS price, CASE WHEN {_REASON} LIKE '%SUPPRESSED%' THEN reason END AS suppression_reason, {_REASON} AS reason
FROM co JOIN decided USING (symbol, ms) WHERE committed <> old_action""")
def s9(spark, d):
    path = shared_dir(spark)
    changes = _committed(spark, d).where("committed <> old_action")
    sinks.append_csv(sinks.transition_rows(changes), path)
    back = spark.read.option("header", True).csv(path)
    return back.select("timestamp", "symbol", "old_action", "new_action", F.round(F.col("price").cast("double"), 6).alias("price"), "suppression_reason", "reason")


@query("s10_s20_signal_log", f"""WITH {_OUT}, p AS (SELECT s.signal_id, t.ms - s.ms AS gap, t.seq, t.price AS tp FROM signals s JOIN trades t ON t.symbol = s.symbol AND t.ms BETWEEN s.ms + 60000 AND s.ms + 1200000),
a AS (SELECT signal_id, arg_min(tp, seq) FILTER (WHERE gap BETWEEN 60000 AND 360000) AS after_1m FROM p GROUP BY signal_id)
SELECT CAST(signal_id AS VARCHAR) AS signal_id, s.symbol, s.direction, {_ISO.format(ms='ms')} AS entry_time, s.price AS entry_price, after_1m AS price_after_1m, best_15m AS max_favorable_pct, final_15m AS final_return_pct FROM signals s JOIN outc USING (signal_id) LEFT JOIN a USING (signal_id)""")
def s10(spark, d):
    """All finished signals as log lines with broken lines among them, read back without those."""
    path, t = shared_dir(spark), src.trades(spark, d)
    done = outc.horizon_prices(_outcomes(spark, d), t, cfg=CFG)
    sinks.append_csv(sinks.signal_rows(done), path)
    spark.range(50).select(F.concat(F.lit("broken,"), F.col("id").cast("string"), F.lit(",x,y,z,not a number,a,b,c"))).write.mode("append").text(path + "/more")
    x = readers.bias_signals(spark, [path, path + "/more"])
    return x.select("signal_id", "symbol", "direction", "entry_time", "entry_price", "price_after_1m", "max_favorable_pct", "final_return_pct")


@query("s11_context_log", f"""WITH {_CTX} SELECT CAST(c_custkey AS VARCHAR) AS id, symbol, trend_5m, round(premium, 6) AS mark_premium_pct, round(fpct, 6) AS funding_rate_pct, quality AS context_quality, CASE WHEN imbalance IS NULL THEN 1 ELSE 0 END + CASE WHEN quality <> 'OK' THEN 1 ELSE 0 END + CASE WHEN abs(fpct) >= 0.02 THEN 1 ELSE 0 END + CASE WHEN abs(p) >= 0.10 THEN 1 ELSE 0 END + CASE WHEN abs(rest - imbalance) >= 0.3 THEN 1 ELSE 0 END AS warnings FROM cs""")
def s11(spark, d):
    path = shared_dir(spark)
    # the customer's key stands in the index price's place, to tell rows apart
    sinks.append_csv(sinks.context_rows(_contexts(spark, d).withColumn("ms", F.col("c_custkey") * 1000).withColumn("open_interest", F.col("c_custkey"))), path)
    back = spark.read.option("header", True).csv(path)
    number = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)
    return back.select(F.col("open_interest").alias("id"), "symbol", "trend_5m", number("mark_premium_pct"), number("funding_rate_pct"), "context_quality", F.size(F.from_json("warnings_json", "array<string>")).alias("warnings"))


@query("s13_performance_log", f"WITH {_OUT} SELECT {_ISO.format(ms='ms')} AS timestamp, 'CONFIRMED_' || s.direction AS signal_type, s.price, " + ", ".join(f"""best_{h} AS "{h}_mfe_pct", worst_{h} AS "{h}_mae_pct", final_{h} AS "{h}_pnl_pct", CASE WHEN win_{h} THEN 'true' ELSE 'false' END AS "{h}_win\"""" for h in ("5m", "15m", "1h")) + " FROM signals s JOIN outc USING (signal_id)")
def s13(spark, d):
    path = shared_dir(spark)
    sinks.append_csv(sinks.performance_rows(_outcomes(spark, d)), path)
    back = spark.read.option("header", True).csv(path)
    return back.select("timestamp", "signal_type", F.col("price").cast("double").alias("price"), *[F.col(f"{h}_{p}").cast("double").alias(f"{h}_{p}") if p != "win" else F.col(f"{h}_win") for h in ("5m", "15m", "1h") for p in sinks.PERFORMANCE_PARTS])


@query("s12_audit_log", """SELECT c_custkey, '{"risk":"' || c_mktsegment || '","n":' || c_custkey % 5 || '}' AS interpretation_json, '["a","' || c_name || '"]' AS warnings, '2024-01-01T00:' || lpad(CAST(c_custkey % 60 AS VARCHAR), 2, '0') || ':00.000Z' AS timestamp FROM customer""")
def s12(spark, d):
    """Interpretations as audit lines, through CSV and back."""
    path, c = shared_dir(spark), src.table(spark, d, "customer")
    rows = c.select("c_custkey", F.struct(F.col("c_mktsegment").alias("risk"), (F.col("c_custkey") % 5).alias("n")).alias("interpretation_json"), F.array(F.lit("a"), "c_name").alias("warnings"), F.timestamp_seconds(1_704_067_200 + F.col("c_custkey") % 60 * 60).alias("timestamp"))
    sinks.append_csv(sinks.audit_rows(rows), path)
    return spark.read.schema("c_custkey long, interpretation_json string, warnings string, timestamp string").option("header", True).csv(path)


@query("s14_csv_tail", f"WITH {TRADES} SELECT CAST(agg_id AS VARCHAR) AS notes, symbol FROM trades ORDER BY agg_id DESC LIMIT 25")
def s14(spark, d):
    path = shared_dir(spark)
    rows = src.trades(spark, d).select(F.lpad(F.col("agg_id").cast("string"), 12, "0").alias("timestamp"), "symbol", F.col("agg_id").cast("string").alias("notes"))
    sinks.append_csv(sinks.flow_event_rows(rows), path)
    return readers.csv_tail(readers.flow_events(spark, path), "timestamp", 25).select("notes", "symbol")


@query("s15_rest_tables", """WITH m AS (SELECT ['click','error','purchase','signup','view'][(o_custkey % 5) + 1] AS symbol, o_orderkey AS key, o_orderkey * 7 AS time, CASE WHEN o_custkey % 19 <> 0 THEN o_totalprice END AS mark FROM orders)
SELECT symbol, time // 30000 AS fetch, arg_max(key, time) AS index_price, round(arg_max(coalesce(mark, -1), time), 6) AS mark FROM m GROUP BY ALL""")
def s15(spark, d):
    """Mark prices landed as JSON lines, some malformed; the last of each fetch of 30 seconds."""
    path = shared_dir(spark)
    rows = src.table(spark, d, "orders").select(
        F.upper(src._symbol(F.col("o_custkey") % 5)).alias("symbol"), F.when(F.col("o_custkey") % 19 != 0, F.col("o_totalprice").cast("string")).otherwise("none").alias("markPrice"),
        F.col("o_orderkey").cast("string").alias("indexPrice"), F.lit("0.0001").alias("lastFundingRate"), (F.col("o_orderkey") * 7).alias("time"))
    rows.write.json(path)
    spark.createDataFrame([('{"symbol": "cut',)], "value string").write.mode("append").text(path + "/more")
    last = readers.due(readers.rest_table(spark, [path, path + "/more"], "mark_prices"), "mark_prices")
    return last.select("symbol", "fetch", F.col("indexPrice").cast("long").alias("index_price"), F.round(F.coalesce("markPrice", F.lit(-1.0)), 6).alias("mark"))


@query("s18_mock_sweeps", "SELECT 'mock_' || i AS sweep_id, ['btc','eth','sol'][i % 3 + 1] AS symbol, epoch_us(make_timestamp((1700000000 + i * 60) * 1000000)) // 1000000 AS time_s, 'RAW_SWEEP' AS state, 'mock' AS source FROM range(500) t(i)")
def s18(spark, d):
    return readers.mock_sweeps(spark, ["btc", "eth", "sol"], 500).select("sweep_id", "symbol", F.unix_timestamp("time").alias("time_s"), "state", "source")
