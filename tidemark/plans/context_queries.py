"""Registered queries over stored responses of services, and over counters that running queries keep."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidemark.operators import context, folds, health, interpret
from tidemark.plans.decision_queries import _CTX, _DIFFS, _TRENDS, _contexts
from tidemark.plans.registry import SIGNALS, TRADES, query
from tidemark.plans.trade_queries import r6
from tidemark.session import shared_dir
from tidemark.sources import adapters as src
from tidemark.sources import sinks


def _responses(spark, d):
    """What each endpoint has answered for each symbol, every ten minutes, and the last klines; one symbol's ticker is broken."""
    t, at = src.trades(spark, d), F.struct("ms", "agg_id")
    text = lambda c: c.cast("string")
    bars = t.groupBy("symbol", F.floor(F.col("ms") / 600_000).alias("bar")).agg(F.max_by("price", at).alias("close"), F.sum("quantity").alias("oi"), F.count("*").alias("n"))
    price = F.struct(text(F.col("close")).alias("markPrice"), F.lit("100.0").alias("indexPrice"), F.lit("0.0001").alias("lastFundingRate"), (F.col("bar") * 600_000 + 28_800_000).alias("nextFundingTime"))
    side = lambda size: F.array(F.array(F.lit("2.0"), text(size)), F.array(F.lit("x"), F.lit("1")))
    bodies = {
        "premiumIndex": F.to_json(price), "openInterest": F.to_json(F.struct(text(F.col("oi")).alias("openInterest"))), "depth": F.to_json(F.struct(side(F.col("n")).alias("bids"), side(F.col("oi")).alias("asks"))),
        "bookTicker": F.when(F.col("symbol") == "view", "<html>").otherwise(F.to_json(F.struct(text(F.col("close") - 1).alias("bidPrice"), text(F.col("close") + 1).alias("askPrice")))),
    }
    rows = bars.select("symbol", (F.col("bar") * 600_000).alias("ms"), F.explode(F.map_from_arrays(F.array(*map(F.lit, bodies)), F.array(*bodies.values()))).alias("endpoint", "body"))
    for interval, ms in (("1m", 60_000), ("5m", 300_000), ("15m", 900_000)):
        cells = t.groupBy("symbol", F.floor(F.col("ms") / ms).alias("cell")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"))
        line = F.array(text(F.col("cell") * ms), *[text(F.col(c)) for c in ("open", "high", "low", "close")])
        last = cells.groupBy("symbol").agg(F.max("cell").alias("last"))
        two = cells.join(last, "symbol").where("cell >= last - 1").groupBy("symbol").agg(F.to_json(F.array_sort(F.collect_list(line))).alias("body"))
        rows = rows.unionByName(two.select("symbol", F.lit(0).cast("long").alias("ms"), F.lit(f"klines_{interval}").alias("endpoint"), "body"))
    return rows


@query("s15_context_tables", f"""WITH {_TRENDS}, bars AS (SELECT symbol, ms // 600000 AS bar, arg_max(price, seq) AS close, CAST(sum(quantity) AS DOUBLE) AS oi, count(*) AS n FROM trades GROUP BY ALL),
b AS (SELECT *, lag(oi) OVER (PARTITION BY symbol ORDER BY bar) AS prev, row_number() OVER (PARTITION BY symbol ORDER BY bar DESC) AS k FROM bars)
SELECT symbol, close AS mark, CAST(100 AS DOUBLE) AS "index", CAST(0.0001 AS DOUBLE) AS funding_rate, bar * 600000 + 28800000 AS next_funding, round(CASE WHEN symbol <> 'view' THEN close - 1 END, 6) AS bid, round(CASE WHEN symbol <> 'view' THEN close + 1 END, 6) AS ask,
  round((n - oi) / (n + oi), 6) AS rest_imbalance, oi AS open_interest, round(CASE WHEN prev > 0 THEN (oi - prev) / prev * 100 END, 6) AS oi_change_pct, trend_1m, trend_5m, trend_15m FROM b JOIN tr USING (symbol) WHERE k = 1""")
def s15(spark, d):
    """Context of each symbol from five tables of responses, landed as JSON lines."""
    path = shared_dir(spark)
    _responses(spark, d).write.json(path)
    x = context.from_responses(spark.read.schema("symbol string, ms long, endpoint string, body string").json(path))
    return x.select("symbol", "mark", "index", "funding_rate", "next_funding", r6("bid"), r6("ask"), r6("rest_imbalance"), "open_interest", r6("oi_change_pct"), "trend_1m", "trend_5m", "trend_15m")


@query("i7_answer_contracts", """WITH o AS (SELECT o_orderkey, ['openai','gemini','claude','deepseek','other'][o_orderkey % 5 + 1] AS provider, o_custkey % 7 AS kind, o_custkey FROM orders)
SELECT o_orderkey, provider, provider <> 'other' AND kind NOT IN (0, 1) AS ok, CASE WHEN provider = 'other' OR kind IN (0, 1) THEN NULL WHEN kind = 2 THEN '[' || o_custkey || ']' ELSE '{"customer": ' || o_custkey || '}' END AS answer,
  CASE WHEN provider = 'other' THEN 'Unknown provider.' WHEN kind = 0 THEN 'JSON Parse Error: the response holds no answer.' WHEN kind = 1 THEN 'JSON Parse Error: the answer is no JSON.' END AS error FROM o""")
def i7(spark, d):
    """An answer for each order as each provider wraps it: whole, in a fence, a list, cut off, or missing."""
    o = src.table(spark, d, "orders")
    kind = F.col("o_custkey") % 7
    provider = F.get(F.array(*[F.lit(p) for p in ("openai", "gemini", "claude", "deepseek", "other")]), (F.col("o_orderkey") % 5).cast("int"))
    whole = F.concat(F.lit('{"customer": '), F.col("o_custkey").cast("string"), F.lit("}"))
    told = F.when(kind == 1, F.concat(F.lit("Sure: "), whole)).when(kind == 2, F.concat(F.lit("["), F.col("o_custkey").cast("string"), F.lit("]"))).when(kind == 3, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).otherwise(whole)
    part = lambda name, *inner: F.struct(*[x.alias(n) for n, x in zip((name,), inner, strict=True)])
    chat = F.to_json(part("choices", F.array(part("message", part("content", told)))))
    parts = F.to_json(part("candidates", F.array(part("content", part("parts", F.array(part("text", told)))))))
    blocks = F.to_json(part("content", F.array(part("text", told))))
    rows = o.select("o_orderkey", provider.alias("provider"), kind.alias("kind"), chat.alias("chat"), parts.alias("parts"), blocks.alias("blocks"))
    body = F.when(F.col("kind") == 0, '{"error": "overloaded"}').when(F.col("provider") == "gemini", F.col("parts")).when(F.col("provider") == "claude", F.col("blocks")).otherwise(F.col("chat"))
    x = interpret.answers_of(rows.select("o_orderkey", "provider", body.alias("body")))
    return x.select("o_orderkey", "provider", "ok", F.when(F.col("ok"), F.col("raw_text")).alias("answer"), "error")


@query("a21_observed_counters", f"WITH RECURSIVE {_DIFFS} SELECT symbol, count(*) AS messages, count(*) FILTER (WHERE verdict = 'GAP') AS gaps, count(*) FILTER (WHERE verdict = 'DUPLICATE') AS duplicates, count(*) FILTER (WHERE verdict = 'OUT_OF_ORDER') AS out_of_order, max(epoch) AS resyncs FROM vd GROUP BY symbol")
def a21_observed(spark, d):
    """Counters of the depth stream, kept while its verdicts are written; no pass of their own."""
    verdicts, watch = health.observed(folds.sequence_verdicts(src.depth_diffs(spark, d), width=50_000), list(src.SYMBOLS))
    verdicts.write.parquet(shared_dir(spark))
    rows = [(s, *[x[c] for c in ("messages", "gaps", "duplicates", "out_of_order", "resyncs")]) for s, x in sorted(health.by_symbol(watch.get).items())]
    return spark.createDataFrame(rows, "symbol string, messages long, gaps long, duplicates long, out_of_order long, resyncs long")


#: A response that is right, and what is wrong with changed ones, in order.
_GOOD = {
    "market_summary": "calm", "symbol_interpretations": {"BTC": {}}, "overall_risk": "low", "cleanest_bias_symbols": [], "suppressed_symbols": ["ETH"],
    "regime": "mixed", "data_quality_warnings": [], "not_trade_advice": True,
}
_FAULTY = [
    (None, "Response is not a dictionary."), ("[1]", "Response is not a dictionary."),
    *[({k: None}, f"Missing required JSON schema key: '{k}'.") for k in _GOOD],
    ({"overall_risk": "huge"}, "Invalid overall_risk value: 'huge' (must be low, medium, or high)."),
    ({"regime": "odd"}, "Invalid regime value: 'odd' (must be trending, choppy, absorbing, sweep-heavy, or mixed)."),
    ({"symbol_interpretations": "none"}, "symbol_interpretations is not an object."), ({"cleanest_bias_symbols": "BTC"}, "cleanest_bias_symbols is not an array."),
    ({"suppressed_symbols": {}}, "suppressed_symbols is not an array."), ({"not_trade_advice": False}, "not_trade_advice must be set to true."), ({}, None), ({"regime": "choppy"}, None),
]
_TOLD = [x if x is None or isinstance(x, str) else json.dumps({k: v for k, v in (_GOOD | x).items() if v is not None}) for x, _ in _FAULTY]
_quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"


@query("i4_validation_branches", f"SELECT c_custkey, [{', '.join(_quoted(e) for _, e in _FAULTY)}][c_custkey % {len(_FAULTY)} + 1] AS error FROM customer")
def i4(spark, d):
    """A response for each customer; each way to be wrong comes up."""
    told = F.get(F.array(*[F.lit(x).cast("string") for x in _TOLD]), (F.col("c_custkey") % len(_TOLD)).cast("int"))
    return src.table(spark, d, "customer").select("c_custkey", interpret.validation_error(told).alias("error"))


@query("i1_compact_fields", f"""WITH {TRADES}, {SIGNALS}, s AS (SELECT signal_id, symbol || ':' || signal_id AS symbol, CASE WHEN price >= 1 THEN round_even(price, 2) ELSE round_even(price, 4) END AS price, CAST(round_even(price * 77 / 1000, 0) * 1000 AS BIGINT) AS delta_1m,
  CAST(round_even(-price * 991 / 1000, 0) * 1000 AS BIGINT) AS delta_5m, CAST(round_even(price * 1501 / 1000, 0) * 1000 AS BIGINT) AS delta_15m, CAST(round_even(price * 77777 / 1000, 0) * 1000 AS BIGINT) AS cvd, (signal_id % 199 - 99) / 100.0::DOUBLE AS imbalance, 'CONFIRMED_' || direction AS action FROM signals)
SELECT *, sha256(symbol || '|' || printf('%.4f', price) || '|' || delta_1m || '|' || delta_5m || '|' || delta_15m || '|' || cvd || '|' || printf('%.2f', imbalance) || '|' || action) AS input_hash FROM s""")
def i1(spark, d):
    """Every field of the compact snapshot, and its hash."""
    p = F.col("price")
    x = src.signals(spark, d).select(
        F.concat("symbol", F.lit(":"), "signal_id").alias("symbol"), "price", (p * 77).alias("delta_1m"), (-p * 991).alias("delta_5m"), (p * 1501).alias("delta_15m"), (p * 77777).alias("cvd"),
        ((F.col("signal_id") % 199 - 99) / 100).alias("imbalance"), "action")
    y = interpret.compact_snapshot(x)
    return y.select(F.split_part("symbol", F.lit(":"), F.lit(2)).cast("long").alias("signal_id"), "symbol", "price", "delta_1m", "delta_5m", "delta_15m", "cvd", "imbalance", "action", "input_hash")


@query("s11_context_cache", f"WITH {_CTX} SELECT c_custkey, symbol, action, round(mark, 6) AS mark, round(premium, 6) AS premium_pct, quality, trend_5m, trend_15m FROM cs")
def s11(spark, d):
    """Contexts saved as JSON, one object for each, and loaded again."""
    path = shared_dir(spark)
    kept = _contexts(spark, d).select("c_custkey", "symbol", "action", r6("mark"), r6("premium_pct"), "quality", "trend_5m", "trend_15m")
    sinks.as_json(kept).write.text(path)
    return spark.read.schema(kept.schema).json(path)


@query("s12_migrated_log", """SELECT c_custkey, c_name AS summary, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS provider, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN c_nationkey END AS latency_ms FROM customer""")
def s12(spark, d):
    """An audit log whose later lines have columns that the earlier ones lack: old header, new header, read as one."""
    at, c = shared_dir(spark), src.table(spark, d, "customer")
    old = c.where("c_custkey % 2 <> 0").select("c_custkey", F.col("c_name").alias("summary"))
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.col("c_name").alias("summary"), F.col("c_mktsegment").alias("provider"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey")).alias("latency_ms"))
    sinks.append_csv(old, f"{at}/old")
    sinks.append_csv(new, f"{at}/new")
    read = lambda part: spark.read.option("header", True).csv(f"{at}/{part}")
    x = sinks.migrate(read("old"), read("new"))
    return x.select(F.col("c_custkey").cast("long").alias("c_custkey"), "summary", "provider", F.col("latency_ms").cast(c.schema["c_nationkey"].dataType).alias("latency_ms"))
