"""Outcomes, context, interpretations and reports."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.operators import interpret, outcomes, reports


def test_forward_excursion_and_report(spark):
    s = spark.createDataFrame([(1, "btc", 1_000_000, "CONFIRMED_LONG", 60000.0), (2, "eth", 1_000_000, "CONFIRMED_SHORT", 10.0)], "signal_id long, symbol string, ms long, action string, price double")
    t = spark.createDataFrame([("btc", 1, 1_001_000, 60100.0), ("btc", 2, 1_005_000, 59950.0), ("btc", 3, 1_100_000, 60200.0), ("btc", 0, 1_000_000, 1.0)], "symbol string, agg_id long, ms long, price double")
    got = {r.signal_id: r for r in outcomes.forward_excursion(s, t).collect()}
    assert (got[1].best_5m, got[1].worst_5m, got[1].final_5m, got[1].win_5m) == (0.3333, -0.0833, 0.3333, True)
    assert (got[2].best_5m, got[2].final_1h, got[2].win_1h) == (0.0, 0.0, False)
    one = outcomes.forward_excursion(s.where("signal_id = 1"), t)
    assert {r.horizon: r.precision for r in outcomes.performance_report(one).collect()} == {"5m": 100.0, "15m": 100.0, "1h": 100.0}
    prices = outcomes.horizon_prices(s, t).where("signal_id = 1").first()
    assert (prices.after_1m, prices.after_5m) == (60200.0, None)


def test_context_rules(spark):
    one = spark.range(1)
    show = lambda c: one.select(c).first()[0]
    lit = F.lit
    assert [show(labels.kline_trend(lit(a), lit(b))) for a, b in ((100.0, 100.03), (100.0, 99.97), (100.0, 100.01), (0.0, 5.0))] == ["up", "down", "flat", "flat"]
    assert show(labels.premium_pct(lit(101.0), lit(0.0))) is None
    got = show(labels.context_warnings(lit("STALE"), lit(-0.03), lit(0.1), lit(None).cast("double"), lit(None).cast("double")))
    assert got == ["context quality STALE", "elevated funding", "mark/index premium stretched", "local WS imbalance unavailable"]
    label = lambda action, t5, t15, p, imb, oi, q="OK": show(labels.context_label(lit(action), lit(q), lit(t5), lit(t15), lit(p), lit(imb), lit(oi)))
    assert label("WATCH_LONG", "up", "up", 0.0, 0.1, 0.0) == "CONFIRMED"
    assert label("WATCH_LONG", "up", "up", -0.05, 0.1, 0.0) == "MIXED"
    assert label("WATCH_LONG", "flat", "flat", 0.13, 0.0, 0.0) == "CONFLICTING"
    assert label("WATCH_SHORT", "down", "down", 0.08, -0.1, 0.0) == "MIXED"
    assert label("WAITING", "up", "up", 0.0, 0.0, 0.0) == "INSUFFICIENT" and label("WATCH_LONG", "up", "up", 0.0, 0.0, 0.0, "STALE") is None


GOOD = {"market_summary": "s", "symbol_interpretations": {}, "overall_risk": "low", "cleanest_bias_symbols": [], "suppressed_symbols": [], "regime": "mixed", "data_quality_warnings": [], "not_trade_advice": True}


def test_repair_and_validation(spark):
    odd = {"summary": " Quiet ", "risk": "HIGH!", "market_regime": "choppy day", "symbols": {"btc": {"scanner_bias": "WATCH_LONG", "analysis": "x", "confidence": 0.7, "risks": "r"}, "eth": "flat"}, "cleanest_symbols": ["BTC", " "], "warnings": "w"}
    df = spark.createDataFrame([(1, json.dumps(GOOD)), (2, json.dumps(odd)), (3, "{}"), (4, "nonsense"), (5, json.dumps(GOOD | {"regime": "wild"})), (6, json.dumps(GOOD | {"not_trade_advice": False}))], "id long, response string")
    got = {r.id: r for r in interpret.repair(df).collect()}
    assert not got[1].changed and got[2].changed and got[5].repaired.regime == "mixed"
    r = got[2].repaired
    assert (r.market_summary, r.overall_risk, r.regime, r.cleanest_bias_symbols, r.data_quality_warnings) == ("Quiet", "high", "choppy", ["BTC"], ["w"])
    assert r.symbol_interpretations["BTC"].bias == "WATCH_LONG" and r.symbol_interpretations["BTC"].risk_flags == ["r"] and r.symbol_interpretations["ETH"].explanation == "flat"
    assert got[3].repaired.market_summary == interpret.NO_SUMMARY and got[3].repaired.overall_risk == "medium"
    errors = {r.id: r.e for r in df.select("id", interpret.validation_error(F.col("response")).alias("e")).collect()}
    assert errors[1] is None and errors[3] == "Missing required JSON schema key: 'market_summary'." and errors[4] == "Response is not a dictionary."
    assert errors[5].startswith("Invalid regime value: 'wild'") and errors[6] == "not_trade_advice must be set to true."


def test_actions_are_enforced(spark):
    told = spark.createDataFrame([("BTC", "CONFIRMED_LONG"), ("ETH", "WAITING"), ("XRP", "WAITING")], "symbol string, bias string")
    actions = spark.createDataFrame([("BTC", "WATCH_LONG"), ("ETH", "WAITING")], "symbol string, action string")
    got = {r.symbol: (r.bias, r.reported_bias, r.enforced) for r in interpret.enforce_actions(told, actions).collect()}
    assert got == {"BTC": ("WATCH_LONG", "CONFIRMED_LONG", True), "ETH": ("WAITING", None, False), "XRP": ("WAITING", None, False)}


def test_status_rollups(spark):
    st = lambda rows: reports.global_status(spark.createDataFrame(rows, "symbol string, book_state string, warming boolean")).first().status
    assert st([("a", "HEALTHY", False), ("b", "GAP", False), ("c", "RESYNCING", True)]) == "SEQUENCE_GAP"
    assert st([("a", "HEALTHY", False), ("b", "RESYNCING", False)]) == "RESYNCING" and st([("a", "HEALTHY", True)]) == "SYNCED" and st([("a", "SYNCING", True)]) == "INITIALISING"
    events = spark.createDataFrame([("a", "X_BURST", "mock_1"), ("a", "BULLISH_DIVERGENCE", None), ("b", "BULLISH_DIVERGENCE", "swp_mock_2")], "symbol string, type string, sweep_id string")
    assert reports.real_events(events).count() == 2
    assert [(r.category, r.symbol) for r in reports.category_hotspots(events, 1).orderBy("category").collect()] == [("BURST", "a"), ("DIVERGENCE", "a")]


def test_ask_keeps_failures_as_rows(spark):
    def call(prompt):
        if "bad" in prompt:
            raise RuntimeError("key sk-proj-abcdefghij refused")
        return "```json\n{}\n```"

    rows = spark.createDataFrame([("a", "good"), ("b", "bad")], "scope string, prompt string")
    got = {r.scope: (r.ok, r.raw_text, r.error) for r in interpret.ask(rows, call, "p", "m").collect()}
    assert got == {"a": (True, "{}", None), "b": (False, None, "key [REDACTED] refused")}
