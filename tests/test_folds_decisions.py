"""Stateful folds and the state machine on small tables with known results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.operators import decisions, folds

DIFF = "symbol string, pos long, u long, pu long"


def test_sequence_verdicts(spark):
    rows = [("a", 1, 10, 5), ("a", 2, 20, 10), ("a", 3, 15, 8), ("a", 4, 25, 9), ("a", 5, 30, 22), ("a", 6, 31, 30), ("b", 1, 7, None)]
    got = {(r.symbol, r.pos): (r.verdict, r.epoch) for r in folds.sequence_verdicts(spark.createDataFrame(rows, DIFF)).collect()}
    assert [got["a", k][0] for k in range(1, 7)] == ["OK", "OK", "DUPLICATE", "OUT_OF_ORDER", "GAP", "OK"]
    assert got["a", 6][1] == 1 and got["b", 1] == ("OK", 0)


def test_cooldown_keeps_the_last_accepted(spark):
    rows = [("a", t * 1000, "X", "1m", 100.0, k) for k, t in enumerate((1, 30, 61, 62, 130))] + [("a", 62_500, "X", "1m", 101.0, 9), ("a", 62_600, "LARGE_TRADE", "1m", 1.0, 10), ("a", 62_700, "LARGE_TRADE", "1m", 1.0, 11)]
    df = spark.createDataFrame(rows, "symbol string, ms long, type string, window string, price double, alert_id long")
    got = {r.alert_id: r.accepted for r in folds.event_cooldown(df).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 9: True, 4: True, 10: True, 11: True}


def test_commit_starts_a_cooldown_once(spark):
    rows = [("a", 0, "WAITING", False, False), ("a", 1000, "CONFIRMED_LONG", True, False), ("a", 11_000, "CONFIRMED_LONG", True, False), ("a", 20_000, "DATA_STALE", False, True), ("a", 181_000, "CONFIRMED_LONG", True, False)]
    df = spark.createDataFrame(rows, "symbol string, ms long, action string, candidate boolean, gated boolean")
    got = sorted((r.ms, r.committed, r.version, r.cooldown_until) for r in folds.commit_decisions(df).collect())
    assert got == [(0, "WAITING", 1, None), (1000, "CONFIRMED_LONG", 2, 181_000), (11_000, "COOLDOWN", 3, 181_000), (20_000, "DATA_STALE", 4, 181_000), (181_000, "CONFIRMED_LONG", 5, 361_000)]


def test_paper_orders(spark):
    orders = [("m", "a", 1, 1, "BUY", 10.0, 100.0), ("m", "a", 2, 2, "SELL", 4.0, 110.0), ("m", "a", 3, 3, "SELL", 10.0, 120.0), ("m", "b", 4, 4, "BUY", 1000.0, 1000.0), ("m", "a", 5, 5, "BUY", 0.0, 5.0)]
    df = spark.createDataFrame(orders, "account string, symbol string, ms long, order_id long, side string, qty double, price double")
    got = {r.order_id: (r.kind, r.gain, r.cash, r.realized) for r in folds.paper_orders(df).collect()}
    assert got[1] == ("OPEN", 0.0, 9800.0, 0.0)
    assert got[2] == ("PARTIAL_CLOSE", 40.0, 9920.0, 40.0)
    assert got[3] == ("FLIP", 120.0, 9920.0 + 120 + 120 - 96, 160.0)
    assert got[4][0] == got[5][0] == "REJECTED"


def test_auto_trader_takes_profit(spark):
    ticks = [("m", "a", 1, 100.0, "CONFIRMED_LONG", "BUY"), ("m", "a", 2, 100.5, "WAITING", None), ("m", "a", 3, 101.0, "WAITING", None)]
    got = sorted(folds.auto_trader(spark.createDataFrame(ticks, "account string, symbol string, ms long, price double, action string, entry string")).collect(), key=lambda r: r.ms)
    assert [(r.opened, r.closed) for r in got] == [("BUY", None), (None, None), (None, "TAKE")]
    assert abs(got[2].gain - 50.0) < 1e-9 and abs(got[2].cash - 10_050.0) < 1e-9


BASE = {
    "symbol": "btc", "ms": 1_000_000, "delta_1m": 50_000.0, "delta_5m": 150_000.0, "buy_ratio_5m": 0.60, "imbalance": 0.25, "net_shift": 100.0, "valid": True, "book_age": 100, "warming": False,
    "bearish": False, "bullish": False, "sweep_direction": "BULLISH", "sweep_score": 8, "cooldown_until": None,
}
TYPES = "symbol string, ms long, delta_1m double, delta_5m double, buy_ratio_5m double, imbalance double, net_shift double, valid boolean, book_age long, warming boolean, bearish boolean, bullish boolean, sweep_direction string, sweep_score int, cooldown_until long"
SHORT = {"delta_1m": -50_000.0, "delta_5m": -150_000.0, "buy_ratio_5m": 0.40, "imbalance": -0.25, "net_shift": -100.0, "sweep_direction": "BEARISH"}


@pytest.mark.parametrize(("change", "action", "reason"), [
    ({}, "CONFIRMED_LONG", "Bullish sweep confluence confirmed"),
    (SHORT, "CONFIRMED_SHORT", "Bearish sweep confluence confirmed"),
    ({"bearish": True}, "WAITING", "LONG_SUPPRESSED:Bearish conflict active"),
    ({"valid": False}, "DATA_INVALID", None), ({"valid": None, "book_age": None}, "DATA_STALE", None), ({"warming": True}, "WARMING_UP", None), ({"cooldown_until": 1_050_000}, "COOLDOWN", "Signal cooldown active (50.0s remaining)"),
    ({"sweep_score": 3}, "CONFIRMED_LONG", "Bullish order flow bias confirmed"),
    ({"sweep_score": 3, "net_shift": 0.0}, "WATCH_LONG", "Flow bias watching stacking/pulling details"),
    ({"delta_1m": -1.0}, "WATCH_LONG", "Bullish sweep waiting for confirmation gates"),
    ({"sweep_score": None, "sweep_direction": None, "delta_5m": 60_000.0, "imbalance": 0.0}, "WATCH_LONG", "Delta/Aggression turning bullish"),
    ({"sweep_score": None, "delta_5m": 0.0}, "WAITING", "No active signal triggers"),
    ({"sweep_direction": "BEARISH", "net_shift": 0.0}, "WAITING", "AMBIGUOUS_DIRECTIONAL_CONFLICT"),
])
def test_state_machine(spark, change, action, reason):
    row = BASE | change
    r = decisions.evaluate(spark.createDataFrame([tuple(row.values())], TYPES)).first()
    assert r.action == action and (reason is None or r.reason == reason)
    assert r.candidate == action.startswith("CONFIRMED") and r.gated == action.startswith(("DATA", "WARMING"))
    if action == "CONFIRMED_LONG" and not change:
        assert r.gates["no_bearish_conflict"] == "PASS" and len(r.gates) == 6


def test_sweep_score_counts_each_part(spark):
    sweep = spark.createDataFrame([(1, "a", 1_000_000, "BULLISH"), (2, "b", 1_000_000, "BULLISH")], "sweep_id long, symbol string, ms long, direction string")
    trades = spark.createDataFrame([("a", 1, 400_000, "SELL", 300_000.0), ("a", 2, 999_000, "BUY", 10.0)], "symbol string, agg_id long, ms long, side string, v double").withColumn("notional", F.col("v").cast("decimal(28,6)")).withColumn("price", F.lit(1.0))
    alerts = spark.createDataFrame([("a", 500_000, "BULLISH_ABSORPTION"), ("a", 990_000, "BULLISH_DIVERGENCE"), ("a", 1_000_001, "BEARISH_DIVERGENCE"), ("b", 99_000, "BULLISH_DIVERGENCE")], "symbol string, ms long, type string")
    book = spark.createDataFrame([("a", 999_500, 0.2, 0.0, True), ("b", 900_000, 0.9, 0.0, True)], "symbol string, snap_ms long, imbalance double, net_shift double, valid boolean")
    for width in (10_000, 3_600_000):
        got = {r.sweep_id: r for r in decisions.score_sweeps(sweep, trades, alerts, book, Config(block_ms=width)).collect()}
        assert (got[1].score, got[1].status, got[1].stale) == (10, "SWEEP_CONFLUENCE", False)
        assert (got[2].score, got[2].status, got[2].stale) == (1, "LOW_CONFLUENCE", True)
