"""Window metrics, running sums and events on small tables with known results."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions import labels, scalars
from tidemark.operators import blocks, trades

NOW = 1_700_000_600_000


def frame(spark, rows):
    """Rows (symbol, ms, price, quantity, side)."""
    df = spark.createDataFrame([(s, k, ms, float(p), float(q), side) for k, (s, ms, p, q, side) in enumerate(rows)], "symbol string, agg_id long, ms long, price double, quantity double, side string")
    return df.withColumn("day", F.to_date(F.timestamp_millis("ms"))).withColumn("notional", (F.col("price").cast("decimal(18,6)") * F.col("quantity").cast("decimal(9,2)")).cast("decimal(28,6)"))


def last(df):
    return max(df.collect(), key=lambda r: (r.ms, r.agg_id))


def test_windows_are_independent(spark):
    t = frame(spark, [("btc", NOW - 600_000, 60000, 1, "BUY"), ("btc", NOW - 30_000, 60000, 2, "SELL")])
    r = last(trades.window_metrics(t))
    assert (r.n_1m, r.delta_1m, r.n_5m, r.delta_5m, r.n_15m, r.delta_15m) == (1, -120000.0, 1, -120000.0, 2, -60000.0)
    assert r.status_5m == "VALID" and r.status_15m == "WARMING_UP" and r.warm_15m == "WARMING 09:30 / 15:00"


def test_session_delta_and_window(spark):
    t = frame(spark, [("btc", NOW - 1_200_000, 50000, 1, "BUY"), ("btc", NOW - 10_000, 50000, 1, "SELL")])
    assert last(trades.window_metrics(t)).delta_15m == -50000.0
    assert float(last(trades.cumulative_delta(t)).session_cvd) == 0.0
    over = frame(spark, [("btc", 86_400_000 - 1, 10, 1, "BUY"), ("btc", 86_400_000, 10, 1, "BUY")])
    r = last(trades.cumulative_delta(over))
    assert (float(r.cvd), float(r.session_cvd)) == (20.0, 10.0)


def test_trailing_sums_equal_a_plain_scan(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randint(0, 9_000), rng.randint(1, 9), 1, rng.choice(("BUY", "SELL"))) for _ in range(400)]
    t = frame(spark, rows)
    for width in (500, 5_000, 10**9):
        got = blocks.trailing_sums(t, ["symbol"], "ms", {"v": F.col("notional"), "n": F.lit(1).cast("long")}, {"x": 700, "y": 2_500}, width).collect()
        assert len(got) == len(rows)
        for r in got:
            for w, ms in (("x", 700), ("y", 2_500)):
                inside = [q for q in rows if q[0] == r.symbol and r.ms - ms <= q[1] <= r.ms]
                assert r[f"n_{w}"] == len(inside) and float(r[f"v_{w}"]) == sum(q[2] for q in inside)
    run = blocks.running_sum(t, ["symbol"], ["ms", "agg_id"], "ms", F.col("notional"), "s", 500).collect()
    for r in run:
        assert float(r.s) == sum(q[2] for k, q in enumerate(rows) if q[0] == r.symbol and (q[1], k) <= (r.ms, r.agg_id))


def test_burst_needs_three_times_the_floor(spark):
    t = frame(spark, [("a", NOW + k * 100, 10, 1, "BUY") for k in range(16)])
    got = sorted((r.ms, r.burst) for r in trades.bursts(t).collect())
    assert [b for _, b in got] == [False] * 15 + [True]


def test_absorption_and_divergence(spark):
    cfg = Config(absorption_short=500.0, divergence=500.0)
    sells = [("a", 60_000 + k * 1000, 100, 1, "SELL") for k in range(12)]
    got = {r.tick: r.event for r in trades.absorption(frame(spark, sells), 60_000, 60_000, cfg).collect()}
    assert got == {120_000: "BULLISH_ABSORPTION"}
    falling = [("a", 60_000 + k * 1000, 100 - k if k < 11 else 80, 1, "SELL") for k in range(12)]
    assert {r.event for r in trades.absorption(frame(spark, falling), 60_000, 60_000, cfg).collect()} == {None}
    rising = [("a", 10_000 + k * 1000, 100 + k, 1, "BUY" if k < 10 else "SELL") for k in range(20)]
    ticks = {r.tick: r.event for r in trades.divergence(frame(spark, rising), 60_000, 60_000, cfg).collect()}
    assert ticks == {60_000: "BEARISH_DIVERGENCE"}
    assert trades.absorption(frame(spark, sells[:9]), 60_000, 60_000, cfg).count() == 0


def test_health_and_labels(spark):
    rows = spark.createDataFrame([(True, 200), (True, 1200), (True, 3000), (False, 10), (True, None)], "valid boolean, age int")
    got = [r[0] for r in rows.select(labels.health(F.col("valid"), F.col("age"))).collect()]
    assert got == ["HEALTHY", "DEGRADED", "STALE", "INVALID", "STALE"]
    x = spark.createDataFrame([("BULLISH_ABSORPTION", 0.2), ("BULLISH_ABSORPTION", 0.1), ("BEARISH_ABSORPTION", -0.15), (None, 1.0)], "e string, i double")
    assert [r[0] for r in x.select(labels.confirmed_absorption(F.col("e"), F.col("i"))).collect()] == ["CONFIRMED_BULLISH_ABSORPTION", "POSSIBLE_BULLISH_ABSORPTION", "CONFIRMED_BEARISH_ABSORPTION", None]


@pytest.mark.parametrize(("price", "size", "want"), [(63704.3, 10, 63700.0), (63708.9, 10, 63710.0), (25.0, 10, 20.0), (7.5, 0, 7.5)])
def test_price_bucket(spark, price, size, want):
    assert spark.range(1).select(scalars.price_bucket(F.lit(price), size)).first()[0] == want


def test_formats_and_redaction(spark):
    one = spark.range(1)
    show = lambda c: one.select(c).first()[0]
    assert [show(scalars.compact_usdt(F.lit(v))) for v in (1_234_567.0, -1500.0, 45.0)] == ["+$1.23M", "-$1.5K", "+$45.0"]
    assert [show(scalars.compact_or_na(F.lit(v).cast("double"))) for v in (2.5e9, 3.4e6, 5600.0, 7.0, None)] == ["2.50B", "3.40M", "5.60K", "7.00", "N/A"]
    assert show(scalars.clock(F.lit(125))) == "02:05"
    text = "Authorization: Bearer abc123, ?key=zzz&x=1 sk-proj-abcdefgh1 AIzaSyABCDEFGHIJK my-secret"
    clean = show(scalars.redact_credentials(F.lit(text), ("my-secret",)))
    assert "abc123" not in clean and "zzz" not in clean and "sk-proj" not in clean and "AIzaSy" not in clean and "my-secret" not in clean and "x=1" in clean
    assert show(scalars.strip_fence(F.lit('```json\n{"a":1}\n```'))) == '{"a":1}'
    assert [show(scalars.symbol_key(F.lit(s))) for s in ("btc-usdt", "eth")] == ["BTCUSDT", "ETHUSDT"]


def test_empty_trades(spark):
    t = frame(spark, [("a", 1, 1, 1, "BUY")]).limit(0)
    assert trades.window_metrics(t).count() == trades.bursts(t).count() == trades.latest_metrics(t).count() == 0
