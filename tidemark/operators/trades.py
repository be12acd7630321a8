"""Metrics and events of the trade stream, in event time.

Input is a table of trades (symbol, agg_id, ms, day, price, quantity, side,
notional). Per-trade results look at what came up to that trade; grid results
stand at every multiple of a grid step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import WINDOWS, Config
from tidemark.functions import labels
from tidemark.functions.scalars import clock, ratio, signed
from tidemark.operators.blocks import hopping, running_sum, trailing_sums

C = Config()


def volumes() -> dict[str, Column]:
    buy, n, q = F.col("side") == "BUY", F.col("notional"), F.col("quantity").cast("decimal(28,6)")
    zero = F.lit(0).cast("decimal(28,6)")
    return {
        "buy": F.when(buy, n).otherwise(zero), "sell": F.when(buy, zero).otherwise(n),
        "buy_qty": F.when(buy, q).otherwise(zero), "sell_qty": F.when(buy, zero).otherwise(q), "n": F.lit(1).cast("long"),
    }


def warm_up(df: DataFrame, trades: DataFrame, windows: dict[str, int]) -> DataFrame:
    """``df`` (symbol, ms) with ``status_{w}``: VALID once the symbol's history is as long as the window, and its text."""
    start = trades.groupBy("symbol").agg(F.min("ms").alias("_start"))
    df = df.join(start, "symbol")
    for name, ms in windows.items():
        seen = F.col("ms") - F.col("_start")
        df = df.withColumn(f"status_{name}", F.when(seen < ms, "WARMING_UP").otherwise("VALID"))
        df = df.withColumn(f"warm_{name}", F.when(seen < ms, F.concat(F.lit("WARMING "), clock(seen / 1000), F.lit(" / "), clock(F.lit(ms / 1000)))).otherwise("READY"))
    return df.drop("_start")


def window_metrics(trades: DataFrame, windows: dict[str, int] = WINDOWS, cfg: Config = C) -> DataFrame:
    """Each trade with delta, ratios, volumes, count and status of every trailing window, and the duplication check."""
    out = warm_up(trailing_sums(trades, ["symbol"], "ms", volumes(), windows, cfg.block_ms), trades, windows)
    for w in windows:
        total = F.col(f"buy_{w}") + F.col(f"sell_{w}")
        out = out.withColumns({
            f"delta_{w}": (F.col(f"buy_{w}") - F.col(f"sell_{w}")).cast("double"), f"total_{w}": total.cast("double"),
            f"delta_qty_{w}": (F.col(f"buy_qty_{w}") - F.col(f"sell_qty_{w}")).cast("double"),
            f"buy_ratio_{w}": ratio(F.col(f"buy_{w}"), total, 0.5), f"sell_ratio_{w}": ratio(F.col(f"sell_{w}"), total, 0.5),
        })
    last = list(windows)[-2:]
    same = F.abs(F.col(f"delta_{last[0]}") - F.col(f"delta_{last[1]}")) < 1e-6
    return out.withColumn("duplicated", same & (F.col(f"status_{last[1]}") == "VALID") & (F.col(f"n_{last[1]}") > 0))


def latest_metrics(trades: DataFrame, windows: dict[str, int] = WINDOWS) -> DataFrame:
    """One row for each symbol: the windows that end at its last trade."""
    end = trades.groupBy("symbol").agg(F.max("ms").alias("end"), F.min("ms").alias("start"))
    rows = trades.join(end, "symbol")
    aggs = [F.max_by("price", F.struct("ms", "agg_id")).alias("price"), F.first("end").alias("end"), F.first("start").alias("start")]
    for w, ms in windows.items():
        inside = F.col("ms") >= F.col("end") - ms
        for name, v in volumes().items():
            aggs.append(F.coalesce(F.sum(F.when(inside, v)), F.lit(0)).alias(f"{name}_{w}"))
    out = rows.where(F.col("ms") >= F.col("end") - max(windows.values())).groupBy("symbol").agg(*aggs)
    for w, ms in windows.items():
        out = out.withColumns({
            f"delta_{w}": (F.col(f"buy_{w}") - F.col(f"sell_{w}")).cast("double"), f"buy_ratio_{w}": ratio(F.col(f"buy_{w}"), F.col(f"buy_{w}") + F.col(f"sell_{w}"), 0.5),
            f"status_{w}": F.when(F.col("end") - F.col("start") < ms, "WARMING_UP").otherwise("VALID"),
        })
    return out


def cumulative_delta(trades: DataFrame, cfg: Config = C) -> DataFrame:
    """Each trade with ``cvd`` since the start and ``session_cvd`` since midnight UTC."""
    v = signed(F.col("side"), F.col("notional"))
    out = running_sum(trades, ["symbol"], ["ms", "agg_id"], "ms", v, "cvd", cfg.block_ms)
    return running_sum(out, ["symbol", "day"], ["ms", "agg_id"], "ms", v, "session_cvd", cfg.block_ms)


def bursts(trades: DataFrame, cfg: Config = C) -> DataFrame:
    """Each trade with the count of the recent window, the average of the slots before it, and whether it is a burst."""
    out = trailing_sums(trades, ["symbol"], "ms", {"n": F.lit(1).cast("long")}, {"recent": cfg.burst_recent_ms, "back": cfg.burst_back_ms}, cfg.block_ms)
    return burst_columns(out, cfg)


def burst_columns(counts: DataFrame, cfg: Config = C) -> DataFrame:
    """``counts`` (n_recent, n_back) with the average of the slots before the recent one, and whether it is a burst."""
    average = (F.col("n_back") - F.col("n_recent")) / (cfg.burst_back_ms / cfg.burst_recent_ms - 1)
    return counts.withColumn("average", average).withColumn("burst", F.col("n_recent") > cfg.burst_multiple * F.greatest(F.lit(cfg.burst_floor), average))


def large_trades(trades: DataFrame, cfg: Config = C) -> DataFrame:
    return trades.where(F.col("notional") >= cfg.large_trade)


def absorption(trades: DataFrame, window: int, grid: int, cfg: Config = C) -> DataFrame:
    """(symbol, tick) with the window's prices, delta and absorption event.

    Trades are summed up by grid cell first, so a window costs as many rows as
    it has cells. The window of tick T is [T - window, T); it needs ``least_trades``.
    """
    first, last = F.struct("ms", "agg_id"), F.struct("ms", "agg_id")
    buy, sell = volumes()["buy"], volumes()["sell"]
    cells = trades.withColumn("cell", F.floor(F.col("ms") / grid)).groupBy("symbol", "cell").agg(
        F.min(F.struct(first.alias("at"), "price")).alias("o"), F.max(F.struct(last.alias("at"), "price")).alias("c"),
        F.max("price").alias("high"), F.min("price").alias("low"), F.sum(buy).alias("buy"), F.sum(sell).alias("sell"), F.count("*").alias("n"))
    ticks = cells.withColumn("tick", F.explode(F.sequence(F.col("cell") + 1, F.col("cell") + window // grid))).withColumn("tick", F.col("tick") * grid)
    out = ticks.groupBy("symbol", "tick").agg(
        F.min("o").getField("price").alias("open"), F.max("c").getField("price").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.sum("buy").alias("buy"), F.sum("sell").alias("sell"), F.sum("n").alias("n")).where(F.col("n") >= cfg.least_trades)
    total = F.col("buy") + F.col("sell")
    delta = (F.col("buy") - F.col("sell")).cast("double")
    limit = cfg.absorption_short if window <= 60_000 else cfg.absorption_long
    change = F.try_divide(F.col("close") - F.col("open"), F.col("open")) * 100  # null at a price of 0: no event by it
    bounced = F.try_divide(F.col("close") - F.col("low"), F.col("low")) * 100 >= cfg.flat_pct * 2
    rejected = F.try_divide(F.col("high") - F.col("close"), F.col("high")) * 100 >= cfg.flat_pct * 2
    bull = (delta < -limit) & (ratio(F.col("sell"), total, 0.0) >= cfg.absorption_ratio) & ((change >= -cfg.flat_pct) | bounced)
    bear = (delta > limit) & (ratio(F.col("buy"), total, 0.0) >= cfg.absorption_ratio) & ((change <= cfg.flat_pct) | rejected)
    event = F.when(total == 0, None).when(bull, "BULLISH_ABSORPTION").when(bear, "BEARISH_ABSORPTION")
    return out.select("symbol", "tick", "open", "close", "high", "low", "n", delta.alias("delta"), event.alias("event"))


def divergence(trades: DataFrame, window: int, grid: int, cfg: Config = C) -> DataFrame:
    """(symbol, tick) with average price and delta of the window's two halves by count, and the divergence event."""
    rows = hopping(trades, "ms", grid, window)
    w = Window.partitionBy("symbol", "tick")
    rows = rows.withColumn("i", F.row_number().over(w.orderBy("ms", "agg_id"))).withColumn("n", F.count("*").over(w)).where(F.col("n") >= cfg.divergence_trades)
    early = F.col("i") <= F.floor(F.col("n") / 2)
    v, p = signed(F.col("side"), F.col("notional")), F.col("price").cast("decimal(18,6)")
    half = lambda e, c: F.sum(F.when(e, c)).cast("double")
    out = rows.groupBy("symbol", "tick").agg(
        F.max("n").alias("n"), (half(early, p) / F.count_if(early)).alias("price_1"), (half(~early, p) / F.count_if(~early)).alias("price_2"),
        half(early, v).alias("delta_1"), half(~early, v).alias("delta_2"))
    up = F.col("price_2") > F.col("price_1")
    event = F.when(up & (F.col("delta_2") < F.col("delta_1") - cfg.divergence), "BEARISH_DIVERGENCE").when(~up & (F.col("delta_2") > F.col("delta_1") + cfg.divergence), "BULLISH_DIVERGENCE")
    return out.withColumn("event", event)


def stream_health(trades: DataFrame, now: int, reach_ms: int = 10_000, cfg: Config = C) -> DataFrame:
    """One row for each symbol: events a second over the last ``reach_ms``, age of the last event at ``now``, status."""
    out = trades.where(F.col("ms") <= now).groupBy("symbol").agg(F.max("ms").alias("last_ms"), F.count_if(F.col("ms") >= now - reach_ms).alias("recent"))
    age = labels.latency(F.lit(now), F.col("last_ms"))
    return out.select("symbol", age.alias("age_ms"), (F.col("recent") / (reach_ms / 1000)).alias("events_per_second"), labels.health(F.lit(True), age).alias("status"))


def radar(latest: DataFrame, book: DataFrame, cfg: Config = C) -> DataFrame:
    """Symbols by activity: deltas, imbalance and bonuses for fresh large trades, events and sweeps.

    ``latest`` has price, deltas, ratios and optional ages (``large_ms``,
    ``event_ms``) and action; ``book`` has symbol and imbalance.
    """
    rows = latest.join(book.select("symbol", "imbalance"), "symbol", "left").withColumn("imbalance", F.coalesce("imbalance", F.lit(0.0)))
    fresh = lambda c, bonus: F.when(F.col(c) <= 60_000, bonus).otherwise(0.0) if c in latest.columns else F.lit(0.0)
    sweep = F.when(F.col("action").contains("SWEEP"), 500.0).otherwise(0.0) if "action" in latest.columns else F.lit(0.0)
    score = F.abs("delta_1m") / 10000 + F.abs("delta_5m") / 25000 + F.abs("imbalance") * 100 + fresh("large_ms", 50.0) + fresh("event_ms", 100.0) + sweep
    return rows.withColumn("activity", score).withColumn("aggression", labels.aggression_side(F.col("buy_ratio_5m"))).orderBy(F.desc("activity"), "symbol")


def first_seen_order(trades: DataFrame) -> DataFrame:
    """Symbols in the order in which they first traded."""
    first = trades.groupBy("symbol").agg(F.min(F.struct("ms", "agg_id")).alias("f"))
    return first.select("symbol", F.col("f.ms").alias("first_ms"), F.row_number().over(Window.orderBy("f")).alias("position"))


def bars(trades: DataFrame, width: int) -> DataFrame:
    """Tumbling bars of ``width`` ms (an extension)."""
    at = F.struct("ms", "agg_id")
    return trades.groupBy("symbol", (F.floor(F.col("ms") / width) * width).alias("bar")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("notional").cast("double").alias("volume"), F.count("*").alias("n"))
