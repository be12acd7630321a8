"""Labels and predicates over columns of metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import Config

C = Config()


def aggression_event(buy: Column, sell: Column, cfg: Config = C) -> Column:
    """BUY_AGGRESSION or SELL_AGGRESSION by the 1m ratios, else null."""
    return F.when(buy >= cfg.aggression, "BUY_AGGRESSION").when(sell >= cfg.aggression, "SELL_AGGRESSION")


def aggression_side(ratio: Column) -> Column:
    return F.when(ratio >= 0.58, "BUYERS").when(ratio <= 0.42, "SELLERS").otherwise("NEUTRAL")


def confirmed_absorption(event: Column, imbalance: Column, cfg: Config = C) -> Column:
    """CONFIRMED_ where the book leans the event's way, else POSSIBLE_."""
    bull = event == "BULLISH_ABSORPTION"
    sure = (bull & (imbalance >= cfg.confirm_imbalance)) | (~bull & (imbalance <= -cfg.confirm_imbalance))
    return F.when(event.isNotNull(), F.concat(F.when(sure, "CONFIRMED_").otherwise("POSSIBLE_"), event))


def health(valid: Column, age_ms: Column) -> Column:
    """INVALID, STALE without events, then by age: HEALTHY to 1 s, DEGRADED to 2.5 s."""
    return F.when(~valid, "INVALID").when(age_ms.isNull(), "STALE").when(age_ms <= 1000, "HEALTHY").when(age_ms <= 2500, "DEGRADED").otherwise("STALE")


def connection(status: Column, idle_ms: Column, limit_ms: int) -> Column:
    return F.when((status == "CONNECTED") & (idle_ms > limit_ms), "STALE").otherwise(status)


def latency(later: Column, earlier: Column) -> Column:
    return F.greatest(F.lit(0), later - earlier)


def direction(action: Column) -> Column:
    return F.when(action.contains("LONG"), "LONG").otherwise("SHORT")


def kline_trend(open_: Column, close: Column) -> Column:
    pct = (close - open_) / open_ * 100
    return F.when(F.coalesce(open_, F.lit(0.0)) <= 0, "flat").when(pct >= 0.02, "up").when(pct <= -0.02, "down").otherwise("flat")


def premium_pct(mark: Column, index: Column) -> Column:
    return F.when(index > 0, (mark - index) / index * 100)


def context_quality(*required: Column, failed: Column | None = None) -> Column:
    missing = F.lit(False)
    for c in required:
        missing = missing | c.isNull()
    out = F.when(missing, "STALE").otherwise("OK")
    return F.when(failed, "ERROR").otherwise(out) if failed is not None else out


def context_warnings(quality: Column, funding: Column, premium: Column, drift: Column, imbalance: Column) -> Column:
    zero = lambda c: F.abs(F.coalesce(c, F.lit(0.0)))
    return F.array_compact(F.array(
        F.when(quality != "OK", F.concat(F.lit("context quality "), quality)),
        F.when(zero(funding) >= 0.02, "elevated funding"),
        F.when(zero(premium) >= 0.10, "mark/index premium stretched"),
        F.when(drift >= 0.30, "REST/WS book imbalance drift high"),
        F.when(imbalance.isNull(), "local WS imbalance unavailable"),
    ))


def context_label(action: Column, quality: Column, trend_5m: Column, trend_15m: Column, premium: Column, imbalance: Column, oi_change: Column) -> Column:
    """CONFIRMED, CONFLICTING, MIXED or INSUFFICIENT for an action; null where the context isn't OK."""
    action = F.upper(F.coalesce(action, F.lit("WAITING")))
    num = lambda c: F.coalesce(c, F.lit(0.0))
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    longs = one(trend_5m == "up") + one(trend_15m == "up") + one(num(imbalance) > 0) + one(num(oi_change) > 0)
    shorts = one(trend_5m == "down") + one(trend_15m == "down") + one(num(imbalance) < 0) + one(num(oi_change) > 0)
    p = num(premium)
    long_ = F.when((longs >= 3) & (p > -0.05), "CONFIRMED").when((shorts >= 2) | (p > 0.12), "CONFLICTING").otherwise("MIXED")
    short = F.when((shorts >= 3) & (p < 0.08), "CONFIRMED").when(longs >= 2, "CONFLICTING").otherwise("MIXED")
    return F.when(~quality.eqNullSafe("OK"), None).when(action.contains("LONG"), long_).when(action.contains("SHORT"), short).otherwise("INSUFFICIENT")


def spoof(pulled: Column, executed: Column, life_ms: Column, cfg: Config = C) -> Column:
    return (pulled >= cfg.spoof_pulled) & (life_ms <= cfg.spoof_ms) & (executed < cfg.spoof_executed * pulled)


def entry_side(action: Column, ratio: Column, imbalance: Column, cvd: Column, healthy: Column, spread_bps: Column, duplicated: Column) -> Column:
    """BUY or SELL where every filter of a high-probability entry passes, else null."""
    usable = healthy & (spread_bps < 15.0) & ~duplicated
    longs = action.isin("CONFIRMED_LONG", "LONG (SWEEP)", "LONG_BIAS") & (ratio >= 0.58) & (imbalance >= 0.20) & (cvd > 0)
    shorts = action.isin("CONFIRMED_SHORT", "SHORT (SWEEP)", "SHORT_BIAS") & (ratio <= 0.42) & (imbalance <= -0.20) & (cvd < 0)
    return F.when(usable & longs, "BUY").when(usable & shorts, "SELL")


def transition_alert(old: Column, new: Column) -> Column:
    """What a change of action tells the reader."""
    kind = F.when(new == "CONFIRMED_LONG", "BUY").when(new == "CONFIRMED_SHORT", "SELL").when(new.isin("WATCH_LONG", "WATCH_SHORT"), new)
    return F.when(~old.eqNullSafe(new), kind)


def order_quantity(usdt: Column, price: Column) -> Column:
    return F.when((usdt > 0) & (price > 0), usdt / price)


def expired(age_s: Column, ttl_s: float, fallback: Column) -> Column:
    return (age_s > ttl_s) | fallback
