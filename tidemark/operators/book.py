"""Metrics of order-book snapshots: rows (symbol, snap_ms, side, price, qty, notional)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions import labels
from tidemark.functions.scalars import price_bucket, ratio
from tidemark.operators.blocks import last_seen, range_pairs

C = Config()
KEYS = ("symbol", "snap_ms")


def by_snapshot(levels: DataFrame) -> DataFrame:
    """Dealt by snapshot once: every window and grouping below keeps this partitioning."""
    return levels.repartition(*KEYS)


def top_levels(levels: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` best levels of each side with their rank."""
    best = F.when(F.col("side") == "BID", -F.col("price")).otherwise(F.col("price"))
    rank = F.row_number().over(Window.partitionBy(*KEYS, "side").orderBy(best))
    return by_snapshot(levels).withColumn("rank", rank).where(F.col("rank") <= n)


def _with_mid(levels: DataFrame) -> DataFrame:
    """Levels of snapshots that have both sides, with best prices and mid."""
    w = Window.partitionBy(*KEYS)
    bid, ask = F.col("side") == "BID", F.col("side") == "ASK"
    out = levels.withColumn("best_bid", F.max(F.when(bid, F.col("price"))).over(w)).withColumn("best_ask", F.min(F.when(ask, F.col("price"))).over(w))
    out = out.where("best_bid is not null and best_ask is not null")
    return out.withColumn("best_bid", F.col("best_bid").cast("double")).withColumn("best_ask", F.col("best_ask").cast("double")).withColumn("mid", (F.col("best_bid") + F.col("best_ask")) / 2)


def _imbalance(mask: Column, bid: Column, amount: Column) -> Column:
    b, a = F.sum(F.when(mask & bid, amount)), F.sum(F.when(mask & ~bid, amount))
    b, a = F.coalesce(b, F.lit(0)).cast("double"), F.coalesce(a, F.lit(0)).cast("double")
    return ratio(b - a, b + a, 0.0)


def book_metrics(levels: DataFrame, n: int = 100, near: int = 5) -> DataFrame:
    """One row for each snapshot: spread, depth, imbalances in bands around mid, microprice."""
    rows = _with_mid(top_levels(levels, n))
    bid = F.col("side") == "BID"
    gap = F.when(bid, F.col("mid") - F.col("price").cast("double")).otherwise(F.col("price").cast("double") - F.col("mid")) / F.col("mid") * 10000
    rows = rows.withColumn("bps", F.round(gap, 6))
    top, every = F.col("rank") <= near, F.lit(True)
    depth = lambda side: F.coalesce(F.sum(F.when(top & (F.col("side") == side), F.col("notional"))), F.lit(0)).cast("double")
    weighted = F.when(F.col("bps") <= 30, (1 - F.col("bps") / 30).cast("decimal(18,10)") * F.col("notional").cast("decimal(18,4)"))
    first = lambda side: F.max(F.when((F.col("rank") == 1) & (F.col("side") == side), F.col("qty"))).cast("double")
    out = rows.groupBy(*KEYS).agg(
        F.max("best_bid").alias("best_bid"), F.max("best_ask").alias("best_ask"), F.max("mid").alias("mid"),
        depth("BID").alias("bid_depth"), depth("ASK").alias("ask_depth"), first("BID").alias("bid_qty"), first("ASK").alias("ask_qty"),
        _imbalance(F.col("bps") <= 5, bid, F.col("notional")).alias("imbalance_0_5"), _imbalance((F.col("bps") > 5) & (F.col("bps") <= 15), bid, F.col("notional")).alias("imbalance_5_15"),
        _imbalance((F.col("bps") > 15) & (F.col("bps") <= 30), bid, F.col("notional")).alias("imbalance_15_30"), _imbalance(every, bid, F.col("notional")).alias("imbalance_total"),
        _imbalance(F.col("bps") <= 30, bid, weighted).alias("imbalance_weighted"))
    spread = F.col("best_ask") - F.col("best_bid")
    depth_sum = F.col("bid_depth") + F.col("ask_depth")
    micro = (F.col("best_bid") * F.col("ask_qty") + F.col("best_ask") * F.col("bid_qty")) / (F.col("bid_qty") + F.col("ask_qty"))
    micro = F.when(F.col("bid_qty") + F.col("ask_qty") > 0, micro).otherwise(F.col("mid"))
    return out.withColumns({
        "spread": spread, "spread_bps": F.when(F.col("mid") > 0, spread / F.col("mid") * 10000).otherwise(0.0),
        "imbalance": ratio(F.col("bid_depth") - F.col("ask_depth"), depth_sum, 0.0),
        "microprice": micro, "microprice_bps": F.when(F.col("mid") > 0, (micro - F.col("mid")) / F.col("mid") * 10000).otherwise(0.0),
    })


def vacuum(levels: DataFrame, cfg: Config = C) -> DataFrame:
    """(symbol, snap_ms, up, down): depth within 15 bps of mid below a share of the reference (top bid) depth."""
    rows = _with_mid(top_levels(levels))
    p, mid = F.col("price").cast("double"), F.col("mid")
    near = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("notional"))), F.lit(0)).cast("double")
    out = rows.groupBy(*KEYS).agg(
        near((F.col("side") == "BID") & (p >= mid * 0.9985) & (p <= mid)).alias("bid_near"), near((F.col("side") == "ASK") & (p <= mid * 1.0015) & (p >= mid)).alias("ask_near"),
        near((F.col("side") == "BID") & (F.col("rank") <= 5)).alias("ref"))
    limit = F.col("ref") * cfg.vacuum_share
    return out.withColumn("up", (F.col("ref") > 0) & (F.col("ask_near") < limit)).withColumn("down", (F.col("ref") > 0) & (F.col("bid_near") < limit))


def nearest_snapshot(snaps: DataFrame, back_ms: int, keep_ms: int) -> DataFrame:
    """(symbol, snap_ms, hist_ms): of the last ``keep_ms`` the snapshot nearest to ``back_ms`` ago; the earlier on ties."""
    hist = snaps.select("symbol", F.col("snap_ms").alias("hist_ms"))
    pairs = range_pairs(snaps, hist, ["symbol"], "snap_ms", "hist_ms", -keep_ms, 0, max(keep_ms, 1))
    far = F.abs(F.col("hist_ms") - (F.col("snap_ms") - back_ms))
    return pairs.groupBy(*KEYS).agg(F.min(F.struct(far.alias("far"), F.col("hist_ms"))).getField("hist_ms").alias("hist_ms"))


def stacking(levels: DataFrame, back_ms: int = 5_000, keep_ms: int = 20_000, range_pct: float = 0.01) -> DataFrame:
    """What was added and pulled around mid since the earlier snapshot, and the net shift.

    Both snapshots' levels are added up with opposite signs, which is the full
    outer join on price without a join.
    """
    mids = _with_mid(by_snapshot(levels)).groupBy(*KEYS).agg(F.max("mid").alias("mid"))
    pairs = nearest_snapshot(mids.select(*KEYS), back_ms, keep_ms)
    now = levels.select(*KEYS, "side", "price", F.col("qty").alias("d"))
    old = levels.withColumnRenamed("snap_ms", "hist_ms").join(pairs.where("hist_ms <> snap_ms"), ["symbol", "hist_ms"]).select(*KEYS, "side", "price", (-F.col("qty")).alias("d"))
    still = pairs.where("hist_ms = snap_ms").select(*KEYS, F.lit(0).alias("same"))  # nothing earlier: no change
    diff = now.unionByName(old).groupBy(*KEYS, "side", "price").agg(F.sum("d").alias("d")).join(still, list(KEYS), "left").join(mids, list(KEYS))
    p = F.col("price").cast("double")
    bid = (F.col("side") == "BID") & (p >= F.col("mid") * (1 - range_pct)) & (p <= F.col("mid"))
    ask = (F.col("side") == "ASK") & (p <= F.col("mid") * (1 + range_pct)) & (p >= F.col("mid"))
    value = F.when(F.col("same").isNull(), F.col("d") * F.col("price")).otherwise(F.lit(0))
    part = lambda cond, v: F.coalesce(F.sum(F.when(cond, v)), F.lit(0)).cast("double")
    up, down = F.greatest(value, F.lit(0)), F.greatest(-value, F.lit(0))
    out = diff.groupBy(*KEYS).agg(part(bid, up).alias("bids_added"), part(bid, down).alias("bids_pulled"), part(ask, up).alias("asks_added"), part(ask, down).alias("asks_pulled"))
    return out.withColumn("net_shift", F.col("bids_added") + F.col("asks_pulled") - F.col("bids_pulled") - F.col("asks_added"))


def snapshot_sequence(levels: DataFrame) -> DataFrame:
    """(symbol, snap_ms, i, next_ms): snapshots numbered by symbol (one short row for each)."""
    w = Window.partitionBy("symbol").orderBy("snap_ms")
    return levels.select(*KEYS).distinct().withColumn("i", F.row_number().over(w)).withColumn("next_ms", F.lead("snap_ms").over(w))


def wall_levels(levels: DataFrame, cfg: Config = C) -> DataFrame:
    """Levels worth at least max(least, multiple x the depth of the five best bids)."""
    rows = top_levels(levels)
    ref = F.sum(F.when((F.col("side") == "BID") & (F.col("rank") <= 5), F.col("notional"))).over(Window.partitionBy(*KEYS))
    rows = rows.withColumn("ref", F.coalesce(ref, F.lit(0)).cast("double"))
    return rows.where(F.col("notional").cast("double") >= F.greatest(F.lit(cfg.wall_least), F.col("ref") * cfg.wall_multiple))


def walls(levels: DataFrame, cfg: Config = C) -> DataFrame:
    """One row for each wall: an unbroken run of snapshots in which a price holds a large level.

    ``gone_ms`` is the first snapshot without it, null while it stands. A wall
    is refilled when it grows by over 30 % of its largest value from below 20 %.
    """
    rows = wall_levels(levels, cfg).join(snapshot_sequence(levels), list(KEYS)).withColumn("v", F.col("notional"))
    by = Window.partitionBy("symbol", "price").orderBy("i")
    rows = rows.withColumn("run", F.col("i") - F.row_number().over(by))
    own = Window.partitionBy("symbol", "price", "run").orderBy("i")
    rows = rows.withColumn("prev", F.lag("v").over(own)).withColumn("most", F.max("v").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    change = F.col("v") - F.col("prev")
    refill = (F.col("prev").cast("double") < F.col("most").cast("double") * 0.2) & (change.cast("double") > F.col("most").cast("double") * 0.3)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    out = rows.groupBy("symbol", "price", "run").agg(
        F.min_by("side", "i").alias("side"), F.min("snap_ms").alias("first_ms"), F.max("snap_ms").alias("last_ms"), F.max_by("next_ms", "i").alias("gone_ms"),
        F.count("*").alias("updates"), F.max("v").cast("double").alias("most"), (F.sum("v").cast("double") / F.count("*")).alias("average"), F.max_by("v", "i").cast("double").alias("current"),
        total(F.greatest(change, F.lit(0))).alias("added"), total(F.greatest(-change, F.lit(0))).alias("removed"), F.count_if(refill).alias("refills"))
    life = F.coalesce("gone_ms", "last_ms") - F.col("first_ms")
    return out.withColumn("life_ms", life).withColumn("standing", F.col("gone_ms").isNull()).drop("run")


def wall_scores(levels: DataFrame, cfg: Config = C) -> DataFrame:
    """Standing walls by size, persistence, proximity and stability, best first."""
    snap = book_metrics(levels).groupBy("symbol").agg(F.max_by("mid", "snap_ms").alias("mid"), F.max_by("bid_depth", "snap_ms").alias("ref"), F.max("snap_ms").alias("now"))
    w = walls(levels, cfg).where("standing").join(snap, "symbol")
    p = F.col("price").cast("double")
    score = (
        F.least(F.col("current") / F.col("ref"), F.lit(5.0)) * F.least((F.col("now") - F.col("first_ms")) / 60000, F.lit(1.0))
        * F.greatest(F.lit(0.0), 1 - F.abs(p - F.col("mid")) / F.col("mid") / 0.02) * F.col("average") / F.col("most"))
    usable = (F.col("current") > 0) & (F.col("ref") > 0) & (F.col("mid") > 0)
    return w.withColumn("score", F.when(usable, score).otherwise(0.0)).orderBy(F.desc("score"), "symbol", "price")


def executed_by_price(trades: DataFrame, bucket: float) -> DataFrame:
    return trades.groupBy("symbol", price_bucket(F.col("price"), bucket).alias("bucket")).agg(F.sum("notional").cast("double").alias("executed"))


def icebergs(trades: DataFrame, levels: DataFrame, bucket: float, cfg: Config = C) -> DataFrame:
    """(symbol, bucket, executed, displayed, iceberg): traded far more than the latest book shows."""
    last = levels.groupBy("symbol").agg(F.max("snap_ms").alias("snap_ms"))
    shown = levels.join(last, list(KEYS)).groupBy("symbol", price_bucket(F.col("price").cast("double"), bucket).alias("bucket")).agg(F.sum("notional").cast("double").alias("displayed"))
    out = executed_by_price(trades, bucket).join(shown, ["symbol", "bucket"])
    return out.withColumn("iceberg", (F.col("displayed") > 0) & (F.col("executed") > cfg.iceberg_multiple * F.col("displayed")))


def spoofs(walls_: DataFrame, executed: DataFrame, bucket: float, cfg: Config = C) -> DataFrame:
    """Walls that went, with what was pulled and traded there and whether it looks like spoofing."""
    gone = walls_.where("not standing").withColumn("bucket", price_bucket(F.col("price").cast("double"), bucket)).join(executed, ["symbol", "bucket"], "left")
    pulled = F.col("removed") + F.col("current")
    done = F.coalesce("executed", F.lit(0.0))
    return gone.select("symbol", "price", "first_ms", "life_ms", pulled.alias("pulled"), done.alias("executed"), labels.spoof(pulled, done, F.col("life_ms"), cfg).alias("spoof"))


def ladder(levels: DataFrame, n: int = 15) -> DataFrame:
    """The latest book of each symbol as a ladder: asks from the top down, then bids."""
    last = levels.groupBy("symbol").agg(F.max("snap_ms").alias("snap_ms"))
    rows = top_levels(levels.join(last, list(KEYS)), n)
    return rows.withColumn("line", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("price"))))


def heatmap(levels: DataFrame, full: float = 50.0) -> DataFrame:
    """Cells (symbol, snap_ms, price) with size from 0 to 1, and the extents of their symbol."""
    extent = levels.groupBy("symbol").agg(F.min("price").alias("low"), F.max("price").alias("high"), F.min("snap_ms").alias("from_ms"), F.max("snap_ms").alias("to_ms"))
    return levels.withColumn("heat", F.least(F.lit(1.0), F.col("qty").cast("double") / full)).join(extent, "symbol")


def rest_imbalance(bids: Column, asks: Column) -> Column:
    """Imbalance of arrays of [price, size] texts; null where both sides are empty."""
    side = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + F.get(x, F.lit(0)).cast("double") * F.get(x, F.lit(1)).cast("double"))
    return F.when(side(bids) + side(asks) > 0, (side(bids) - side(asks)) / (side(bids) + side(asks)))


def nearest_levels(points: DataFrame, levels: DataFrame, block_ms: int = 3_600_000) -> DataFrame:
    """``points`` (symbol, ms, price, ...) with the level shown there: near_ms, near_side, near_price, near_qty.

    The snapshot nearest in time (the earlier of two as near), and of its
    levels the one nearest in price: of two as near a bid, then the one that
    is nearer to the middle of the book. Both are looked for below and above
    along one sorted line, so a point costs the same however many levels
    there are. Nulls where the symbol has no book.
    """
    snaps = levels.select("symbol", F.col("snap_ms").alias("ms")).distinct()
    x = last_seen(points, snaps, ["symbol"], "ms", F.col("ms"), "_prior", block_ms)
    x = last_seen(x, snaps, ["symbol"], "ms", F.col("ms"), "_after", block_ms, ahead=True)
    later = F.col("_prior").isNull() | (F.col("_after") - F.col("ms") < F.col("ms") - F.col("_prior"))
    x = x.withColumn("near_ms", F.when(later, F.col("_after")).otherwise(F.coalesce("_prior", "_after"))).drop("_prior", "_after")
    bid = F.col("side") == "BID"
    # Larger is better: a bid, then the higher bid or the lower ask.
    rows = levels.select("symbol", F.col("snap_ms").alias("near_ms"), F.col("price").cast("double").alias("_at"), F.struct(bid.alias("bid"), "price", "qty").alias("_level"))
    x = x.withColumn("_at", F.col("price").cast("double"))
    keys = ["symbol", "near_ms"]
    x = last_seen(x, rows, keys, "_at", F.col("_level"), "_below", 1e12)
    x = last_seen(x, rows, keys, "_at", F.col("_level"), "_above", 1e12, ahead=True)
    below, above = F.col("_at") - F.col("_below.price").cast("double"), F.col("_above.price").cast("double") - F.col("_at")
    # As near on both sides: the bid, and of two bids the upper, of two asks the lower one.
    up = F.col("_below").isNull() | (above < below) | ((above == below) & F.col("_above.bid"))
    x = x.withColumn("_near", F.when(up, F.coalesce("_above", "_below")).otherwise(F.col("_below")))
    side = F.when(F.col("_near.bid"), "BID").when(~F.col("_near.bid"), "ASK")
    return x.select(*points.columns, "near_ms", side.alias("near_side"), F.col("_near.price").alias("near_price"), F.col("_near.qty").alias("near_qty"))
