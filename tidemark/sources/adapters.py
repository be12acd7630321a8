"""The test tables as trades, book levels, sweeps, alerts and signals.

Time is compressed sixtyfold, so that 30 days of events become 12 hours of
trades and their windows fill. Book snapshots lie on the same time line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import dec

SYMBOLS = ("click", "error", "purchase", "signup", "view")
START_MS = 28_401_120_000
SNAP_MS = 500_000
FIRST_SNAP = 304
ALERTS = ("SELL_AGGRESSION", "BUY_AGGRESSION", "POSSIBLE_BULLISH_ABSORPTION", "CONFIRMED_BEARISH_ABSORPTION", "BULLISH_DIVERGENCE", "BEARISH_DIVERGENCE")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed(events: DataFrame) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return events.withColumn("ts", ts).withColumn("ms", F.expr("unix_micros(ts) div 60000")).withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed(table(spark, sf_dir, "events"))


def _symbol(n):
    return F.get(F.array(*[F.lit(s) for s in SYMBOLS]), n.cast("int"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades_from(table(spark, sf_dir, "events"))


def trades_from(events: DataFrame) -> DataFrame:
    """(symbol, agg_id, ms, day, price, quantity, side, notional) of a table or stream of events; notional is exact."""
    quantity = F.col("k") % 10 + 1
    return timed(events).select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("agg_id"), "ms", F.to_date("ts").alias("day"), F.col("value").alias("price"),
        quantity.cast("double").alias("quantity"), F.when(F.col("k") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        dec(F.col("value").cast("decimal(18,6)") * quantity).alias("notional"),
    )


def book_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, snap_ms, side, price, qty, notional): a grid of 2 bps steps around 100; prices and sizes are exact."""
    tick = F.col("l_partkey") % 101 - 50
    snap = F.expr("unix_micros(cast(l_shipdate as timestamp)) div 2592000000000") - FIRST_SNAP
    price = (100 + tick * F.lit(0.02).cast("decimal(4,2)")).cast("decimal(10,2)")
    rows = table(spark, sf_dir, "lineitem").where(tick != 0).select(
        _symbol(F.col("l_suppkey") % 5).alias("symbol"), (START_MS + snap * SNAP_MS).alias("snap_ms"), F.when(tick < 0, "BID").otherwise("ASK").alias("side"),
        price.alias("price"), F.col("l_quantity").cast("decimal(18,2)").alias("q"),
    )
    out = rows.groupBy("symbol", "snap_ms", "side", "price").agg(F.sum("q").cast("decimal(18,2)").alias("qty"))
    return out.withColumn("notional", dec(F.col("price") * F.col("qty")))


def sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sweep_id, symbol, ms, direction, level)."""
    e = _timed(spark, sf_dir).where("event_type = 'signup'")
    return e.select(F.col("event_id").alias("sweep_id"), _symbol(F.col("user_id") % 5).alias("symbol"), "ms", F.when(F.col("k") % 2 == 0, "BULLISH").otherwise("BEARISH").alias("direction"), F.col("value").alias("level"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(alert_id, symbol, ms, type, window, price)."""
    e = _timed(spark, sf_dir).where("event_type = 'error'")
    kind = F.get(F.array(*[F.lit(a) for a in ALERTS]), F.col("k") % len(ALERTS))
    return e.select(F.col("event_id").alias("alert_id"), _symbol(F.col("user_id") % 5).alias("symbol"), "ms", kind.alias("type"), F.when(F.col("k") % 3 == 0, "5m").otherwise("1m").alias("window"), F.col("value").alias("price"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(signal_id, symbol, ms, action, price): entries whose outcome is tracked."""
    e = _timed(spark, sf_dir).where("event_type = 'purchase'")
    return e.select(F.col("event_id").alias("signal_id"), _symbol(F.col("user_id") % 5).alias("symbol"), "ms", F.when(F.col("k") % 2 == 0, "CONFIRMED_LONG").otherwise("CONFIRMED_SHORT").alias("action"), F.col("value").alias("price"))


def depth_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, pos, u, pu): update ids by symbol, with a broken link on every 97th and a repeat on every 89th."""
    rows = table(spark, sf_dir, "lineitem").select(_symbol(F.col("l_suppkey") % 5).alias("symbol"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), "l_partkey")
    rows = rows.groupBy("symbol", "pos").agg(F.min("l_partkey").alias("part"))
    return rows.select("symbol", "pos", (F.col("pos") - F.when(F.col("part") % 89 == 0, 200).otherwise(0)).alias("u"), F.when(F.col("part") % 97 == 0, F.col("pos") - 3).otherwise(F.lit(None).cast("long")).alias("pu"))
