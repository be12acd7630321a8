"""Recorded messages through the whole pipeline: books back into depth messages, and depth messages into books."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import dec
from tidemark.operators import book, depth, folds
from tidemark.session import written
from tidemark.sources import readers

#: Positions for each millisecond of receipt: messages of one symbol in one millisecond stand by update id.
PER_MS = 1_000


def depth_messages(levels: DataFrame) -> DataFrame:
    """Snapshots (symbol, snap_ms, side, price, qty) as depth messages (symbol, ms, u, pu, bids, asks): what has changed since the one before.

    Update ids count a symbol's snapshots. A price that is gone is sent with size 0.
    """
    numbered = book.snapshot_sequence(levels)
    own = levels.join(numbered.select("symbol", "snap_ms", "i"), ["symbol", "snap_ms"]).select("symbol", "i", "side", "price", "qty")
    before = own.select("symbol", (F.col("i") + 1).alias("i"), "side", "price", F.col("qty").alias("_old"))
    both = own.join(before, ["symbol", "i", "side", "price"], "full").where("qty is null or _old is null or qty <> _old")
    level = F.array(F.col("price").cast("string"), F.coalesce(F.col("qty"), F.lit(0)).cast("string"))
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, level)))
    changed = both.groupBy("symbol", "i").agg(side("BID").alias("bids"), side("ASK").alias("asks"))
    # A snapshot that is as the one before is a message all the same; what the last one leaves is not taken away.
    empty = F.array().cast("array<array<string>>")
    out = numbered.join(changed, ["symbol", "i"], "left")
    return out.select("symbol", F.col("snap_ms").alias("ms"), F.col("i").alias("u"), (F.col("i") - 1).alias("pu"), F.coalesce("bids", empty).alias("bids"), F.coalesce("asks", empty).alias("asks"))


def recorded(trades: DataFrame, messages: DataFrame) -> DataFrame:
    """Trades and depth messages as one recording (stream, data, receive_time, exchange_time, symbol), in the exchange's own field names."""
    text = lambda c: F.col(c).cast("string")
    trade = F.struct(F.lit("aggTrade").alias("e"), F.col("agg_id").alias("a"), text("price").alias("p"), text("quantity").alias("q"), F.col("ms").alias("T"), (F.col("side") == "SELL").alias("m"))
    update = F.struct(F.lit("depthUpdate").alias("e"), F.col("ms").alias("E"), F.col("u").alias("U"), "u", "pu", F.col("bids").alias("b"), F.col("asks").alias("a"))
    line = lambda df, name, body: df.select(F.concat("symbol", F.lit(name)).alias("stream"), F.to_json(body).alias("data"), (F.col("ms") / 1000).alias("receive_time"), (F.col("ms") / 1000).alias("exchange_time"), "symbol")
    return line(trades, "@aggTrade", trade).unionByName(line(messages, "@depth", update))


def replayed_levels(messages: DataFrame, width: int = 3_600_000 * PER_MS) -> DataFrame:
    """The book after each accepted depth message of :func:`~tidemark.sources.readers.depth_of`: (symbol, snap_ms, side, price, qty, notional).

    Without a snapshot the first message starts the book, as in a recording
    that was begun in the middle. Messages come by time of receipt, then id;
    of several in one millisecond the book after the last is shown.
    """
    ms = F.round(F.col("receive_time") * 1000).cast("long")
    within = F.row_number().over(Window.partitionBy("symbol", "_ms").orderBy("u")) - 1
    numbered = messages.withColumn("_ms", ms).withColumn("pos", F.col("_ms") * PER_MS + within).drop("_ms")
    verdicts = written(folds.sequence_verdicts(numbered, width=width))
    changes = readers.level_changes(verdicts.withColumn("u", F.col("pos"))).withColumnRenamed("u", "pos")
    exact = changes.select("symbol", "pos", "side", F.col("price").cast("decimal(10,2)").alias("price"), F.col("qty").cast("decimal(18,2)").alias("qty"))
    lives = depth.level_lives(verdicts.select("symbol", "pos", "verdict", "epoch"), exact, width)
    ticks = verdicts.where("verdict = 'OK'").groupBy("symbol", F.floor(F.col("pos") / PER_MS).alias("snap_ms")).agg(F.max("pos").alias("pos"))
    levels = depth.book_at(lives, ticks, width).join(ticks, ["symbol", "pos"])
    return levels.select("symbol", "snap_ms", "side", "price", "qty", dec(F.col("price") * F.col("qty")).alias("notional"))
