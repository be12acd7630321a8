"""The local order book from a snapshot and a stream of differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.blocks import neighbour


def sync_start(snapshots: DataFrame, diffs: DataFrame, width: int = 1_000_000) -> DataFrame:
    """(symbol, last_id, first_u, state): where each snapshot (symbol, last_id) joins the buffered differences (symbol, first_u, u).

    Differences up to the snapshot are dropped. The first of the rest must
    span last_id + 1 (HEALTHY); if it begins later there is a GAP; without any
    the book is still SYNCING. Ids are cut into blocks of ``width``: the next
    difference is in the snapshot's block or heads the next block that has any.
    """
    d = diffs.select("symbol", F.col("u").alias("id"), F.lit(1).alias("kind"), F.struct("u", "first_u").alias("d"))
    s = snapshots.select("symbol", F.col("last_id").alias("id"), F.lit(0).alias("kind"), F.lit(None).cast("struct<u:bigint,first_u:bigint>").alias("d"))
    rows = s.unionByName(d).withColumn("_block", F.floor(F.col("id") / width))
    heads = rows.groupBy("symbol", "_block").agg(F.min("d").alias("_head"))
    later = Window.partitionBy("symbol").orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    heads = heads.select("symbol", "_block", F.first("_head", ignorenulls=True).over(later).alias("_next"))
    down = Window.partitionBy("symbol", "_block").orderBy(F.desc("id"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("_near", F.min("d").over(down)).where("kind = 0").join(heads, ["symbol", "_block"])
    first = F.coalesce("_near", "_next")
    at = F.col("last_id") + 1
    state = F.when(F.col("f").isNull(), "SYNCING").when((F.col("f.first_u") <= at) & (at <= F.col("f.u")), "HEALTHY").otherwise("GAP")
    return near.select("symbol", F.col("id").alias("last_id"), first.alias("f")).select("symbol", "last_id", F.col("f.first_u").alias("first_u"), state.alias("state"))


def book_at_end(changes: DataFrame) -> DataFrame:
    """The book after all accepted changes (symbol, epoch, u, side, price, qty): the last size of each price in the last epoch, without zeros."""
    last = changes.groupBy("symbol").agg(F.max("epoch").alias("epoch"))
    sizes = changes.join(last, ["symbol", "epoch"]).groupBy("symbol", "side", "price").agg(F.max_by("qty", "u").alias("qty"), F.max("u").alias("u"))
    return sizes.where("qty > 0")


def book_states(verdicts: DataFrame) -> DataFrame:
    """Each message with the state it leaves the book in."""
    return verdicts.withColumn("book_state", F.when(F.col("verdict") == "GAP", "RESYNCING").otherwise("HEALTHY"))


def previous_ids(diffs: DataFrame, width: int = 100_000) -> DataFrame:
    """Depth messages (symbol, pos, u) with the id of the message before."""
    return neighbour(diffs, ["symbol"], ["pos"], "pos", width, F.col("u"), "previous_u")


# --- the book at any time -----------------------------------------------------------------------


def level_lives(messages: DataFrame, changes: DataFrame, width: int = 100_000) -> DataFrame:
    """How long each size stands: (symbol, epoch, side, price, qty, start, end), ``end`` exclusive and null while it stands.

    ``messages`` (symbol, pos, verdict, epoch) are all depth messages in order,
    ``changes`` (symbol, pos, side, price, qty) the levels that they set; only
    those of accepted messages (OK) count. A size stands until the price is
    set anew on its side, or until the gap that ends its epoch and clears the
    book; a size of 0 takes the price away. Several sizes of one price in one
    message: the largest counts. Rows without a position, side or price say
    nothing.
    """
    accepted = messages.where("verdict = 'OK'").select("symbol", "pos", "epoch")
    sizes = changes.where("pos is not null and side is not null and price is not null").groupBy("symbol", "pos", "side", "price").agg(F.max("qty").alias("qty"))
    sizes = sizes.join(accepted, ["symbol", "pos"])
    # The message that shows a gap is the first of the next epoch.
    breaks = messages.groupBy("symbol", "epoch").agg(F.min("pos").alias("_break")).select("symbol", (F.col("epoch") - 1).alias("epoch"), "_break")
    lives = neighbour(sizes, ["symbol", "epoch", "side", "price"], ["pos"], "pos", width, F.col("pos"), "_next", ahead=True)
    lives = lives.join(breaks, ["symbol", "epoch"], "left").where("qty > 0")
    return lives.select("symbol", "epoch", "side", "price", "qty", F.col("pos").alias("start"), F.least("_next", "_break").alias("end"))


def book_at(lives: DataFrame, ticks: DataFrame, width: int = 1_000) -> DataFrame:
    """The levels that stand at each tick (symbol, pos): (symbol, pos, side, price, qty), in the form of a snapshot.

    A message counts at its own position. Lives and ticks meet in blocks of
    ``width`` positions: a life is in every block that it touches, from its
    start to its end or to the last block with ticks of its symbol.
    """
    block = lambda c: F.floor(F.col(c) / width)
    asked = ticks.select("symbol", "pos").distinct().withColumn("_block", block("pos"))
    last = asked.groupBy("symbol").agg(F.max("pos").alias("_last"))
    spans = lives.join(last, "symbol").withColumn("_until", F.least(F.coalesce(F.col("end") - 1, F.col("_last")), F.col("_last"))).where("start <= _until")
    spans = spans.withColumn("_block", F.explode(F.sequence(block("start"), block("_until"))))
    met = asked.join(spans, ["symbol", "_block"]).where((F.col("start") <= F.col("pos")) & (F.col("pos") <= F.col("_until")))
    return met.select("symbol", "pos", "side", "price", "qty")


def top_of_book(levels: DataFrame, ticks: DataFrame, depth: int = 5) -> DataFrame:
    """Each tick (symbol, pos) with best bid and ask, mid, spread in basis points, and imbalance of the ``depth`` best levels by value.

    Nulls where a side is empty; the imbalance is then that of the other side alone, and 0 of an empty book.
    """
    best = Window.partitionBy("symbol", "pos", "side").orderBy(F.when(F.col("side") == "BID", -F.col("price")).otherwise(F.col("price")))
    ranked = levels.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= depth)
    of = lambda side, c: F.when(F.col("side") == side, c)
    value = F.col("price") * F.col("qty")
    sums = ranked.groupBy("symbol", "pos").agg(
        F.max(of("BID", F.col("price"))).alias("best_bid"), F.min(of("ASK", F.col("price"))).alias("best_ask"),
        F.coalesce(F.sum(of("BID", value)), F.lit(0)).alias("_bids"), F.coalesce(F.sum(of("ASK", value)), F.lit(0)).alias("_asks"),
    )
    out = ticks.select("symbol", "pos").distinct().join(sums, ["symbol", "pos"], "left")
    mid = (F.col("best_bid") + F.col("best_ask")) / 2
    total = F.col("_bids") + F.col("_asks")
    imbalance = F.when(total > 0, ((F.col("_bids") - F.col("_asks")) / total).cast("double")).otherwise(F.lit(0.0))
    return out.select("symbol", "pos", "best_bid", "best_ask", mid.cast("double").alias("mid"), ((F.col("best_ask") - F.col("best_bid")) / mid * 10_000).cast("double").alias("spread_bps"), imbalance.alias("imbalance"))
