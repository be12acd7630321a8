"""Analytics over event logs, and status roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import dec

CATEGORIES = ("ABSORPTION", "DIVERGENCE", "BURST", "AGGRESSION")


def real_events(events: DataFrame, prefix: str = "mock_") -> DataFrame:
    """Without rows of mock sweeps."""
    return events.where(~F.coalesce(F.col("sweep_id").startswith(prefix), F.lit(False))) if "sweep_id" in events.columns else events


def event_totals(events: DataFrame, score: int = 7) -> DataFrame:
    """One row: events, symbols, scored events, confluences and their average score."""
    return events.agg(
        F.count("*").alias("events"), F.count_distinct("symbol").alias("symbols"), F.count("score").alias("scored"), F.count_if(F.col("score") >= score).alias("confluences"),
        F.round(F.sum(F.col("score").cast("decimal(18,4)")).cast("double") / F.count("score"), 6).alias("average_score"))


def share_by(events: DataFrame, key: str) -> DataFrame:
    """(key, n, percent) over all rows, by count."""
    counts = events.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))  # one row
    return counts.join(F.broadcast(total)).withColumn("percent", F.round(F.col("n") * 100 / F.col("_all"), 4)).drop("_all").orderBy(F.desc("n"), key)


def notional_flow(trades: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` symbols of largest traded value with their share."""
    flow = trades.groupBy("symbol").agg(F.sum("notional").alias("v"))
    total = flow.agg(F.sum("v").alias("_all"))
    out = flow.join(F.broadcast(total)).select("symbol", F.col("v").cast("double").alias("notional"), F.round(F.col("v").cast("double") * 100 / F.col("_all").cast("double"), 4).alias("percent"))
    return out.orderBy(F.desc("notional"), "symbol").limit(n)


def category_hotspots(events: DataFrame, n: int = 5) -> DataFrame:
    """For each category of event the ``n`` symbols with most of them."""
    category = F.coalesce(*[F.when(F.col("type").contains(c), c) for c in CATEGORIES])
    counts = events.withColumn("category", category).where("category is not null").groupBy("category", "symbol").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "symbol"))).where(F.col("rank") <= n)


def tail(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each key."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def sync_counters(verdicts: DataFrame, health: DataFrame | None = None) -> DataFrame:
    """Per symbol: messages, gaps, duplicates, messages out of order, rebuilt books.

    With ``health`` (symbol, ms, kind, value) also ``reconnects``, the rows of
    kind RECONNECT, and ``queue_depth``, the value of the last QUEUE row.
    """
    is_ = lambda v: F.count_if(F.col("verdict") == v)
    out = verdicts.groupBy("symbol").agg(F.count("*").alias("messages"), is_("GAP").alias("gaps"), is_("DUPLICATE").alias("duplicates"), is_("OUT_OF_ORDER").alias("out_of_order"), F.max("epoch").alias("resyncs"))
    if health is None:
        return out
    more = health.groupBy("symbol").agg(F.count_if(F.col("kind") == "RECONNECT").alias("reconnects"), F.max(F.when(F.col("kind") == "QUEUE", F.struct("ms", "value"))).getField("value").alias("queue_depth"))
    return out.join(more, "symbol", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("reconnects", "queue_depth")})


def global_status(states: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each ``by``) from (symbol, book_state, warming): a gap outranks a resync, that a full sync; windows warm up beside it."""
    s = F.col("book_state")
    flags = states.groupBy(*by).agg(F.bool_or(s == "GAP").alias("gap"), F.bool_or(s == "RESYNCING").alias("resync"), F.bool_and(s == "HEALTHY").alias("synced"), F.bool_or("warming").alias("warming"))
    return flags.withColumn("status", F.when(F.col("gap"), "SEQUENCE_GAP").when(F.col("resync"), "RESYNCING").when(F.col("synced"), "SYNCED").otherwise("INITIALISING")).withColumn("window_status", F.when(F.col("warming"), "WARMING").otherwise("VALID"))


def context_status(contexts: DataFrame) -> DataFrame:
    """One row: how many symbols have a good context, and the overall quality."""
    return contexts.agg(F.count("*").alias("symbols"), F.count_if(F.col("quality") == "OK").alias("ok_count")).withColumn(
        "quality", F.when(F.col("ok_count") == F.col("symbols"), "OK").when(F.col("ok_count") > 0, "PARTIAL").otherwise("STALE"))


def replay_summary(committed: DataFrame, trades: DataFrame) -> DataFrame:
    """Per symbol: ticks, transitions, last action, trades and running delta."""
    changes = committed.groupBy("symbol").agg(F.count("*").alias("ticks"), F.count_if(~F.col("committed").eqNullSafe(F.col("old_action"))).alias("transitions"), F.max_by("committed", "ms").alias("action"))
    value = F.when(F.col("side") == "BUY", F.col("notional")).otherwise(-F.col("notional"))
    flow = trades.groupBy("symbol").agg(F.count("*").alias("trades"), F.sum(dec(value)).cast("double").alias("cvd"))
    return flow.join(changes, "symbol", "left")


def portfolio(positions: DataFrame, marks: DataFrame, cash: Column | float, initial: float = 10_000.0) -> DataFrame:
    """One row: equity and profit of positions (symbol, side, qty, entry) at the marks; without a mark the entry price counts."""
    mark = F.coalesce(F.col("mark"), F.col("entry"))
    rows = positions.join(marks, "symbol", "left").withColumn("pnl", F.col("qty") * (mark - F.col("entry")) * F.when(F.col("side") == "BUY", 1).otherwise(-1)).withColumn("value", F.col("qty") * mark)
    total = lambda c: F.coalesce(F.sum(F.round(c, 6).cast("decimal(28,6)")), F.lit(0)).cast("double")
    out = rows.agg(F.count("*").alias("n"), total("pnl").alias("unrealized"), total("value").alias("value"))
    equity = F.lit(cash) + F.col("unrealized")
    return out.withColumn("equity", equity).withColumn("total_pct", F.when(F.lit(initial) > 0, (equity - initial) / initial * 100).otherwise(0.0))


def new_rows(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key wasn't processed, one for each key."""
    return rows.dropDuplicates([key]).join(done.select(key), key, "left_anti")
