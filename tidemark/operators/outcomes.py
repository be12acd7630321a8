"""What happened after signals: excursions, horizon prices, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions.labels import direction

C = Config()
HORIZONS = {"5m": 300_000, "15m": 900_000, "1h": 3_600_000}
#: Width of the cells by which whole stretches of trades are summed up.
CELL_MS = 60_000


def _moves(entry: Column, price: Column, side: Column) -> Column:
    """Percentage in the signal's favour; null for an entry at 0."""
    return F.try_divide(price - entry, entry) * 100 * F.when(side == "LONG", 1).otherwise(-1)


def forward_excursion(signals: DataFrame, trades: DataFrame, horizons: dict[str, int] = HORIZONS, cell_ms: int = CELL_MS) -> DataFrame:
    """Signals (signal_id, symbol, ms, action, price) with best, worst and final move and win per horizon.

    Trades in (t, t + h] count; without any, moves are 0 and the signal is no
    win. Values are rounded to 4 digits. Signals and ends of horizons lie on
    one time line with the trades, cut into cells: what a horizon holds is the
    rest of its first cell, the whole cells between, and its last cell up to
    its end. Each is a running value, so a row costs the same however many
    trades a horizon holds.
    """
    w = min(cell_ms, *horizons.values())  # so that a horizon never ends in its first cell
    cell = lambda at: F.floor(at / w)
    s = signals.withColumn("direction", direction(F.col("action")))
    t = trades.where("symbol is not null and ms is not null").select("symbol", F.col("ms").alias("at"), F.col("agg_id").alias("id"), F.lit(None).cast("string").alias("point"), F.col("price").alias("p"))
    point = lambda n, ms: F.struct((F.col("ms") + ms).alias("at"), F.lit(n).alias("point"))
    points = signals.where("symbol is not null and ms is not null").select("symbol", F.col("signal_id").alias("id"), F.explode(F.array(point("", 0), *[point(h, ms) for h, ms in horizons.items()])).alias("_p"))
    line = points.select("symbol", "_p.at", "id", "_p.point").unionByName(t, allowMissingColumns=True).withColumn("cell", cell(F.col("at")))
    # Of equal times trades come before points, both ways: they count at a horizon's end and not at its start.
    order = ["at", F.col("point").isNotNull(), "id"]
    so_far = Window.partitionBy("symbol", "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    to_come = Window.partitionBy("symbol", "cell").orderBy(*[F.desc(c) if isinstance(c, str) else c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    held = lambda over, last: F.struct(F.min("p").over(over).alias("lo"), F.max("p").over(over).alias("hi"), last("p", ignorenulls=True).over(over).alias("last"))
    met = line.withColumn("_before", held(so_far, F.last)).withColumn("_after", held(to_come, F.first)).where("point is not null")
    met = met.select("symbol", "cell", "id", "point", "at", F.when(F.col("point") == "", F.col("_after")).otherwise(F.col("_before")).alias("_end"))
    # A horizon ends so many cells after its first, or one more where it is no multiple of a cell.
    reaches = sorted({n for ms in horizons.values() for n in (ms // w, -(-ms // w))})
    met = met.join(_cells_ahead(t, points.where("_p.point = ''").select("symbol", cell(F.col("_p.at")).alias("cell")), cell, reaches), ["symbol", "cell"], "left")
    parts = []
    for h, ms in horizons.items():
        reach = cell(F.col("at") + ms) - F.col("cell")
        inner = F.coalesce(*[F.when(reach == n, F.col(f"_ahead_{n}")) for n in reaches])
        start = F.struct(F.least("_end.lo", inner["lo"]).alias("lo"), F.greatest("_end.hi", inner["hi"]).alias("hi"), F.coalesce(inner["last"], "_end.last").alias("last"))
        parts.append(F.when(F.col("point") == "", start).alias(f"_first_{h}"))
    ends = met.select("id", "point", "_end", *parts).groupBy(F.col("id").alias("signal_id"))
    aggs = []
    for h in horizons:
        one, other = f"_first_{h}", F.when(F.col("point") == h, F.col("_end"))
        aggs += [F.min(F.least(f"{one}.lo", other["lo"])).alias(f"lo_{h}"), F.max(F.greatest(f"{one}.hi", other["hi"])).alias(f"hi_{h}"), F.coalesce(F.max(other["last"]), F.max(f"{one}.last")).alias(f"last_{h}")]
    out, cols = s.join(ends.agg(*aggs), "signal_id", "left"), s.columns
    made = {}
    for h in horizons:
        low, high, last = (_moves(F.col("price"), F.col(f"{c}_{h}"), F.col("direction")) for c in ("lo", "hi", "last"))
        for c, move in (("best", F.greatest(low, high)), ("worst", F.least(low, high)), ("final", last)):
            made[f"{c}_{h}"] = F.round(F.coalesce(move, F.lit(0.0)), 4) + 0.0
        made[f"win_{h}"] = made[f"final_{h}"] > 0
    return out.select(*cols, *[c.alias(n) for n, c in made.items()])


def _cells_ahead(trades: DataFrame, wanted: DataFrame, cell: Callable[[Column], Column], reaches: list[int]) -> DataFrame:
    """Wanted (symbol, cell), each once, with ``_ahead_n``: lowest, highest and last price of the cells after it and before the n-th after it.

    Cells are copied into the blocks that look ahead to them, so that none
    needs a symbol's whole history.
    """
    far = max(reaches)
    price = F.when(F.col("p").isNotNull(), F.struct("at", "id"))
    cells = trades.groupBy("symbol", cell(F.col("at")).alias("cell")).agg(F.struct(F.min("p").alias("lo"), F.max("p").alias("hi"), F.max_by("p", price).alias("last")).alias("v"))
    line = cells.unionByName(wanted.distinct().withColumn("wanted", F.lit(True)), allowMissingColumns=True)
    line = line.groupBy("symbol", "cell").agg(F.first("v", ignorenulls=True).alias("v"), F.bool_or("wanted").alias("wanted"))
    block = lambda c: F.floor(c / far)
    line = line.withColumn("_block", F.explode(F.sequence(block(F.col("cell") - far), block(F.col("cell")))))
    ahead = lambda n: Window.partitionBy("symbol", "_block").orderBy("cell").rangeBetween(1, n - 1)
    held = lambda n: F.struct(F.min("v.lo").over(ahead(n)).alias("lo"), F.max("v.hi").over(ahead(n)).alias("hi"), F.last("v.last", ignorenulls=True).over(ahead(n)).alias("last"))
    nothing = F.lit(None).cast("struct<lo:double,hi:double,last:double>")
    own = line.withColumns({f"_ahead_{n}": held(n) if n > 1 else nothing for n in reaches}).where((F.col("_block") == block(F.col("cell"))) & F.col("wanted"))
    return own.select("symbol", "cell", *[f"_ahead_{n}" for n in reaches])


def performance_report(outcomes: DataFrame, horizons: dict[str, int] = HORIZONS) -> DataFrame:
    """(horizon, signals, precision, best, worst, final): averages over all signals."""
    parts = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), *[F.col(f"{c}_{h}").alias(c) for c in ("best", "worst", "final", "win")]) for h in horizons])).alias("x")
    mean = lambda c, n: F.round(F.sum(F.col(f"x.{c}").cast("decimal(18,4)")).cast("double") / F.count("*"), n)
    return outcomes.select(parts).groupBy("x.horizon").agg(
        F.count("*").alias("signals"), F.round(F.count_if("x.win") * 100 / F.count("*"), 2).alias("precision"),
        mean("best", 4).alias("best"), mean("worst", 4).alias("worst"), mean("final", 4).alias("final"))


def horizon_prices(signals: DataFrame, trades: DataFrame, after: dict[str, int] | None = None, wait_ms: int = 300_000, cfg: Config = C) -> DataFrame:
    """Signals with the price of the first trade at or after each horizon, within ``wait_ms``; null if not reached.

    Horizons and trades are put on one time line, cut into blocks that a trade
    reaches back into, and each horizon takes the next trade (with a price) on it.
    """
    after = after or {"1m": 60_000, "5m": 300_000, "15m": 900_000}
    width = cfg.block_ms
    block = lambda at: F.floor(at / width)
    points = signals.select("symbol", "signal_id", F.explode(F.array(*[F.struct((F.col("ms") + ms).alias("at"), F.lit(h).alias("horizon")) for h, ms in after.items()])).alias("p"))
    points = points.select("symbol", "signal_id", "p.at", "p.horizon", F.lit(None).cast("long").alias("agg_id"), block(F.col("p.at")).alias("_block"))
    t = trades.select("symbol", F.col("ms").alias("at"), "agg_id", F.col("price").alias("t_price"))
    t = t.withColumn("_block", F.explode(F.sequence(block(F.col("at") - wait_ms), block(F.col("at")))))
    line = points.unionByName(t, allowMissingColumns=True)
    # Backwards in time, so that the frame only grows: one that shrinks is summed up anew for each row.
    ahead = Window.partitionBy("symbol", "_block").orderBy(F.desc("at"), F.col("agg_id").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    trade = F.when(F.col("agg_id").isNotNull() & F.col("t_price").isNotNull(), F.struct("at", F.col("t_price").alias("price")))
    met = line.withColumn("_next", F.last(trade, ignorenulls=True).over(ahead)).where("horizon is not null")
    met = met.withColumn("_price", F.when(F.col("_next.at") - F.col("at") <= wait_ms, F.col("_next.price")))
    found = met.groupBy("signal_id").agg(*[F.max(F.when(F.col("horizon") == h, F.col("_price"))).alias(f"after_{h}") for h in after])
    return signals.join(found, "signal_id", "left")


def bias_performance(outcomes: DataFrame, horizon: str = "15m") -> DataFrame:
    """Count, win rate and average moves, for each symbol and in total (symbol null)."""
    mean = lambda c: F.round(F.sum(F.col(f"{c}_{horizon}").cast("decimal(18,4)")).cast("double") / F.count("*"), 6)
    return outcomes.rollup("symbol").agg(
        F.count("*").alias("signals"), F.count_if(F.col("direction") == "LONG").alias("longs"), F.count_if(F.col("direction") == "SHORT").alias("shorts"),
        F.round(F.count_if(f"win_{horizon}") * 100 / F.count("*"), 4).alias("win_rate"), mean("final").alias("final"), mean("best").alias("best"), mean("worst").alias("worst"))
