"""Registered queries that replay recordings through the pipeline, follow a growing file, and run streams with state to their end."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from tidemark.operators import blocks, book, decisions, folds, replay, reports, trades
from tidemark.plans.decision_queries import _ALL, _COMMITTED, GRID, _features_of
from tidemark.plans.registry import LEVELS, SWEEPS, TRADES, query
from tidemark.plans.trade_queries import _WALLS, CFG, r6
from tidemark.session import shared_dir, written
from tidemark.sources import adapters as src
from tidemark.sources import readers, sinks
from tidemark.sources.tail import tail
from tidemark.streaming import live

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_store(spark):
    """The state store that has maps and timers, for the streams started meanwhile."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def _landed(spark, rows, at: str, files: int = 6):
    """``rows`` (with ms) landed in any order as a stream of files, and how late they may be; one row that comes last moves the watermark past them all."""
    rows = written(rows)
    rows.repartition(files).write.parquet(f"{at}/landed")
    ends = rows.agg(F.min("ms").alias("first"), F.max("ms").alias("last")).first()
    seconds = ((ends.last or 0) - (ends.first or 0)) // 1000 + 2
    rows.limit(1).withColumn("ms", F.lit((ends.last or 0) + (seconds + 2) * 1000)).write.mode("append").parquet(f"{at}/landed")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(f"{at}/landed"), f"{seconds} seconds"


def _drained(spark, rows, at: str):
    """All rows of a stream that runs to the end of what has landed, in append mode."""
    with _state_store(spark):
        rows.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/out")


@query("s7_replay_pipeline", f"""WITH RECURSIVE {_ALL}, {_COMMITTED}, fl AS (SELECT symbol, count(*) AS trades, round(CAST(sum(signed) AS DOUBLE), 6) AS cvd FROM trades GROUP BY symbol),
cc AS (SELECT symbol, count(*) AS ticks, count(*) FILTER (WHERE committed <> old_action) AS transitions, arg_max(committed, ms) AS action FROM co GROUP BY symbol) SELECT * FROM fl LEFT JOIN cc USING (symbol)""")
def s7_replay(spark, d):
    """Trades and depth messages recorded as gzip JSON lines; books, features, decisions and the summary come from the recording alone."""
    path = shared_dir(spark)
    sinks.write_recording(replay.recorded(src.trades(spark, d), replay.depth_messages(written(src.book_levels(spark, d)))), path)
    rows = readers.recordings(spark, path + "/*/*")
    flow = written(readers.trades_of(rows).drop("receive_time"))
    features = _features_of(written(replay.replayed_levels(readers.depth_of(rows))))
    alerts = src.alerts(spark, d)
    scored = written(decisions.score_sweeps(src.sweeps(spark, d), flow, alerts, features, CFG))
    decided = decisions.evaluate(decisions.decision_inputs(flow, alerts, features, scored, GRID, CFG), CFG)
    return reports.replay_summary(folds.commit_decisions(decided, CFG), flow).select("symbol", "trades", r6("cvd"), "ticks", "transitions", "action")


@query("s4_growing_file", f"WITH {TRADES}, {SWEEPS} SELECT CAST(sweep_id AS VARCHAR) AS sweep_id, symbol, direction, level, CASE WHEN sweep_id % 3 = 0 THEN 'RAW_SWEEP' END AS state FROM sweeps")
def s4(spark, d):
    """All sweeps as lines of one file of both widths, followed by bytes in ranges of 64 kB until its end."""
    at = shared_dir(spark)
    i, blank = F.col("sweep_id"), F.lit("")
    when = F.date_format(F.timestamp_seconds(F.floor(F.col("ms") / 1000)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = [when, F.col("symbol"), F.col("direction"), F.col("level").cast("string")]
    wide = F.concat_ws(",", *head, blank, blank, blank, F.lit("RAW_SWEEP"), *[blank] * 5, i.cast("string"), F.lit("live"))
    lines = src.sweeps(spark, d).select(F.when(i % 3 == 0, wide).otherwise(F.concat_ws(",", *head, i.cast("string"))).alias("value"))
    lines.coalesce(1).write.text(f"{at}/log")
    file = spark.read.text(f"{at}/log").select(F.input_file_name()).first()[0]
    out = _drained(spark, readers.parse_sweeps(tail(spark, file, 65_536)), at)
    return out.select("sweep_id", "symbol", "direction", "level", "state")


@query("a15_live_walls", f"""WITH {_WALLS} SELECT symbol, CAST(price AS DOUBLE) AS price, side, first_ms, gone_ms, updates, round(largest, 6) AS most, round(average, 6) AS average,
  round(current, 6) AS current, round(added, 6) AS added, round(removed, 6) AS removed, refills FROM wf WHERE gone_ms IS NOT NULL""")
def a15_live(spark, d):
    """Walls that have gone, by a stream over snapshots landed in any order."""
    at = shared_dir(spark)
    level = F.struct("side", F.col("price").cast("double").alias("price"), F.col("notional").cast("double").alias("notional"))
    landed = src.book_levels(spark, d).groupBy("symbol", F.col("snap_ms").alias("ms")).agg(F.collect_list(level).alias("levels")).withColumn("seq", F.lit(0).cast("long"))
    rows, late = _landed(spark, landed, at)
    out = _drained(spark, live.live_walls(rows, CFG, late), at)
    return out.select("symbol", "price", "side", "first_ms", "gone_ms", "updates", *[r6(c) for c in ("most", "average", "current", "added", "removed")], "refills")


_FLOW = (("1m", 60_000), ("5m", 300_000), ("15m", 900_000))


@query("a1_live_windows", f"WITH {TRADES}, s AS (SELECT *, min(ms) OVER (PARTITION BY symbol) AS start FROM trades) SELECT symbol, agg_id, ms, " + ", ".join(
    f"round(CAST(sum(signed) OVER w{w} AS DOUBLE), 6) AS delta_{w}, count(*) OVER w{w} AS n_{w}, CASE WHEN ms - start < {ms} THEN 'WARMING_UP' ELSE 'VALID' END AS status_{w}" for w, ms in _FLOW)
    + " FROM s WINDOW " + ", ".join(f"w{w} AS (PARTITION BY symbol ORDER BY ms RANGE BETWEEN {ms} PRECEDING AND CURRENT ROW)" for w, ms in _FLOW))
def a1_live(spark, d):
    """The trailing windows of every trade, by a stream over trades landed in any order."""
    at = shared_dir(spark)
    rows, late = _landed(spark, src.trades(spark, d), at)
    x = _drained(spark, live.live_trailing(rows, dict(_FLOW), late), at)
    status = lambda ms: F.when(F.col("ms") - F.col("first_ms") < ms, "WARMING_UP").otherwise("VALID")
    return x.select("symbol", "agg_id", "ms", *[c for w, ms in _FLOW for c in (F.round((F.col(f"buy_{w}") - F.col(f"sell_{w}")).cast("double"), 6).alias(f"delta_{w}"), f"n_{w}", status(ms).alias(f"status_{w}"))])


@query("a4_live_bursts", f"""WITH {TRADES}, c AS (SELECT symbol, agg_id, count(*) OVER (PARTITION BY symbol ORDER BY ms RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW) AS n_recent,
  count(*) OVER (PARTITION BY symbol ORDER BY ms RANGE BETWEEN 600000 PRECEDING AND CURRENT ROW) AS n_back FROM trades)
SELECT symbol, agg_id, n_recent, round((n_back - n_recent) / 9.0::DOUBLE, 6) AS average, n_recent > 1.5 * greatest(1.0::DOUBLE, (n_back - n_recent) / 9.0::DOUBLE) AS burst FROM c""")
def a4_live(spark, d):
    """Bursts of every trade, by a stream over trades landed in any order."""
    at = shared_dir(spark)
    rows, late = _landed(spark, src.trades(spark, d), at)
    x = _drained(spark, live.live_trailing(rows, {"recent": CFG.burst_recent_ms, "back": CFG.burst_back_ms}, late), at)
    return trades.burst_columns(x, CFG).select("symbol", "agg_id", "n_recent", r6("average"), "burst")


# Every message follows the one before it but for broken links; a snapshot stands at every 20th order of a symbol.
_MESSAGES = """dd AS (SELECT ['click','error','purchase','signup','view'][(l_suppkey % 5) + 1] AS symbol, l_orderkey * 10 + l_linenumber AS pos, min(l_partkey) AS part FROM lineitem GROUP BY ALL),
ms AS (SELECT symbol, pos, 'difference' AS kind, pos - CASE WHEN part % 89 = 0 THEN 200 ELSE 0 END AS u, CASE WHEN part % 97 = 0 THEN pos - 3 ELSE coalesce(lag(pos) OVER (PARTITION BY symbol ORDER BY pos), 0) END AS pu FROM dd
  UNION ALL SELECT DISTINCT ['click','error','purchase','signup','view'][(o_custkey % 5) + 1], o_orderkey * 10 + 9, 'snapshot', o_orderkey * 10 + 9, NULL FROM orders WHERE o_orderkey % 20 = 0),
mi AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pos) AS i FROM ms),
bk AS (SELECT symbol, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS pos, '' AS verdict, 'INITIALISING' AS state, CAST(0 AS BIGINT) AS last FROM (SELECT DISTINCT symbol FROM ms)
  UNION ALL SELECT m.symbol, m.i, m.pos,
    CASE WHEN m.kind = 'snapshot' THEN 'SNAPSHOT' WHEN b.state = 'HEALTHY' THEN CASE WHEN m.u <= b.last THEN 'DUPLICATE' WHEN m.pu < b.last THEN 'OUT_OF_ORDER' WHEN m.pu > b.last THEN 'GAP' ELSE 'OK' END
      WHEN b.state = 'SYNCING' AND b.last > 0 AND m.u > b.last AND m.pu <= b.last THEN 'OK' ELSE 'BUFFERED' END,
    CASE WHEN m.kind = 'snapshot' THEN 'SYNCING' WHEN b.state = 'HEALTHY' THEN CASE WHEN m.u > b.last AND m.pu > b.last THEN 'RESYNCING' ELSE 'HEALTHY' END
      WHEN b.state = 'INITIALISING' THEN 'SYNCING' WHEN b.state = 'SYNCING' AND b.last > 0 AND m.u > b.last AND m.pu <= b.last THEN 'HEALTHY' ELSE b.state END,
    CASE WHEN m.kind = 'snapshot' THEN m.u WHEN b.state = 'HEALTHY' THEN CASE WHEN m.u <= b.last OR m.pu < b.last THEN b.last WHEN m.pu > b.last THEN 0 ELSE m.u END
      WHEN b.state = 'SYNCING' AND b.last > 0 AND m.u > b.last THEN CASE WHEN m.pu <= b.last THEN m.u ELSE 0 END ELSE b.last END
  FROM bk b JOIN mi m ON m.symbol = b.symbol AND m.i = b.i + 1)"""


def _messages(spark, d):
    """Differences and snapshots of all symbols (symbol, ms, seq, kind, first_u, u, pu, levels); a position is a millisecond."""
    part = F.col("part")
    dd = src.table(spark, d, "lineitem").groupBy(src._symbol(F.col("l_suppkey") % 5).alias("symbol"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ms")).agg(F.min("l_partkey").alias("part"))
    dd = blocks.neighbour(dd, ["symbol"], ["ms"], "ms", 50_000, F.col("ms"), "before")
    level = lambda side, price, qty: F.struct(F.lit(side).alias("side"), price.cast("double").alias("price"), qty.cast("double").alias("qty"))
    pu = F.when(part % 97 == 0, F.col("ms") - 3).otherwise(F.coalesce("before", F.lit(0)))
    u = F.col("ms") - F.when(part % 89 == 0, 200).otherwise(0)
    changes = dd.select("symbol", "ms", F.lit("difference").alias("kind"), (pu + 1).alias("first_u"), u.alias("u"), pu.alias("pu"), F.array(level("BID", 99 - part % 7, part % 3), level("ASK", 100 + part % 5, part % 4)).alias("levels"))
    o = src.table(spark, d, "orders").where("o_orderkey % 20 = 0").select(src._symbol(F.col("o_custkey") % 5).alias("symbol"), (F.col("o_orderkey") * 10 + 9).alias("ms")).distinct()
    whole = F.array(level("BID", F.lit(98), F.lit(5)), level("ASK", F.lit(101), F.lit(5)))
    snaps = o.select("symbol", "ms", F.lit("snapshot").alias("kind"), F.lit(None).cast("long").alias("first_u"), F.col("ms").alias("u"), F.lit(None).cast("long").alias("pu"), whole.alias("levels"))
    return changes.unionByName(snaps).withColumn("seq", F.lit(0).cast("long"))


@query("t12_live_book", f"WITH RECURSIVE {_MESSAGES} SELECT symbol, pos, verdict, state FROM bk WHERE i > 0")
def t12_live(spark, d):
    """What becomes of each message of a book that is kept in state, by a stream over messages landed in any order."""
    at = shared_dir(spark)
    rows, late = _landed(spark, _messages(spark, d), at)
    return _drained(spark, live.live_synced_books(rows, late), at).select("symbol", F.col("ms").alias("pos"), "verdict", "state")


@query("t12_synced_book", f"WITH RECURSIVE {_MESSAGES} SELECT symbol, pos, verdict, state FROM bk WHERE i > 0")
def t12(spark, d):
    """The same by a fold over the table."""
    return folds.synced_books(_messages(spark, d)).select("symbol", F.col("ms").alias("pos"), "verdict", "state")


@query("k10_nearest_level", f"""WITH {TRADES}, {LEVELS}, sn AS (SELECT DISTINCT symbol, snap_ms FROM levels), pt AS (SELECT symbol, agg_id, ms, 98.5 + CAST(price AS DOUBLE) % 3 AS price FROM trades),
b AS (SELECT pt.*, sn.snap_ms AS bef FROM pt ASOF LEFT JOIN sn ON sn.symbol = pt.symbol AND pt.ms >= sn.snap_ms),
a AS (SELECT b.*, sn.snap_ms AS aft FROM b ASOF LEFT JOIN sn ON sn.symbol = b.symbol AND b.ms <= sn.snap_ms),
n AS (SELECT *, CASE WHEN bef IS NULL OR aft - ms < ms - bef THEN aft ELSE coalesce(bef, aft) END AS near_ms FROM a),
r AS (SELECT n.symbol, agg_id, near_ms, side, l.price AS near_price, qty, row_number() OVER (PARTITION BY n.symbol, agg_id ORDER BY abs(CAST(l.price AS DOUBLE) - n.price), side DESC, CASE WHEN side = 'BID' THEN -l.price ELSE l.price END) AS k
  FROM n LEFT JOIN levels l ON l.symbol = n.symbol AND l.snap_ms = n.near_ms)
SELECT symbol, agg_id, near_ms, side AS near_side, near_price, qty AS near_qty FROM r WHERE k = 1""")
def k10_nearest(spark, d):
    """For each trade the book level that a pointer at its time and a price near the book would show."""
    t = src.trades(spark, d)
    points = t.select("symbol", "agg_id", "ms", (98.5 + F.col("price").cast("double") % 3).alias("price"))
    return book.nearest_levels(points, src.book_levels(spark, d)).select("symbol", "agg_id", "near_ms", "near_side", "near_price", "near_qty")
