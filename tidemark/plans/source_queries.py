"""Registered queries that write files, read them back, and run streams to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.registry import SWEEPS, TRADES, query
from tidemark.plans.trade_queries import r6
from tidemark.session import shared_dir
from tidemark.sources import adapters as src
from tidemark.sources import readers, sinks
from tidemark.streaming import live


@query("s6_s7_recording_replay", f"WITH {TRADES} SELECT symbol, agg_id, ms, price, quantity, side, round(CAST(notional AS DOUBLE), 6) AS notional FROM trades")
def s7(spark, d):
    """All trades as raw messages through gzip JSON lines and back."""
    t, path = src.trades(spark, d), shared_dir(spark)
    num = lambda c: F.col(c).cast("string")
    raw = F.to_json(F.struct(F.lit("aggTrade").alias("e"), F.col("agg_id").alias("a"), num("price").alias("p"), num("quantity").alias("q"), F.col("ms").alias("T"), (F.col("side") == "SELL").alias("m")))
    rows = t.select(F.concat("symbol", F.lit("@aggTrade")).alias("stream"), raw.alias("data"), (F.col("ms") / 1000).alias("receive_time"), (F.col("ms") / 1000).alias("exchange_time"), "symbol")
    sinks.write_recording(rows, path)
    out = readers.trades_of(readers.recordings(spark, path + "/*/*"))
    return out.select("symbol", "agg_id", "ms", "price", "quantity", "side", F.round(F.col("notional").cast("double"), 6).alias("notional"))


@query("s4_s5_sweep_replay", f"""WITH {TRADES}, {SWEEPS}, w AS (SELECT *, CASE WHEN sweep_id % 3 = 0 THEN 'CLOSED' ELSE 'RAW_SWEEP' END AS state, CASE WHEN sweep_id % 4 = 0 THEN 'replay' ELSE 'live' END AS source FROM sweeps)
SELECT CAST(sweep_id AS VARCHAR) AS sweep_id, symbol, direction, level FROM w WHERE state = 'RAW_SWEEP' AND source = 'live' AND ms // 1000 >= 28444000 - 21600""")
def s5(spark, d):
    """All sweeps through wide CSV lines; the live, open ones of the last six hours come back once each."""
    path, blank = shared_dir(spark), F.lit("")
    i = F.col("sweep_id")
    when = F.date_format(F.timestamp_seconds(F.floor(F.col("ms") / 1000)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    state = F.when(i % 3 == 0, "CLOSED").otherwise("RAW_SWEEP")
    line = F.concat_ws(",", when, "symbol", "direction", F.col("level").cast("string"), blank, blank, blank, state, blank, blank, blank, blank, blank, i.cast("string"), F.when(i % 4 == 0, "replay").otherwise("live"))
    s = src.sweeps(spark, d).select(line.alias("value"))
    s.unionByName(s).write.text(path)
    out = readers.sweeps_to_replay(readers.sweeps(spark, path), F.timestamp_seconds(F.lit(28_444_000)), 6.0)
    return out.select("sweep_id", "symbol", "direction", "level")


@query("s8_s19_event_log", f"WITH {TRADES} SELECT symbol, price, round(CAST(notional AS DOUBLE), 4) AS delta, CAST(agg_id AS VARCHAR) AS notes FROM trades")
def s8(spark, d):
    """All trades as rows of the event log, written as CSV and read back."""
    path = shared_dir(spark)
    rows = src.trades(spark, d).select(F.col("ms").cast("string").alias("timestamp"), "symbol", F.lit("1m").alias("window"), F.lit("LARGE_TRADE").alias("event_type"), F.col("notional").cast("double").alias("delta"), "price", F.col("agg_id").cast("string").alias("notes"))
    sinks.append_csv(sinks.flow_event_rows(rows), path)
    return readers.flow_events(spark, path).select("symbol", "price", "delta", "notes")


@query("t9_t15_live_windows", f"""WITH {TRADES}, h AS (SELECT *, unnest(range(ms // 300000 - 1, ms // 300000 + 1)) * 300000 AS start_ms FROM trades)
SELECT symbol, start_ms, count(*) AS n, round(CAST(sum(signed) AS DOUBLE), 6) AS delta, round(CAST(coalesce(sum(notional) FILTER (WHERE side = 'BUY'), 0) AS DOUBLE) / CAST(sum(notional) AS DOUBLE), 6) AS buy_ratio FROM h GROUP BY ALL""")
def t9(spark, d):
    """Ten-minute windows every five minutes, by a stream over landed files of events that runs to its end."""
    at = shared_dir(spark)
    landed = src.table(spark, d, "events")
    landed.repartitionByRange("ts").write.parquet(f"{at}/landed")
    events = spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/landed")
    rows = live.live_windows(src.trades_from(events), "10 minutes", "5 minutes")
    save = lambda df, _: df.write.mode("overwrite").parquet(f"{at}/windows")
    rows.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/windows").select("symbol", F.unix_millis("start").alias("start_ms"), "n", r6("delta"), r6("buy_ratio"))
