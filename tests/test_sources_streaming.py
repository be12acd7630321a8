"""Recordings, sweeps, logs and streams."""

from __future__ import annotations

import gzip
import json

from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.operators import folds, trades
from tidemark.sources import adapters, readers, sinks
from tidemark.streaming import live


def write_recording(path, rows):
    with gzip.open(path, "wt") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")


def test_recording_round_trip(spark, tmp_path):
    raw = {"e": "aggTrade", "E": 1, "s": "BTCUSDT", "a": 7, "p": "60000.5", "q": "0.1", "T": 1_700_000_000_000, "m": True}
    parsed = {"price": 60001.0, "quantity": 0.2, "side": "BUY", "timestamp": 1_700_000_001.5}
    diff = {"e": "depthUpdate", "E": 1_700_000_000_100, "U": 99, "u": 101, "pu": 98, "b": [["60000", "2.0"], ["59900", "0"]], "a": [["60100", "1"]]}
    rows = [
        {"stream": "btcusdt@aggTrade", "data": raw, "receive_time": 1.0, "exchange_time": 1.0}, {"stream": "btcusdt@aggTrade", "data": parsed, "receive_time": 2.0, "exchange_time": 1.0},
        {"stream": "btcusdt@aggTrade", "data": {"p": "x"}, "receive_time": 3.0, "exchange_time": 1.0}, {"stream": "btcusdt@depth@100ms", "data": diff, "receive_time": 4.0, "exchange_time": 1.0},
    ]
    write_recording(tmp_path / "recording_btcusdt_2023-11-14.jsonl.gz", rows)
    (tmp_path / "recording_btcusdt_2023-11-15.jsonl").write_text("broken\n")
    rec = readers.recordings(spark, str(tmp_path))
    got = sorted(readers.trades_of(rec).collect(), key=lambda r: r.ms)
    assert [(r.symbol, r.ms, r.price, r.side, r.agg_id, float(r.notional)) for r in got] == [("btcusdt", 1_700_000_000_000, 60000.5, "SELL", 7, 6000.05), ("btcusdt", 1_700_000_001_500, 60001.0, "BUY", 0, 12000.2)]
    changes = {(r.side, r.price): (r.qty, r.u) for r in readers.level_changes(readers.depth_of(rec)).collect()}
    assert changes == {("BID", 60000.0): (2.0, 101), ("BID", 59900.0): (0.0, 101), ("ASK", 60100.0): (1.0, 101)}
    out = str(tmp_path / "again")
    sinks.write_recording(rec.where("receive_time < 3"), out)
    assert readers.trades_of(readers.recordings(spark, out + "/*/*")).count() == 2


def test_sweeps_of_both_widths(spark, tmp_path):
    wide = "2024-01-01T00:00:00Z,ETHUSDT,bearish,2000.5,a,b,c,RAW_SWEEP,d,e,f,g,h,id2,live"
    (tmp_path / "s.csv").write_text("timestamp,symbol,type,sweep_level,sweep_id\n2024-01-01T00:00:00.123456+00:00,BTCUSDT,BULLISH,42000,id1\n" + wide + "\n" + wide + "\nbad,row\nnotime,A,B,1,id9\n")
    got = sorted((r.sweep_id, r.symbol, r.direction, r.level, r.state, r.source) for r in readers.sweeps(spark, str(tmp_path)).collect())
    assert got == [("id1", "btcusdt", "BULLISH", 42000.0, None, None)] + [("id2", "ethusdt", "BEARISH", 2000.5, "RAW_SWEEP", "live")] * 2
    rows = readers.sweeps(spark, str(tmp_path))
    assert readers.sweeps_to_replay(rows, F.lit("2024-01-01 11:00:00").cast("timestamp")).count() == 1
    assert readers.sweeps_to_replay(rows, F.lit("2024-01-01 13:00:00").cast("timestamp")).count() == 0
    assert readers.mock_sweeps(spark, ["a", "b"], 5).count() == 5


def test_event_log_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01T00:00:00Z", "btc", "1m", "BUY_AGGRESSION", 1.23456, None, 7)], "timestamp string, symbol string, window string, event_type string, delta double, buy_ratio double, confluence_score int")
    text = sinks.flow_event_rows(rows)
    assert len(text.columns) == 18 and text.first().delta == "1.2346" and text.first().buy_ratio == ""
    sinks.append_csv(text, str(tmp_path / "log"))
    r = readers.flow_events(spark, str(tmp_path / "log")).first()
    assert (r.symbol, r.delta, r.buy_ratio, r.confluence_score) == ("btc", 1.2346, None, 7)
    more = sinks.migrate(rows, rows.drop("window").withColumn("new", F.lit(1)))
    assert more.count() == 2 and more.columns[-1] == "new"
    audit = sinks.audit_rows(spark.createDataFrame([(["a"],)], "w array<string>"))
    assert audit.first().w == '["a"]'
    assert json.loads(sinks.as_json(spark.createDataFrame([(1, None)], "a int, b string")).first().value) == {"a": 1, "b": None}
    assert [r.id for r in readers.csv_tail(spark.range(10), "id", 2).collect()] == [9, 8]


def drain(query, name, spark):
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_live_windows_equal_batch_groups(spark, sf_dir, tmp_path):
    t = adapters.trades(spark, sf_dir)
    t.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    q = live.live_windows(stream, "10 minutes", "5 minutes").writeStream.format("memory").queryName("live_w").outputMode("complete").start()
    got = {(r.symbol, r.start, r.n, round(r.delta, 6)) for r in drain(q, "live_w", spark).collect()}
    want = {(r.symbol, r.start, r.n, round(r.delta, 6)) for r in live.live_windows(t, "10 minutes", "5 minutes").collect()}
    assert got == want and len(got) > 50
    assert live.live_sessions(t).agg(F.sum("n")).first()[0] == t.count() == trades.bars(t, 600_000).agg(F.sum("n")).first()[0]


def test_live_cooldown_equals_batch_fold(spark, sf_dir, tmp_path):
    cfg = Config(cooldown_ms=600_000, cooldown_move=5.0)
    a = adapters.alerts(spark, sf_dir)
    a.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(a.schema).parquet(str(tmp_path / "in"))
    q = live.live_cooldown(stream, cfg, "1 minute").writeStream.format("memory").queryName("live_c").outputMode("append").start()
    got = {r.alert_id for r in drain(q, "live_c", spark).collect()}
    want = {r.alert_id for r in folds.event_cooldown(a, cfg).where("accepted").collect()}
    assert got == want and 0 < len(got) < a.count()


def test_live_sweeps_and_book(spark, tmp_path):
    s = readers.mock_sweeps(spark, ["a"], 6)
    s.unionByName(s).write.parquet(str(tmp_path / "in"))
    q = live.new_sweeps(spark.readStream.schema(s.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("live_s").outputMode("append").start()
    assert drain(q, "live_s", spark).count() == 6
    d = spark.createDataFrame([("a", 0, 1, "BID", 10.0, 2.0), ("a", 0, 2, "BID", 10.0, 0.0)], "symbol string, epoch long, u long, side string, price double, qty double")
    assert live.live_book(d).first().qty == 0.0
