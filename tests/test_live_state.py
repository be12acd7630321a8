"""Streams with state against their batch forms on shuffled files; a followed file that grows, is cut off and is read on."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import bookstate
from tidemark.operators import blocks, book, folds
from tidemark.plans.replay_queries import _state_store
from tidemark.sources import readers
from tidemark.sources.tail import lines_in, tail, whole_lines
from tidemark.streaming import live

MESSAGE = "symbol string, ms long, seq long, kind string, first_u long, u long, pu long, levels array<struct<side:string,price:double,qty:double>>"


def landed(spark, path, df, closing):
    """Files in an order that has nothing to do with time, one row a file; the closing row comes last."""
    df = df.cache()
    df.orderBy(F.xxhash64("ms", "seq" if "seq" in df.columns else "agg_id")).repartition(5).write.parquet(f"{path}/in")
    spark.createDataFrame([closing], df.schema).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def drained(spark, rows, path, name="out"):
    with _state_store(spark):
        rows.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/{name}")


# --- the book --------------------------------------------------------------------------------


def diff(first, u, pu, *levels):
    return bookstate.on_difference, (first, u, pu, list(levels))


def snap(last, *levels):
    return bookstate.on_snapshot, (last, list(levels))


def play(*steps):
    s = bookstate.new_book()
    return s, [f(s, *args) for f, args in steps]


WHOLE = [("BID", 60000.0, 1.5), ("BID", 59900.0, 2.0), ("ASK", 60100.0, 0.8), ("ASK", 60200.0, 1.2)]


def test_levels_are_replaced_and_deleted():
    s, _ = play(diff(99, 101, 98), snap(100, *WHOLE), diff(102, 103, 101, ("BID", 60000.0, 3.0)), diff(104, 105, 103, ("BID", 59900.0, 0.0), ("ASK", 60100.0, 0.0)))
    assert s["state"] == "HEALTHY" and s["book"] == {("BID", 60000.0): 3.0, ("ASK", 60200.0): 1.2}


def test_a_gap_clears_the_book_until_the_next_snapshot():
    s, said = play(diff(99, 101, 98), snap(100, *WHOLE), diff(105, 106, 103), diff(107, 108, 106, ("BID", 1.0, 1.0)))
    assert said == ["BUFFERED", "SNAPSHOT", "GAP", "BUFFERED"] and s["state"] == "RESYNCING" and not s["book"]
    bookstate.on_snapshot(s, 107, WHOLE)
    assert s["state"] == "HEALTHY" and s["book"]["BID", 1.0] == 1.0 and s["last"] == 108 and not s["buffer"]


def test_a_snapshot_that_the_buffer_does_not_reach_is_given_up():
    s, _ = play(diff(200, 210, 199), snap(100, *WHOLE))
    assert s["state"] == "SYNCING" and s["last"] == 0 and not s["buffer"]
    s, _ = play(snap(100, *WHOLE), diff(90, 95, 89), diff(98, 102, 97, ("ASK", 60100.0, 0.0)))
    assert s["state"] == "HEALTHY" and ("ASK", 60100.0) not in s["book"]


def test_messages_of_a_healthy_book_and_the_bounded_buffer():
    _, said = play(snap(10), diff(10, 11, 9), diff(9, 11, 8), diff(14, 15, 9), diff(12, 13, 11), diff(20, 21, 19))
    assert said == ["SNAPSHOT", "OK", "DUPLICATE", "OUT_OF_ORDER", "OK", "GAP"]
    s = bookstate.new_book()
    for u in range(1, bookstate.BUFFER + 50):
        bookstate.on_difference(s, u, u, u - 1, [])
    assert len(s["buffer"]) == bookstate.BUFFER and s["buffer"][0][1] == 50


def made_messages(seed):
    r, out = random.Random(seed), []
    for symbol in "ab":
        last = 100
        for i in range(120):
            levels = [(r.choice(["BID", "ASK"]), float(r.randint(95, 105)), float(r.choice([0, 1, 2]))) for _ in range(r.randint(0, 3))]
            if i % 25 == 10:
                out.append((symbol, 1_000 + i * 100, 0, "snapshot", None, last - r.randint(0, 2), None, [("BID", 99.0, 1.0), ("ASK", 101.0, 1.0)]))
                continue
            kind, pu, last = r.random(), last, last + r.randint(1, 3)
            out.append((symbol, 1_000 + i * 100, 0, "difference", pu + 1, last, pu - 5 if kind < 0.03 else pu + 4 if kind < 0.06 else pu, levels))
    return out


def test_live_book_equals_the_fold_on_shuffled_files(spark, tmp_path):
    df = spark.createDataFrame(made_messages(3), MESSAGE)
    stream = landed(spark, tmp_path, df, ("a", 10_000_000, 0, "difference", 1, 1, 0, []))
    got = sorted(tuple(r) for r in drained(spark, live.live_synced_books(stream, "60 seconds"), tmp_path).collect())
    cols = ["symbol", "ms", "seq", "verdict", "state", "best_bid", "best_ask", "n_levels"]
    want = sorted(tuple(r) for r in folds.synced_books(df).select(*cols).collect())
    assert list(map(repr, got)) == list(map(repr, want))
    assert {"OK", "BUFFERED", "SNAPSHOT", "GAP"} <= {r[3] for r in got} and {"HEALTHY", "RESYNCING", "SYNCING"} <= {r[4] for r in got}


# --- windows and walls -----------------------------------------------------------------------


def test_live_windows_are_those_of_the_batch_row_by_row(spark, tmp_path):
    r = random.Random(8)
    rows = [("a" if i % 3 else "b", i, 1_000 * r.randint(0, 400), r.choice(["BUY", "SELL"]), r.randint(1, 10**9)) for i in range(300)]
    df = spark.createDataFrame(rows, "symbol string, agg_id long, ms long, side string, m long").withColumn("notional", (F.col("m").cast("decimal(38,6)") / 1_000_000).cast("decimal(28,6)")).drop("m")
    windows = {"short": 20_000, "long": 90_000}
    stream = landed(spark, tmp_path, df, ("a", 9_999, 10_000_000, "BUY", None))
    got = drained(spark, live.live_trailing(stream, windows, "500 seconds"), tmp_path)
    values = {"buy": F.when(F.col("side") == "BUY", F.col("notional")).otherwise(F.lit(0).cast("decimal(28,6)")), "n": F.lit(1).cast("long")}
    want = blocks.trailing_sums(df, ["symbol"], "ms", values, windows, 50_000)
    cols = ["symbol", "agg_id", "ms", *[f"{c}_{w}" for w in windows for c in ("buy", "n")]]
    plain = lambda d: sorted((*x[:3], *(float(v) for v in x[3:])) for x in map(tuple, d.select(*cols).collect()))
    assert plain(got) == plain(want)
    firsts = {s: min(x[2] for x in rows if x[0] == s) for s in "ab"}
    assert {(x.symbol, x.first_ms) for x in got.collect()} == set(firsts.items())


def test_nearest_levels(spark):
    r = random.Random(6)
    levels = [("a", t, side, p, float(r.randint(1, 9))) for t in (0, 100, 250) for side, ps in (("BID", [99.0, 98.5, 97.0]), ("ASK", [99.5, 100.0, 103.0])) for p in ps if r.random() < 0.8]
    points = [("a", r.randint(-50, 400), r.choice([98.75, 99.25, 96.0, 101.5, 110.0, 99.0, 98.0]), i) for i in range(80)] + [("a", 50, 99.25, 98), ("z", 5, 1.0, 99)]
    df = spark.createDataFrame(levels, "symbol string, snap_ms long, side string, price double, qty double")
    got = {x.i: (x.near_ms, x.near_side, x.near_price, x.near_qty) for x in book.nearest_levels(spark.createDataFrame(points, "symbol string, ms long, price double, i long"), df, 60).collect()}
    times = sorted({x[1] for x in levels})
    for _, ms, price, i in points[:-1]:
        near = min(times, key=lambda t: (abs(t - ms), t))  # noqa: B023
        best = min((x for x in levels if x[1] == near), key=lambda x: (abs(x[3] - price), x[2] != "BID", -x[3] if x[2] == "BID" else x[3]))  # noqa: B023
        assert got[i] == (near, *best[2:])
    assert got[99] == (None, None, None, None)


# --- a growing file --------------------------------------------------------------------------


def line(i, wide=True):
    head = f"2024-01-01T00:00:{i % 60:02d}Z,BTCUSDT,BULLISH,{100 + i}"
    return f"{head},a,b,c,RAW_SWEEP,d,e,f,g,h,id{i},live\n" if wide else f"{head},id{i}\n"


def test_ranges_hold_each_line_once(tmp_path):
    path = str(tmp_path / "log")
    rows = [f"{'x' * (i % 13)}é{i}" for i in range(200)]
    with open(path, "w") as f:
        f.write("\n".join(rows) + "\nunfinished")
    end = whole_lines(path)
    assert end == os.path.getsize(path) - len("unfinished")
    for size in (1, 7, 100, 10_000):
        got = [x for a in range(0, end, size) for x in lines_in(path, a, min(a + size, end), 0)]
        assert [v for _, v in got] == rows and [a for a, _ in got] == sorted({a for a, _ in got})
    assert whole_lines(str(tmp_path / "none")) == 0


def test_tail_appends_restarts_and_starts_over(spark, tmp_path):
    path, at = str(tmp_path / "sweeps.csv"), str(tmp_path / "q")

    def poll():
        drained(spark, readers.parse_sweeps(tail(spark, path, 64)), at)
        return sorted(r.sweep_id for r in spark.read.parquet(f"{at}/out").collect())

    with open(path, "w") as f:
        f.write("timestamp,symbol,direction,level,id\n" + "".join(line(i, i % 2 == 0) for i in range(10)) + line(10)[:20])
    assert poll() == sorted(f"id{i}" for i in range(10))
    with open(path, "a") as f:  # the rest of the cut line, and more
        f.write(line(10)[20:] + line(11))
    assert poll() == sorted(f"id{i}" for i in range(12))  # from the checkpoint, nothing twice
    assert poll() == sorted(f"id{i}" for i in range(12))
    with open(path, "w") as f:  # begun anew
        f.write(line(20) + line(21))
    assert poll() == sorted([f"id{i}" for i in range(12)] + ["id20", "id21"])
    with open(path, "a") as f:
        f.write("2024-01-01T00:00:00Z,ETHUSDT,BEARISH,5\n")
    assert "swp_2024-01-01T00:00:00Z_ETHUSDT_BEARISH_5" in poll()


def test_recorded_books_come_back(spark, tmp_path):
    from tidemark.operators import replay
    from tidemark.sources import sinks

    r = random.Random(1)
    levels = [("a", t * 500, side, f"{100 + s * k / 10:.2f}", f"{r.randint(1, 3)}.00") for t in range(12) for side, s in (("BID", -1), ("ASK", 1)) for k in range(1, 6) if r.random() < 0.7]
    df = spark.createDataFrame(levels, "symbol string, snap_ms long, side string, price string, qty string").select("symbol", "snap_ms", "side", F.col("price").cast("decimal(10,2)").alias("price"), F.col("qty").cast("decimal(18,2)").alias("qty"))
    trades = spark.createDataFrame([("a", 1, 700, 60000.0, 2.0, "SELL")], "symbol string, agg_id long, ms long, price double, quantity double, side string")
    path = str(tmp_path / "rec")
    sinks.write_recording(replay.recorded(trades, replay.depth_messages(df)), path)
    rows = readers.recordings(spark, path + "/*/*")
    back = replay.replayed_levels(readers.depth_of(rows), 3_000_000)
    assert sorted(map(str, back.select("symbol", "snap_ms", "side", "price", "qty").collect())) == sorted(map(str, df.collect()))
    t = readers.trades_of(rows).first()
    assert (t.symbol, t.price, t.quantity, t.side, t.agg_id) == ("a", 60000.0, 2.0, "SELL", 1)
    assert json.loads(rows.where("stream like '%depth'").orderBy("receive_time").first().data)["pu"] == 0


def test_counters_of_a_running_stream(spark, tmp_path):
    from tidemark.operators import health

    rows = [("a", "OK", 0), ("a", "GAP", 1), ("a", "OK", 1), ("b", "DUPLICATE", 0), ("z", "OK", 0)]
    df = spark.createDataFrame(rows, "symbol string, verdict string, epoch long")
    for i in range(3):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    listener = health.HealthListener("depth")
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        watched = stream.observe("depth", *health.counters(["a", "b", "c"], F.length("verdict")))
        watched.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if listener.totals.get("a", {}).get("messages") == 9:
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert listener.totals == {
        "a": {"messages": 9, "gaps": 3, "duplicates": 0, "out_of_order": 0, "resyncs": 1, "latency": 3},
        "b": {"messages": 3, "gaps": 0, "duplicates": 3, "out_of_order": 0, "resyncs": 0, "latency": 9},
    }
