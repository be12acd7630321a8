"""Book metrics, walls and detectors on small books."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions import labels
from tidemark.operators import book, depth


def levels(spark, rows):
    """Rows (snap_ms, side, price, qty)."""
    df = spark.createDataFrame([("btc", t, s, float(p), float(q)) for t, s, p, q in rows], "symbol string, snap_ms long, side string, p double, q double")
    return df.select("symbol", "snap_ms", "side", F.col("p").cast("decimal(10,2)").alias("price"), F.col("q").cast("decimal(18,2)").alias("qty")).withColumn("notional", (F.col("price") * F.col("qty")).cast("decimal(28,6)"))


def test_metrics(spark):
    r = book.book_metrics(levels(spark, [(1, "BID", 99.99, 2), (1, "BID", 99.0, 1), (1, "ASK", 100.01, 1), (1, "ASK", 101.0, 3)])).first()
    assert (r.best_bid, r.best_ask, r.mid) == (99.99, 100.01, 100.0)
    assert abs(r.spread_bps - 2.0) < 1e-9 and abs(r.microprice - (99.99 * 1 + 100.01 * 2) / 3) < 1e-9
    assert abs(r.imbalance_0_5 - (199.98 - 100.01) / (199.98 + 100.01)) < 1e-9 and r.imbalance_5_15 == 0.0
    assert book.book_metrics(levels(spark, [(1, "BID", 99.0, 2)])).count() == 0


def test_walls_at_threshold(spark):
    rows = levels(spark, [(1, "BID", 60000, 1), (1, "BID", 59900, 0.5), (1, "ASK", 60100, 1), (1, "ASK", 60200, 0.8)])
    assert book.wall_levels(rows, Config(wall_least=10_000.0, wall_multiple=0.1)).count() == 4
    assert book.wall_levels(rows, Config(wall_least=50_000.0, wall_multiple=0.1)).count() == 2 + 0


def test_stacking(spark):
    old = [(1000, "BID", 60000, 1.0), (1000, "ASK", 60100, 1.0)]
    new = [(6000, "BID", 60000, 2.5), (6000, "ASK", 60100, 0.2)]
    got = {r.snap_ms: r for r in book.stacking(levels(spark, old + new), 5_000, 20_000).collect()}
    assert (got[6000].bids_added, got[6000].asks_pulled, got[6000].net_shift) == (90000.0, 48080.0, 138080.0)
    assert got[1000].net_shift == 0.0


def test_wall_life(spark):
    sizes = {1000: 10, 2000: 1, 3000: 9, 5000: 8}
    rows = [(t, "BID", 100.0, q) for t, q in sizes.items()] + [(t, "ASK", 101.0, 0.01) for t in (1000, 2000, 3000, 4000, 5000)]
    got = sorted(book.walls(levels(spark, rows), Config(wall_least=100.0, wall_multiple=0.0)).where("side = 'BID'").collect(), key=lambda r: r.first_ms)
    first, second = got
    assert (first.first_ms, first.gone_ms, first.life_ms, first.updates, first.refills, first.standing) == (1000, 4000, 3000, 3, 1, False)
    assert (first.most, first.current, first.added, first.removed) == (1000.0, 900.0, 800.0, 900.0)
    assert second.standing and second.updates == 1


def test_vacuum_iceberg_spoof(spark):
    rows = levels(spark, [(1, "BID", 60000, 0.1), (1, "ASK", 60100, 1.0)])
    r = book.vacuum(rows, Config(vacuum_share=2.0)).first()
    assert r.down and not r.up or r.down  # the bid is thin
    trades = spark.createDataFrame([("btc", 60000.0, 1.0)] * 5, "symbol string, price double, quantity double").withColumn("notional", (F.col("price") * 1).cast("decimal(28,6)"))
    thin, thick = levels(spark, [(1, "BID", 60000, 1)]), levels(spark, [(1, "BID", 60000, 5)])
    cfg = Config(iceberg_multiple=2.0)
    assert book.icebergs(trades, thin, 1.0, cfg).first().iceberg and not book.icebergs(trades, thick, 1.0, cfg).first().iceberg
    hit = spark.range(1).select(labels.spoof(F.lit(20_000.0), F.lit(100.0), F.lit(3_000), Config(spoof_pulled=10_000.0, spoof_ms=5_000))).first()[0]
    assert hit


def test_snapshot_sync(spark):
    snaps = spark.createDataFrame([("a", 100), ("b", 100), ("c", 100), ("d", 100)], "symbol string, last_id long")
    diffs = spark.createDataFrame([("a", 99, 101), ("a", 102, 103), ("b", 105, 109), ("c", 90, 100), ("d", 101, 5_000_000)], "symbol string, first_u long, u long")
    got = {r.symbol: (r.state, r.first_u) for r in depth.sync_start(snaps, diffs).collect()}
    assert got == {"a": ("HEALTHY", 99), "b": ("GAP", 105), "c": ("SYNCING", None), "d": ("HEALTHY", 101)}


def test_book_from_changes(spark):
    rows = [("a", 0, 101, "BID", 60000.0, 2.0), ("a", 0, 102, "BID", 60000.0, 3.0), ("a", 0, 104, "BID", 59900.0, 0.0), ("a", 0, 101, "BID", 59900.0, 1.0)]
    got = depth.book_at_end(spark.createDataFrame(rows, "symbol string, epoch long, u long, side string, price double, qty double")).collect()
    assert [(r.price, r.qty) for r in got] == [(60000.0, 3.0)]


def test_rest_imbalance(spark):
    df = spark.createDataFrame([([["100", "2"]], [["101", "1"]]), ([], [])], "b array<array<string>>, a array<array<string>>")
    got = [r[0] for r in df.select(book.rest_imbalance(F.col("b"), F.col("a"))).collect()]
    assert abs(got[0] - 99 / 301) < 1e-12 and got[1] is None
