"""Folds by blocks against the same folds over whole keys, and the book that they feed."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.operators import blocks, depth, folds

DIFF = "symbol string, pos long, u long, pu long"


def plain_verdicts(rows):
    """(pos, verdict, epoch) of one symbol's messages in order."""
    last, epoch, out = None, 0, []
    for _, pos, u, pu in rows:
        verdict = "OK" if last is None else "DUPLICATE" if u <= last else "OUT_OF_ORDER" if pu is not None and pu < last else "GAP" if pu is not None and pu > last else "OK"
        if verdict == "OK":
            last = u
        if verdict == "GAP":
            last, epoch = None, epoch + 1
        out.append((pos, verdict, epoch))
    return out


def messages(symbol, n, seed):
    r, u, out = random.Random(seed), 0, []
    for pos in range(n):
        kind = r.random()
        pu, u = u, u + r.randint(1, 5)
        out.append((symbol, pos, u - 9 if kind < 0.1 else u, pu - 3 if kind > 0.95 else pu + 2 if kind > 0.9 else None if kind > 0.8 else pu))
    return out


@pytest.mark.parametrize("width", [1, 7, 100, 10_000])
def test_verdicts_in_blocks(spark, width):
    rows = {s: messages(s, 300, k) for k, s in enumerate(("a", "b", None))}
    df = spark.createDataFrame([x for r in rows.values() for x in r], DIFF).repartition(5)
    got = sorted(((r.symbol, r.pos, r.verdict, r.epoch) for r in folds.sequence_verdicts(df, width=width).collect()), key=repr)
    assert got == sorted(((s, *x) for s, r in rows.items() for x in plain_verdicts(r)), key=repr)


def test_a_state_that_passes_many_blocks(spark):
    """Nothing is accepted for twenty blocks, so what each block assumes of the one before is wrong at first."""
    rows = [("a", 0, 1_000, None)] + [("a", p, p, None) for p in range(1, 200)] + [("a", 200, 2_000, 1_000), ("a", 201, 2_001, 1_999)]
    got = sorted((r.pos, r.verdict, r.epoch) for r in folds.sequence_verdicts(spark.createDataFrame(rows, DIFF), width=10).collect())
    assert got == plain_verdicts(rows)


def test_commits_in_blocks(spark):
    cfg = Config(signal_cooldown_ms=180_000, block_ms=240_000)
    r = random.Random(9)
    actions = ["WAITING", "CONFIRMED_LONG", "CONFIRMED_SHORT", "WATCH_LONG", "DATA_STALE", "WARMING_UP"]
    rows = [(s, t * 20_000, a, a.startswith("CONFIRMED"), a in ("DATA_STALE", "WARMING_UP")) for s in "ab" for t in range(400) for a in [r.choices(actions, [8, 1, 1, 2, 1, 1])[0]] if t % 90 > 20 or s == "a"]
    want = []
    for s in "ab":
        old, version, until = "WARMING_UP", 0, None
        for _, ms, asked, candidate, gated in (x for x in rows if x[0] == s):
            action = asked if gated or until is None or ms >= until else "COOLDOWN"
            version += action != old
            if action != old and candidate and action.startswith("CONFIRMED"):
                until = ms + cfg.signal_cooldown_ms
            want.append((s, ms, old, action, version, until))
            old = action
    df = spark.createDataFrame(rows, "symbol string, ms long, action string, candidate boolean, gated boolean").repartition(4)
    got = sorted((x.symbol, x.ms, x.old_action, x.committed, x.version, x.cooldown_until) for x in folds.commit_decisions(df, cfg).collect())
    assert got == sorted(want)


def test_registrations_and_caches_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(folds, "C", Config(block_ms=50_000))
    r = random.Random(2)
    times = sorted(r.sample(range(3_000_000), 200))
    signals = spark.createDataFrame([("a", t, i) for i, t in enumerate(times)], "symbol string, ms long, signal_id long")
    want, last = [], None
    for t in times:
        want.append(last is None or t - last >= 300_000)
        last = t if want[-1] else last
    assert [x.registered for x in folds.register_signals(signals).orderBy("ms").collect()] == want
    requests = [("a", t, i, r.choice("xy"), r.random() < 0.3) for i, t in enumerate(times)]
    want, at, held = [], None, None
    for _, t, _, h, ok in requests:
        source = "CACHE" if at is not None and t - at <= 60_000 and held == h else "CALL" if ok else "FAILED" if at is None else "FALLBACK"
        at, held = (t, h) if source == "CALL" else (at, held)
        want.append(source)
    df = spark.createDataFrame(requests, "scope string, ms long, request_id long, input_hash string, ok boolean")
    assert [x.source for x in folds.cached_interpretations(df).orderBy("ms").collect()] == want


@pytest.mark.parametrize("ahead", [False, True])
def test_neighbours_and_last_seen(spark, ahead):
    r = random.Random(1)
    rows = [(k, t) for k in "ab" for t in sorted(r.sample(range(500), 60))]
    df = spark.createDataFrame(rows, "k string, t long")
    got = {(x.k, x.t): x.n for x in blocks.neighbour(df, ["k"], ["t"], "t", 16, F.col("t"), "n", ahead).collect()}
    for k in "ab":
        ts = [t for key, t in rows if key == k]
        assert [got[k, t] for t in ts] == ([*ts[1:], None] if ahead else [None, *ts[:-1]])
    points = spark.createDataFrame([(k, t) for k in "abc" for t in range(0, 520, 13)], "k string, t long")
    for x in blocks.last_seen(points, df, ["k"], "t", F.col("t"), "seen", 16).collect():
        assert x.seen == max((t for k, t in rows if k == x.k and t <= x.t), default=None)


# --- the book at any time ---------------------------------------------------------------------

CHANGE = "symbol string, pos long, side string, price double, qty double"


def plain_books(messages, changes, ticks):
    """Levels at each tick, by walking through one symbol's messages."""
    verdicts = {pos: v for pos, v, _ in plain_verdicts(messages)}
    out = {}
    for tick in ticks:
        book = {}
        for _, pos, _, _ in messages:
            if pos <= tick:
                if verdicts[pos] == "GAP":
                    book = {}
                elif verdicts[pos] == "OK":
                    book |= {(side, price): qty for _, p, side, price, qty in changes if p == pos}
        out[tick] = {k: q for k, q in book.items() if q > 0}
    return out


@pytest.mark.parametrize("width", [5, 1_000])
def test_book_at_every_tick(spark, width):
    r = random.Random(4)
    rows = messages("a", 120, 3)
    sides = {"BID": [99.0, 99.5, 98.0], "ASK": [100.0, 100.5, 103.0]}
    changes = list({(p, s, x): ("a", p, s, x, float(r.choice([0, 1, 2, 5]))) for _, p, _, _ in rows for s in ["BID", "ASK"] for x in [r.choice(sides[s])] if r.random() < 0.8}.values())
    ticks = list(range(0, 130, 3))
    verdicts = folds.sequence_verdicts(spark.createDataFrame(rows, DIFF), width=width)
    lives = depth.level_lives(verdicts, spark.createDataFrame(changes, CHANGE), width)
    asked = spark.createDataFrame([("a", t) for t in ticks] + [("b", 5)], "symbol string, pos long")
    levels = depth.book_at(lives, asked, width)
    want = plain_books(rows, changes, ticks)
    got = {}
    for x in levels.collect():
        got.setdefault(x.pos, {})[x.side, x.price] = x.qty
    assert got == {t: b for t, b in want.items() if b}
    tops = {(x.symbol, x.pos): x for x in depth.top_of_book(levels, asked).collect()}
    assert len(tops) == len(ticks) + 1 and tops["b", 5].best_bid is None and tops["b", 5].imbalance == 0
    for t, b in want.items():
        bids, asks = [p for s, p in b if s == "BID"], [p for s, p in b if s == "ASK"]
        assert (tops["a", t].best_bid, tops["a", t].best_ask) == (max(bids, default=None), min(asks, default=None))
        value = {s: sum(p * q for (side, p), q in b.items() if side == s) for s in ("BID", "ASK")}
        total = sum(value.values())
        assert tops["a", t].imbalance == pytest.approx((value["BID"] - value["ASK"]) / total if total else 0)
        if bids and asks:
            assert tops["a", t].spread_bps == pytest.approx((min(asks) - max(bids)) / ((max(bids) + min(asks)) / 2) * 1e4)


def test_levels_are_replaced_deleted_and_cleared_by_a_gap(spark):
    rows = [("btc", 1, 101, 98), ("btc", 2, 103, 101), ("btc", 3, 105, 103), ("btc", 4, 106, 110), ("btc", 5, 107, 106)]
    changes = [
        ("btc", 1, "BID", 60000.0, 1.5), ("btc", 1, "BID", 59900.0, 2.0), ("btc", 1, "ASK", 60100.0, 0.8), ("btc", 1, "ASK", 60200.0, 1.2),
        ("btc", 2, "BID", 60000.0, 3.0), ("btc", 3, "BID", 59900.0, 0.0), ("btc", 3, "ASK", 60100.0, 0.0), ("btc", 5, "BID", 1.0, 1.0),
    ]
    lives = depth.level_lives(folds.sequence_verdicts(spark.createDataFrame(rows, DIFF)), spark.createDataFrame(changes, CHANGE))
    books = {}
    for x in depth.book_at(lives, spark.createDataFrame([("btc", p) for p in range(1, 6)], "symbol string, pos long")).collect():
        books.setdefault(x.pos, set()).add((x.side, x.price, x.qty))
    assert books[2] == {("BID", 60000.0, 3.0), ("BID", 59900.0, 2.0), ("ASK", 60100.0, 0.8), ("ASK", 60200.0, 1.2)}
    assert books[3] == {("BID", 60000.0, 3.0), ("ASK", 60200.0, 1.2)}
    assert 4 not in books and books[5] == {("BID", 1.0, 1.0)}
