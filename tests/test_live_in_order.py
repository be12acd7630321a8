"""Streams that take rows in order, on a state store in memory that counts its calls."""

from __future__ import annotations

import json
import random

import pandas as pd

from tidemark.functions import bookstate
from tidemark.streaming import live


class Store:
    """Stands for one key's handle, its maps, values and lists, and its timers."""

    def __init__(self):
        self.calls, self.timers, self.all = 0, set(), {}

    def getMapState(self, name, *schemas):
        return self.all.setdefault(name, Held(self))

    getValueState = getListState = getMapState

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)


class Held:
    def __init__(self, store):
        self.store, self.rows, self.one = store, {}, None

    def _called(self, out=None):
        self.store.calls += 1
        return out

    exists = lambda self: self._called(bool(self.rows) or self.one is not None)
    iterator = lambda self: self._called(iter(list(self.rows.items())))
    keys = lambda self: self._called(iter(list(self.rows)))
    getValue = lambda self, k: self._called(self.rows[k])
    updateValue = lambda self, k, v: self._called(self.rows.update({tuple(k): tuple(v)}))
    removeKey = lambda self, k: self._called(self.rows.pop(tuple(k), None))
    get = lambda self: self._called(self.one)
    clear = lambda self: self._called(setattr(self, "one", None))
    update = put = lambda self, v: self._called(setattr(self, "one", v))


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def played(processor, batches):
    """Output rows of each batch of (rows, watermark after it), and how many calls the store has had."""
    store, out = Store(), []
    processor.init(store)
    for rows, ms in batches:
        parts = [pd.DataFrame(rows[i : i + 100], columns=["ms", "seq", "body"]) for i in range(0, len(rows), 100)]
        given = list(processor.handleInputRows(("a",), iter(parts), Watermark(ms)))
        for timer in sorted(t for t in store.timers if t <= ms):
            store.timers.discard(timer)
            given += list(processor.handleExpiredTimer(("a",), Watermark(ms), None))
        out.append([tuple(x) for part in given for x in part.itertuples(index=False)])
    return out, store.calls


def trades(n, seed, span=600_000):
    r = random.Random(seed)
    return [(r.randint(0, span) // 50 * 50, i, json.dumps({"side": r.choice(["BUY", "SELL"]), "micros": r.randint(1, 10**9)})) for i in range(n)]


def sums_of(rows, windows):
    all_ = [(ms, seq, json.loads(b)) for ms, seq, b in rows]
    first, out = min(x[0] for x in all_), []
    for ms, seq, _ in all_:
        held = [[x for t, _, x in all_ if ms - w <= t <= ms] for w in windows.values()]
        out.append(("a", ms, seq, first, *[v for h in held for v in (sum(x["micros"] for x in h if x["side"] == "BUY"), sum(x["micros"] for x in h if x["side"] == "SELL"), len(h))]))
    return sorted(out)


def test_live_windows_call_the_store_for_chunks_of_rows():
    rows, windows = trades(3_000, 1), {"1m": 60_000, "5m": 300_000, "15m": 900_000}
    out, calls = played(live.LiveFlow(windows), [(rows[:1_500], -1), (rows[1_500:], -1), ([], 10_000_000)])
    assert sorted(out[2]) == sums_of(rows, windows) and not out[0] and not out[1]
    assert calls < 300


def test_live_windows_follow_a_watermark_that_moves_in_steps():
    rows, windows, late = sorted(trades(900, 2)), {"short": 7_000, "long": 90_000}, 20_000
    r, processor, batches, at, taken = random.Random(3), live.LiveFlow(windows), [], 0, -1
    processor.chunk_rows = 7  # so that chunks of a minute are many
    coming = sorted(rows, key=lambda x: x[0] + r.randint(0, late))
    while at < len(coming):
        n = r.randint(1, 60)
        part = coming[at : at + n]
        at += n
        batches.append((part, taken := max(taken, max(x[0] for x in coming[:at]) - late)))
    batches.append(([], 10_000_000))
    out, _ = played(processor, batches)
    given = [x for part in out for x in part]
    assert sorted(given) == sums_of(rows, windows) and [x[1] for x in given] == sorted(x[1] for x in given)
    assert all(x[1] <= ms for part, (_, ms) in zip(out, batches, strict=True) for x in part)
    assert sum(bool(part) for part in out) > 10


def test_of_rows_that_come_twice_the_last_counts():
    body = lambda micros: json.dumps({"side": "BUY", "micros": micros})
    out, _ = played(live.LiveFlow({"w": 100}), [([(10, 1, body(5)), (1_900, 2, body(1))], -1), ([(10, 1, body(7))], -1), ([], 1_000), ([(1_900, 2, body(3))], 1_100), ([], 5_000)])
    assert [part for part in out if part] == [[("a", 10, 1, 10, 7, 0, 1)], [("a", 1_900, 2, 10, 3, 0, 1)]]


def test_live_bursts_call_the_store_for_chunks_of_rows():
    rows, windows = trades(2_000, 5, 900_000), {"recent": 10_000, "back": 300_000}
    out, calls = played(live.LiveFlow(windows), [(rows[i : i + 500], -1) for i in range(0, 2_000, 500)] + [([], 10_000_000)])
    assert sorted(out[-1]) == sums_of(rows, windows)
    assert calls < 300


def test_a_live_book_calls_the_store_for_chunks_of_messages():
    r, last, rows = random.Random(7), 0, []
    for i in range(4_000):
        level = {"side": r.choice(["BID", "ASK"]), "price": float(r.randint(95, 105)), "qty": float(r.randint(0, 2))}
        if i % 200 == 10:
            rows.append((i * 100, 0, json.dumps({"kind": "snapshot", "u": last, "levels": [level]})))
            continue
        pu, last = last, last + r.randint(1, 3)
        rows.append((i * 100, 0, json.dumps({"kind": "difference", "first_u": pu + 1, "u": last, "pu": pu + 4 if r.random() < 0.02 else pu, "levels": [level]})))
    s, want = bookstate.new_book(), []
    for ms, seq, body in rows:
        x = json.loads(body)
        want.append(("a", ms, seq, *bookstate.on_message(s, x["kind"], x.get("first_u"), x["u"], x.get("pu"), [(v["side"], v["price"], v["qty"]) for v in x["levels"]])))
    coming = rows[:]
    r.shuffle(coming)
    whole, calls = played(live.LiveBook(), [(coming, -1), ([], 10_000_000)])
    assert list(map(str, (x[:5] + x[7:] for x in whole[1]))) == list(map(str, (x[:5] + x[7:] for x in want)))
    assert calls < 300
    steps = [(rows[i : i + 150], rows[min(i + 149, len(rows) - 1)][0] - 3_000) for i in range(0, len(rows), 150)]
    given = [x for part in played(live.LiveBook(), [*steps, ([], 10_000_000)])[0] for x in part]
    assert [x[:5] + x[7:] for x in given] == [x[:5] + x[7:] for x in whole[1]]
