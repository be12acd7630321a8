"""Live forms of the operators on Structured Streaming.

Trades and depth come as streams of landing files (or any other streaming
source with the same columns). Results of closed windows equal those of the
batch operators on the same rows; late rows are dropped by the watermark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidemark.config import Config
from tidemark.functions import bookstate
from tidemark.operators.trades import volumes

C = Config()


def timed(trades: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Trades with ``event_time`` and its watermark."""
    return trades.withColumn("event_time", F.timestamp_millis("ms")).withWatermark("event_time", late)


def live_windows(trades: DataFrame, length: str = "5 minutes", slide: str = "1 minute", late: str = "10 seconds") -> DataFrame:
    """Hopping windows per symbol: delta, buy ratio, count."""
    v = volumes()
    rows = timed(trades, late).groupBy("symbol", F.window("event_time", length, slide)).agg(F.sum(v["buy"]).alias("buy"), F.sum(v["sell"]).alias("sell"), F.count("*").alias("n"))
    total = F.col("buy") + F.col("sell")
    return rows.select("symbol", F.col("window.start").alias("start"), F.col("window.end").alias("end"), (F.col("buy") - F.col("sell")).cast("double").alias("delta"), F.when(total != 0, F.col("buy").cast("double") / total.cast("double")).otherwise(0.5).alias("buy_ratio"), "n")


def live_sessions(trades: DataFrame, gap: str = "5 minutes", late: str = "10 seconds") -> DataFrame:
    """Sessions of activity per symbol (an extension)."""
    rows = timed(trades, late).groupBy("symbol", F.session_window("event_time", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("notional").cast("double").alias("notional"))
    return rows.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "notional")


def new_sweeps(sweeps: DataFrame, keep: str = "12 hours") -> DataFrame:
    """Each sweep id once within ``keep``; state older than that is dropped."""
    return sweeps.withWatermark("time", keep).dropDuplicatesWithinWatermark(["sweep_id"])


def live_cooldown(events: DataFrame, cfg: Config = C, late: str = "10 seconds") -> DataFrame:
    """Accepted events (symbol, ms, type, window, price): the batch fold with one small state for each key.

    Rows of a micro-batch are taken in time order; state is dropped once a
    whole cooldown has passed without an event.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, price = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(["ms", "alert_id"])
        keep = []
        for ms, p in zip(rows["ms"].tolist(), rows["price"].tolist(), strict=True):
            moved = price is not None and price > 0 and p > 0 and abs(p - price) / price >= cfg.cooldown_move
            ok = last is None or ms - last >= cfg.cooldown_ms or moved
            if ok:
                last, price = ms, p
            keep.append(ok)
        state.update((last, price))
        state.setTimeoutTimestamp(max(int(rows["ms"].max()), state.getCurrentWatermarkMs()) + cfg.cooldown_ms + 1)
        out = rows[keep]
        yield out[["symbol", "type", "window", "alert_id", "ms", "price"]]

    rows = events.withColumn("event_time", F.timestamp_millis("ms")).withWatermark("event_time", late)
    return rows.groupBy("symbol", "type", "window").applyInPandasWithState(
        step, "symbol string, type string, window string, alert_id long, ms long, price double", "ms long, price double", "append", GroupStateTimeout.EventTimeTimeout)


def live_book(depth: DataFrame) -> DataFrame:
    """The book as a stream of last sizes for each price (complete mode): input (symbol, epoch, u, side, price, qty).

    Only the highest epoch of a symbol counts for readers; sizes of 0 are levels that are gone.
    """
    return depth.groupBy("symbol", "epoch", "side", "price").agg(F.max_by("qty", "u").alias("qty"), F.max("u").alias("u"))


class InOrder(StatefulProcessor):
    """Holds a key's rows (``ms``, ``seq``, and ``body`` as JSON) until the watermark has passed them, then takes them in order.

    Rows may come in any order within the watermark; each is taken once. Rows
    that come after it are dropped by the stream. Rows wait in chunks of a
    minute's rows, by the time of a chunk's first row, so that a call to the
    state store moves many; only the chunks that are due are read. One timer
    stands at a time, for the earliest row.

    When rows are due, ``load()`` reads what the key has stored besides,
    ``take(state, rows)`` gets it with a minute's due rows as (ms, seq, body),
    in order, and gives output rows, and ``save(state)`` stores it again.
    """

    columns: list[str]
    grid_ms = 1_000
    minute_ms = 60_000
    #: Rows of a chunk, and of what is given out at once; rows that are held before they go to the state store.
    chunk_rows, held_rows = 5_000, 50_000

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first_ms long, part long", "rows string")
        self.standing_timer = handle.getValueState("standing_timer", "parts long, timer long")

    def _timer(self, first: int, timer: int | None) -> int:
        at = -(-first // self.grid_ms) * self.grid_ms
        if timer is None or at < timer:
            self.handle.registerTimer(at)
            return at
        return timer

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts, timer = self.standing_timer.get() if self.standing_timer.exists() else (0, None)
        held, n = {}, 0

        def put() -> None:
            nonlocal parts, timer
            for x in held.values():
                for i in range(0, len(x), self.chunk_rows):
                    chunk = x[i : i + self.chunk_rows]
                    first = min(ms for ms, _ in chunk)
                    self.waiting.updateValue((first, parts), ("[" + ",".join(row for _, row in chunk) + "]",))
                    parts, timer = parts + 1, self._timer(first, timer)
            held.clear()

        for part in rows:
            for ms, seq, body in zip(part["ms"].tolist(), part["seq"].tolist(), part["body"].tolist(), strict=True):
                held.setdefault(ms // self.minute_ms, []).append((ms, f"[{ms},{seq},{body}]"))
            n += len(part)
            if n >= self.held_rows:
                put()
                n = 0
        put()
        self.standing_timer.update((parts, timer))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = timerValues.getCurrentWatermarkInMs()
        chunks, minutes = sorted(self.waiting.keys()), {}
        left = [first for first, _ in chunks if first > due]
        for first, part in chunks:
            if first <= due:
                minutes.setdefault(first // self.minute_ms, []).append((first, part))
        state, out = self.load() if minutes else None, []
        for minute in sorted(minutes):
            ready = {}
            for first, part in sorted(minutes[minute], key=lambda x: x[1]):  # of rows that come twice the last counts
                later = []
                for row in json.loads(self.waiting.getValue((first, part))[0]):
                    if row[0] <= due:
                        ready[row[0], row[1]] = row[2]
                    else:
                        later.append(row)
                self.waiting.removeKey((first, part))
                if later:
                    left.append(min(row[0] for row in later))
                    self.waiting.updateValue((left[-1], part), (json.dumps(later),))
            out += self.take(state, [(*k, ready[k]) for k in sorted(ready)])
            if len(out) >= self.chunk_rows:
                yield pd.DataFrame([(key[0], *x) for x in out], columns=self.columns)
                out = []
        if minutes:
            self.save(state)
        parts, _ = self.standing_timer.get()
        self.standing_timer.update((parts, self._timer(min(left), None) if left else None))
        if out:
            yield pd.DataFrame([(key[0], *x) for x in out], columns=self.columns)

    def load(self):
        raise NotImplementedError

    def take(self, state, rows: list[tuple[int, int, dict]]) -> list[tuple]:
        raise NotImplementedError

    def save(self, state) -> None:
        raise NotImplementedError


class LiveBook(InOrder):
    """A symbol's book in state: a map of levels, the differences that wait for a snapshot, and where the book stands."""

    columns = ["symbol", "ms", "seq", "verdict", "state", "best_bid", "best_ask", "n_levels"]

    def init(self, handle) -> None:
        super().init(handle)
        self.levels = handle.getMapState("levels", "side string, price double", "qty double")
        self.buffer = handle.getListState("buffer", "body string")
        self.standing = handle.getValueState("standing", "state string, last long")

    def load(self) -> tuple[dict, dict, list]:
        s = bookstate.new_book()
        if self.standing.exists():
            s["state"], s["last"] = self.standing.get()
        s["book"] = {(k[0], k[1]): v[0] for k, v in self.levels.iterator()}
        s["buffer"] = [json.loads(x[0]) for x in self.buffer.get()] if self.buffer.exists() else []
        return s, dict(s["book"]), list(s["buffer"])

    def take(self, state: tuple[dict, dict, list], rows: list[tuple[int, int, dict]]) -> list[tuple]:
        s, out = state[0], []
        for ms, seq, x in rows:
            levels = [(v["side"], v["price"], v["qty"]) for v in x.get("levels") or ()]
            out.append((ms, seq, *bookstate.on_message(s, x["kind"], x.get("first_u"), x["u"], x.get("pu"), levels)))
        return out

    def save(self, state: tuple[dict, dict, list]) -> None:
        s, before, waited = state
        for k in before.keys() - s["book"].keys():
            self.levels.removeKey(k)
        for k, qty in s["book"].items():
            if before.get(k) != qty:
                self.levels.updateValue(k, (qty,))
        now = [json.dumps(m) for m in s["buffer"]]
        if now != [json.dumps(m) for m in waited]:
            self.buffer.put([(m,) for m in now]) if now else self.buffer.clear()
        self.standing.update((s["state"], s["last"]))


def _in_order(rows: DataFrame, late: str) -> DataFrame:
    """(symbol, ms, seq, body, event_time): what :class:`InOrder` takes; all other columns travel in ``body``."""
    rest = [c for c in rows.columns if c not in ("symbol", "ms", "seq")]
    slim = rows.select("symbol", "ms", "seq", F.to_json(F.struct(*rest)).alias("body"), F.timestamp_millis("ms").alias("event_time"))
    return slim.withWatermark("event_time", late)


def live_synced_books(messages: DataFrame, late: str = "10 seconds") -> DataFrame:
    """:func:`~tidemark.operators.folds.synced_books` on a stream of snapshots and differences, each message as soon as the watermark has passed it.

    Needs a session whose state store has maps and timers
    (``spark.sql.streaming.stateStore.providerClass``: RocksDB).
    """
    out = "symbol string, ms long, seq long, verdict string, state string, best_bid double, best_ask double, n_levels int"
    return _in_order(messages, late).groupBy("symbol").transformWithStateInPandas(LiveBook(), out, "append", "EventTime")


class LiveWalls(InOrder):
    """Standing walls of a symbol in state; a wall is given out when a snapshot comes without it.

    ``body`` holds a snapshot's ``levels`` (side, price, notional). A level is
    a wall if it is worth at least ``least`` and ``multiple`` times the five
    best bids; only the 100 best levels of a side count.
    """

    columns = ["symbol", "price", "side", "first_ms", "gone_ms", "updates", "most", "average", "current", "added", "removed", "refills"]

    def __init__(self, least: float, multiple: float):
        self.least, self.multiple = least, multiple

    def init(self, handle) -> None:
        super().init(handle)
        self.walls = handle.getMapState("walls", "price double", "side string, first_ms long, updates long, most double, total double, current double, added double, removed double, refills long")

    def _large(self, levels: list[dict]) -> dict[float, tuple[str, float]]:
        best = {side: sorted((x for x in levels if x["side"] == side), key=lambda x: x["price"], reverse=side == "BID")[:100] for side in ("BID", "ASK")}
        threshold = max(self.least, self.multiple * sum(x["notional"] for x in best["BID"][:5]))
        return {x["price"]: (side, x["notional"]) for side, rows in best.items() for x in rows if x["notional"] >= threshold}

    def load(self) -> tuple[dict, dict]:
        standing = {k[0]: v for k, v in self.walls.iterator()}
        return standing, dict(standing)

    def take(self, state: tuple[dict, dict], rows: list[tuple[int, int, dict]]) -> list[tuple]:
        standing, out = state[0], []
        for ms, _, body in rows:
            large = self._large(body["levels"] or [])
            for price in standing.keys() - large.keys():
                side, first, updates, most, total, *rest = standing.pop(price)
                out.append((price, side, first, ms, updates, most, total / updates, *rest))
            for price, (side, value) in large.items():
                if price not in standing:
                    standing[price] = (side, ms, 1, value, value, value, 0.0, 0.0, 0)
                    continue
                side, first, updates, most, total, current, added, removed, refills = standing[price]
                change, most = value - current, max(most, value)
                refilled = current < most * 0.2 and change > most * 0.3
                standing[price] = (side, first, updates + 1, most, total + value, value, added + max(change, 0), removed + max(-change, 0), refills + refilled)
        return out

    def save(self, state: tuple[dict, dict]) -> None:
        standing, before = state
        for price in before.keys() - standing.keys():
            self.walls.removeKey((price,))
        for price, wall in standing.items():
            if before.get(price) != wall:
                self.walls.updateValue((price,), wall)


class LiveFlow(InOrder):
    """Exact trailing sums of a symbol: the trades of the longest window in state, older ones evicted.

    ``body`` holds side and notional in millionths. Trades of equal time see
    each other, as windows of the batch form do.
    """

    def __init__(self, windows: dict[str, int]):
        self.windows = windows
        self.columns = ["symbol", "ms", "seq", "first_ms", *[f"{c}_{w}" for w in windows for c in ("buy", "sell", "n")]]

    def init(self, handle) -> None:
        super().init(handle)
        self.trades = handle.getMapState("trades", "minute long", "rows string")
        self.begun = handle.getValueState("begun", "first_ms long")

    def load(self) -> dict:
        kept = {k[0]: v[0] for k, v in self.trades.iterator()}
        # In each window the trades of the line from ``at`` on, and their sums.
        s = {"first": self.begun.get()[0] if self.begun.exists() else None, "minutes": set(kept), "since": None, "line": [], "at": dict.fromkeys(self.windows, 0), "sums": {w: [0, 0, 0] for w in self.windows}}
        self._pass(s, [tuple(x) for minute in sorted(kept) for x in json.loads(kept[minute])])
        return s

    def _pass(self, s: dict, new: list[tuple]) -> list[tuple]:
        """The sums at each of ``new``, which follow the line's trades and join them; trades that no window holds any more leave it."""
        line, at, sums, out = s["line"], s["at"], s["sums"], []
        now = len(line)
        line += new
        while now < len(line):
            end, ms = now, line[now][0]
            while end < len(line) and line[end][0] == ms:
                end += 1
            for w, length in self.windows.items():
                mine, i = sums[w], at[w]
                for _, _, buy, micros in line[now:end]:
                    mine[0 if buy else 1] += micros
                while line[i][0] < ms - length:
                    mine[0 if line[i][2] else 1] -= line[i][3]
                    i += 1
                at[w], mine[2] = i, end - i
            found = [x for w in self.windows for x in sums[w]]
            out += [(ms, line[i][1], s["first"], *found) for i in range(now, end)]
            now = end
        gone = min(at.values())
        del line[:gone]
        for w in at:
            at[w] -= gone
        return out

    def take(self, state: dict, rows: list[tuple[int, int, dict]]) -> list[tuple]:
        if state["first"] is None:
            state["first"] = rows[0][0]
        if state["since"] is None:
            state["since"] = rows[0][0] // self.minute_ms
        return self._pass(state, [(ms, seq, x["side"] == "BUY", x["micros"]) for ms, seq, x in rows])

    def save(self, state: dict) -> None:
        minutes = {}
        for trade in state["line"]:
            minutes.setdefault(trade[0] // self.minute_ms, []).append(trade)
        for minute in state["minutes"] - minutes.keys():
            self.trades.removeKey((minute,))
        for minute, trades in minutes.items():
            if minute >= state["since"]:
                self.trades.updateValue((minute,), (json.dumps(trades),))
        self.begun.update((state["first"],))


def live_trailing(trades: DataFrame, windows: dict[str, int], late: str = "10 seconds") -> DataFrame:
    """Each trade (symbol, agg_id, ms) with ``buy``, ``sell`` (exact notional) and ``n`` of every trailing window, and the time of the symbol's first trade.

    Equals :func:`~tidemark.operators.blocks.trailing_sums` row by row, once the watermark has passed a trade.
    """
    rows = trades.select("symbol", "ms", F.col("agg_id").alias("seq"), "side", (F.col("notional") * 1_000_000).cast("long").alias("micros"))
    out = "symbol string, ms long, seq long, first_ms long, " + ", ".join(f"buy_{w} long, sell_{w} long, n_{w} long" for w in windows)
    sums = _in_order(rows, late).groupBy("symbol").transformWithStateInPandas(LiveFlow(windows), out, "append", "EventTime")
    exact = lambda c: (F.col(c).cast("decimal(38,6)") / 1_000_000).cast("decimal(28,6)").alias(c)
    return sums.select("symbol", "ms", F.col("seq").alias("agg_id"), "first_ms", *[c for w in windows for c in (exact(f"buy_{w}"), exact(f"sell_{w}"), F.col(f"n_{w}"))])


def live_walls(snapshots: DataFrame, cfg: Config = C, late: str = "10 seconds") -> DataFrame:
    """Walls that have gone, from a stream of snapshots (symbol, ms, seq, levels: array of side, price, notional).

    One row for each wall as of the snapshot without it, as :func:`~tidemark.operators.book.walls`
    has them; walls that still stand are in the state. Sums are doubles.
    """
    out = "symbol string, price double, side string, first_ms long, gone_ms long, updates long, most double, average double, current double, added double, removed double, refills long"
    return _in_order(snapshots, late).groupBy("symbol").transformWithStateInPandas(LiveWalls(cfg.wall_least, cfg.wall_multiple), out, "append", "EventTime")
