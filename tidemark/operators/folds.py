"""Ordered folds: state that depends on earlier verdicts of the same key.

Rows are dealt by key and sorted by Spark (which spills); each task streams
its rows once and holds the state of one key at a time, so a key of any length
needs no more memory than a short one.

:func:`blocked_fold` deals a key's history over tasks: every block is folded
from an assumed state, what a block really leaves is compared with what the
next one has assumed, and blocks that assumed wrongly are folded again until
none is left. Verdicts forget what was long ago (a cooldown runs out, an
accepted id replaces the one before), so as a rule no block is folded again.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.config import UNCOOLED, Config
from tidemark.functions import bookstate
from tidemark.session import written

C = Config()


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], needs: list[str], step: Callable, start: Callable, out: str) -> DataFrame:
    """``df`` with the columns of the DDL ``out``: ``step(state, *needs)`` gives their values.

    ``start()`` makes a key's state. Rows come in ``order`` within a key (null
    keys are a key of their own). Only keys and ``needs`` become Python
    values; other columns pass through as Arrow arrays.
    """
    added = T._parse_datatype_string(out)
    schema = T.StructType([*df.schema.fields, *added.fields])
    arrow, names = to_arrow_schema(schema), df.columns
    key_at, need_at = [names.index(c) for c in keys], [names.index(c) for c in needs]

    def fold(batches):
        key, state = object(), None
        for batch in batches:
            key_rows = zip(*(batch.columns[i].to_pylist() for i in key_at), strict=True)
            need_rows = zip(*(batch.columns[i].to_pylist() for i in need_at), strict=True)
            results = []
            for k, row in zip(key_rows, need_rows, strict=True):
                if k != key:
                    key, state = k, start()
                results.append(step(state, *row))
            new = list(zip(*results, strict=True)) if results else [()] * len(added)
            arrays = [*batch.columns, *[pa.array(v, arrow.field(len(names) + i).type) for i, v in enumerate(new)]]
            yield pa.RecordBatch.from_arrays([a.cast(arrow.field(i).type) for i, a in enumerate(arrays)], schema=arrow)

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(fold, schema)


#: The block of rows without a time; they come first.
UNTIMED = -(2**62)


def _settled(start: Callable, settle: Callable | None, counters: tuple[str, ...]) -> Callable:
    """What matters of a block's exit to the next block, in one form for states that are worth the same; None: the first block."""

    def canon(left, begins):
        state = {**start(), **(json.loads(left)["state"] if left else {})}
        state = settle(state, begins) if settle and left else state
        return json.dumps({k: v for k, v in state.items() if k not in counters}, sort_keys=True)

    return canon


def blocked_fold(
    df: DataFrame, keys: list[str], order: list[str], needs: list[str], step: Callable, start: Callable, out: str, at: str, width: int,
    settle: Callable | None = None, counters: tuple[str, ...] = (), carried: tuple[str, ...] = (),
) -> DataFrame:
    """As :func:`ordered_fold`, on tasks for each key and block of ``width`` of the column ``at``, which ``order`` must agree with.

    States are JSON values. ``settle(state, begins)`` may bring a state that a
    block finds at its start into the form of all states that lead to the same
    from there on (an expired cooldown to none). ``counters`` are keys of the
    state and columns of ``out`` that start at 0 and that ``step`` adds to but
    never asks; they are counted in blocks and added up over blocks. Columns
    ``carried`` of ``out`` are null where a block doesn't know them yet; they
    take the last value of the blocks before.

    Right for any step: when no block has assumed another state than the one
    before it leaves, all have been folded from what precedes them. Each round
    settles at least one more block of each key; rounds are as many as blocks
    in a row that pass a wrong state on.
    """
    added = T._parse_datatype_string(out)
    names = df.columns
    key = F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]))
    block = F.coalesce(F.floor(F.col(at) / width), F.lit(UNTIMED)).cast("long")
    rows = written(df.withColumns({"_key": key, "_block": block}))
    canon = _settled(start, settle, counters)
    canonical = F.udf(canon, "string")
    slim = list(dict.fromkeys([*order, *needs]))

    def folded(part: DataFrame, keep: list[str]) -> DataFrame:
        """``part`` (with ``_entry``) folded; ``_exit`` holds a block's state as of ``_n`` rows, at its end and where a batch ends."""
        part = part.select(*keep, "_key", "_block", "_entry")
        schema = T.StructType([*part.drop("_entry").schema.fields, *added.fields, *T._parse_datatype_string("_exit string, _n long").fields])
        arrow, cols = to_arrow_schema(schema), part.columns
        places = [cols.index(c) for c in ("_key", "_block", "_entry")]
        need_at = [cols.index(c) for c in needs]

        def fold(batches):
            now, state, n, last = None, None, 0, {}
            for batch in batches:
                heads = zip(*(batch.columns[i].to_pylist() for i in places), strict=True)
                need_rows = zip(*(batch.columns[i].to_pylist() for i in need_at), strict=True)
                results, exits, counts = [], [], []
                left = lambda: json.dumps({"state": state, "last": last})  # noqa: B023,E731
                for (k, b, entry), row in zip(heads, need_rows, strict=True):
                    if (k, b) != now:
                        if exits:
                            exits[-1] = left()
                        now, n, last = (k, b), 0, {}
                        state = {**start(), **(json.loads(entry) if entry else {})}
                    values = step(state, *row)
                    for c, v in zip(added.names, values, strict=True):
                        if c in carried and v is not None:
                            last[c] = v
                    n += 1
                    results.append(values)
                    exits.append(None)
                    counts.append(n)
                if exits:
                    exits[-1] = left()
                new = list(zip(*results, strict=True)) if results else [()] * len(added)
                arrays = [*(a for c, a in zip(cols, batch.columns, strict=True) if c != "_entry"), *new, exits, counts]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, arrow, strict=True)], schema=arrow)

        dealt = part.repartition("_key", "_block").sortWithinPartitions("_key", "_block", *order)
        return dealt.mapInArrow(fold, schema)

    def left_by(part: DataFrame) -> DataFrame:
        return part.where("_exit is not null").groupBy("_key", "_block").agg(F.max_by("_exit", "_n").alias("_exit"))

    over = Window.partitionBy("_key").orderBy("_block")
    begins = F.when(F.col("_block") == UNTIMED, UNTIMED).otherwise(F.col("_block") * width)
    after = lambda exits: exits.select("_key", "_block", "_exit", canonical(F.lag("_exit").over(over), begins).alias("_entry"))
    assumed = written(after(left_by(folded(rows.withColumn("_entry", F.lit(None).cast("string")), slim)))).select("_key", "_block", "_entry")
    done = written(folded(rows.join(assumed, ["_key", "_block"]), names))
    while True:
        found = written(after(left_by(done)))
        wrong = found.withColumnRenamed("_entry", "_now").join(assumed, ["_key", "_block"]).where("_now <> _entry").select("_key", "_block", F.col("_now").alias("_entry"))
        if wrong.isEmpty():
            break
        again = folded(rows.join(wrong, ["_key", "_block"]), names)
        done = written(done.join(wrong, ["_key", "_block"], "left_anti").unionByName(again))
        assumed = found.select("_key", "_block", "_entry")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    kinds = {f.name: f.dataType.simpleString() for f in added.fields}
    value = lambda where, c: F.get_json_object("_exit", f"$.{where}.{c}").cast(kinds[c])
    sums = {f"_sum_{c}": F.coalesce(F.sum(value("state", c)).over(before), F.lit(0)) for c in counters}
    lasts = {f"_last_{c}": F.last(value("last", c), True).over(before) for c in carried}
    result = done.join(found.select("_key", "_block", *[c.alias(n) for n, c in (sums | lasts).items()]), ["_key", "_block"])
    full = lambda c: F.col(c) + F.col(f"_sum_{c}") if c in counters else F.coalesce(F.col(c), F.col(f"_last_{c}")) if c in carried else F.col(c)
    return result.select(*names, *[full(c).cast(kinds[c]).alias(c) for c in added.names])


# --- update ids of the depth stream ----------------------------------------------------------


def sequence_verdicts(diffs: DataFrame, order: list[str] | None = None, width: int = 100_000) -> DataFrame:
    """Depth messages (symbol, pos, u, pu) with verdict and epoch, by blocks of ``width`` positions (or of the first column of ``order``).

    OK, DUPLICATE (u not above the last accepted), OUT_OF_ORDER (pu below it)
    or GAP (pu above it); only OK advances. The first message is OK, and so is
    the first after a gap, when the book is built anew: ``epoch`` counts gaps.
    A null pu continues whatever was accepted last.
    """

    def step(s, u, pu):
        last = s["last"]
        if last is None:
            verdict = "OK"
        elif u <= last:
            verdict = "DUPLICATE"
        elif pu is not None and pu < last:
            verdict = "OUT_OF_ORDER"
        elif pu is not None and pu > last:
            verdict = "GAP"
        else:
            verdict = "OK"
        if verdict == "OK":
            s["last"] = u
        elif verdict == "GAP":
            s["last"] = None
            s["epoch"] += 1
        return verdict, s["epoch"]

    order = order or ["pos"]
    return blocked_fold(diffs, ["symbol"], order, ["u", "pu"], step, lambda: {"last": None, "epoch": 0}, "verdict string, epoch long", order[0], width, counters=("epoch",))


def synced_books(messages: DataFrame) -> DataFrame:
    """Snapshots and differences (symbol, ms, seq, kind, first_u, u, pu, levels) with the book's state after each.

    Adds verdict, state (INITIALISING, SYNCING, HEALTHY, RESYNCING), best bid
    and ask of a healthy book, and the number of levels. ``levels`` is an array
    of (side, price, qty). Differences wait until a snapshot comes that they
    reach over; after a gap the book is cleared until the next one.
    """

    def step(s, kind, first, u, previous, levels):
        return bookstate.on_message(s, kind, first, u, previous, [(x["side"], x["price"], x["qty"]) for x in levels or ()])

    return ordered_fold(messages, ["symbol"], ["ms", "seq"], ["kind", "first_u", "u", "pu", "levels"], step, bookstate.new_book, "verdict string, state string, best_bid double, best_ask double, n_levels int")


# --- event cooldown ----------------------------------------------------------------------------


def event_cooldown(events: DataFrame, cfg: Config = C) -> DataFrame:
    """Events (symbol, ms, type, window, price) with ``accepted``.

    An event of the same symbol, type and window as an accepted one is held
    back for ``cooldown_ms``, unless the price has moved by ``cooldown_move``
    since. The uncooled types always pass.
    """

    def step(s, kind, ms, price):
        if kind in UNCOOLED:
            return (True,)
        last, old = s["ms"], s["price"]
        moved = bool(old and price and old > 0 and price > 0 and abs(price - old) / old >= cfg.cooldown_move)
        ok = last is None or ms - last >= cfg.cooldown_ms or moved
        if ok:
            s["ms"], s["price"] = ms, price
        return (ok,)

    return ordered_fold(events, ["symbol", "type", "window"], ["ms", "alert_id"], ["type", "ms", "price"], step, lambda: {"ms": None, "price": None}, "accepted boolean")


# --- decisions ---------------------------------------------------------------------------------


def commit_decisions(decisions: DataFrame, cfg: Config = C) -> DataFrame:
    """Evaluated ticks (symbol, ms, action, candidate, gated) with the committed action, its version and cooldown.

    ``action`` is what the tick asks for without a cooldown, ``gated`` whether
    a data gate (invalid, stale, warming up) decided it. While a cooldown runs,
    ticks that pass the data gates commit COOLDOWN. Only a new confirmation
    starts a cooldown. The version counts changes of the committed action.
    """

    def step(s, asked, candidate, gated, ms):
        action = asked if gated or ms >= s["until"] else "COOLDOWN"
        old = s["action"]
        if action != old:
            s["version"] += 1
            if candidate and action in ("CONFIRMED_LONG", "CONFIRMED_SHORT"):
                s["until"] = ms + cfg.signal_cooldown_ms
        s["action"] = action
        return old, action, s["version"], s["until"] if s["until"] >= 0 else None

    expired = lambda s, begins: s if s["until"] > begins else {**s, "until": -1}
    return blocked_fold(
        decisions, ["symbol"], ["ms"], ["action", "candidate", "gated", "ms"], step, lambda: {"action": "WARMING_UP", "version": 0, "until": -1},
        "old_action string, committed string, version long, cooldown_until long", "ms", cfg.block_ms, expired, ("version",), ("cooldown_until",),
    )


def register_signals(signals: DataFrame, quiet_ms: int = 300_000) -> DataFrame:
    """Signals (symbol, ms, signal_id, ...) with ``registered``: none within ``quiet_ms`` of the symbol's last registered one."""

    def step(s, ms):
        ok = s["ms"] is None or ms - s["ms"] >= quiet_ms
        if ok:
            s["ms"] = ms
        return (ok,)

    quiet_over = lambda s, begins: s if s["ms"] is not None and s["ms"] + quiet_ms > begins else {"ms": None}
    return blocked_fold(signals, ["symbol"], ["ms", "signal_id"], ["ms"], step, lambda: {"ms": None}, "registered boolean", "ms", C.block_ms, quiet_over)


# --- paper trading -------------------------------------------------------------------------------


def _fill(s: dict, symbol: str, side: str, qty: float, price: float) -> tuple[str, float]:
    """One order against the account: its kind and the profit it realises."""
    held = s["held"].get(symbol)
    if qty <= 0 or price <= 0:
        return "REJECTED", 0.0
    if held and held["side"] != side:
        part = min(qty, held["qty"])
        gain = part * (price - held["entry"]) * (1 if held["side"] == "BUY" else -1)
        s["cash"] += part * held["entry"] / s["leverage"] + gain
        s["realized"] += gain
        if qty < held["qty"]:
            held["qty"] -= qty
            return "PARTIAL_CLOSE", gain
        rest = qty - held["qty"]
        del s["held"][symbol]
        if rest > 0 and s["cash"] >= rest * price / s["leverage"]:
            s["held"][symbol] = {"side": side, "qty": rest, "entry": price}
            s["cash"] -= rest * price / s["leverage"]
            return "FLIP", gain
        return "CLOSE", gain
    if held and not s["compat"]:
        return "REJECTED", 0.0
    if s["cash"] < qty * price / s["leverage"]:
        return "REJECTED", 0.0
    s["held"][symbol] = {"side": side, "qty": qty, "entry": price}
    s["cash"] -= qty * price / s["leverage"]
    return "OPEN", 0.0


def paper_orders(orders: DataFrame, cash: float = 10_000.0, leverage: float = 5.0, compat: bool = True) -> DataFrame:
    """Orders (account, symbol, ms, order_id, side, qty, price) with kind, profit, cash and realised profit after each.

    Cash is shared by an account's symbols, so the account is the key. A
    second order on the same side replaces the position under ``compat`` and
    is rejected otherwise.
    """

    def step(s, symbol, side, qty, price):
        kind, gain = _fill(s, symbol, side, qty, price)
        return kind, gain, s["cash"], s["realized"], len(s["held"])

    start = lambda: {"cash": cash, "realized": 0.0, "held": {}, "leverage": leverage, "compat": compat}
    return ordered_fold(orders, ["account"], ["ms", "order_id"], ["symbol", "side", "qty", "price"], step, start, "kind string, gain double, cash double, realized double, n_held long")


OPPOSITE = {"BUY": ("CONFIRMED_SHORT", "SHORT (SWEEP)", "SHORT_BIAS", "WATCH_SHORT"), "SELL": ("CONFIRMED_LONG", "LONG (SWEEP)", "LONG_BIAS", "WATCH_LONG")}


def auto_trader(ticks: DataFrame, cash: float = 10_000.0, leverage: float = 5.0, share: float = 0.10, take: float = 0.01, stop: float = 0.10) -> DataFrame:
    """Ticks (account, symbol, ms, price, action, entry) traded by rule.

    A position closes at +``take``, -``stop`` or on an opposite action; ``entry``
    (BUY, SELL or null) opens one with ``share`` of equity times leverage.
    """

    def step(s, symbol, price, action, entry):
        s["marks"][symbol] = price
        closed = opened = None
        gain = 0.0
        held = s["held"].get(symbol)
        if held:
            profit = (price - held["entry"]) / held["entry"] * (1 if held["side"] == "BUY" else -1)
            if profit >= take or profit <= -stop or action in OPPOSITE[held["side"]]:
                closed = "TAKE" if profit >= take else "STOP" if profit <= -stop else "OPPOSITE"
                _, gain = _fill(s, symbol, "SELL" if held["side"] == "BUY" else "BUY", held["qty"], price)
        if symbol not in s["held"] and entry in ("BUY", "SELL") and price > 0:
            open_ = sum(h["qty"] * (s["marks"].get(k, h["entry"]) - h["entry"]) * (1 if h["side"] == "BUY" else -1) for k, h in s["held"].items())
            kind, _ = _fill(s, symbol, entry, (s["cash"] + open_) * share * leverage / price, price)
            opened = entry if kind == "OPEN" else None
        return closed, opened, gain, s["cash"], s["realized"]

    start = lambda: {"cash": cash, "realized": 0.0, "held": {}, "marks": {}, "leverage": leverage, "compat": True}
    return ordered_fold(ticks, ["account"], ["ms", "symbol"], ["symbol", "price", "action", "entry"], step, start, "closed string, opened string, gain double, cash double, realized double")


def cached_interpretations(requests: DataFrame, ttl_ms: int = 60_000) -> DataFrame:
    """Requests (scope, ms, request_id, input_hash, ok) with ``source``: a new call, the cache (same input, fresh) or the last good answer."""

    def step(s, ms, input_hash, ok):
        fresh = s["ms"] is not None and ms - s["ms"] <= ttl_ms
        if fresh and s["hash"] == input_hash:
            return ("CACHE",)
        if ok:
            s["ms"], s["hash"] = ms, input_hash
            return ("CALL",)
        return ("FALLBACK" if s["ms"] is not None else "FAILED",)

    stale = lambda s, begins: s if s["ms"] is None or s["ms"] + ttl_ms >= begins else {"ms": UNTIMED, "hash": None}
    return blocked_fold(requests, ["scope"], ["ms", "request_id"], ["ms", "input_hash", "ok"], step, lambda: {"ms": None, "hash": None}, "source string", "ms", C.block_ms, stale)
