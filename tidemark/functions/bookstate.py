"""One symbol's book between snapshots and differences: the step that batch folds and streams share."""

from __future__ import annotations

#: Differences kept until a snapshot comes; the oldest goes first.
BUFFER = 2_000


def new_book() -> dict:
    """``last``: the last id that the book holds, 0 without one; ``book``: size by side and price; ``buffer``: differences that wait."""
    return {"state": "INITIALISING", "last": 0, "book": {}, "buffer": []}


def _set(s: dict, levels: list) -> None:
    for side, price, qty in levels:
        if qty == 0:
            s["book"].pop((side, price), None)
        else:
            s["book"][side, price] = qty


def _ask_anew(s: dict) -> None:
    """What was buffered doesn't meet the snapshot: wait for another one."""
    s["buffer"], s["last"] = [], 0


def _catch_up(s: dict) -> None:
    """Play the buffer onto a snapshot, if it reaches over its id."""
    at = s["last"] + 1
    waiting = [m for m in s["buffer"] if m[1] >= at]
    if waiting and waiting[0][0] > at:
        return _ask_anew(s)
    while waiting and not waiting[0][0] <= at <= waiting[0][1]:
        waiting.pop(0)
    if not waiting:
        return None
    s["last"] = waiting[0][1]
    _set(s, waiting[0][3])
    for _, u, previous, levels in waiting[1:]:
        if u > s["last"] and previous != s["last"]:
            return _ask_anew(s)
        s["last"] = u
        _set(s, levels)
    s["buffer"], s["state"] = [], "HEALTHY"
    return None


def on_snapshot(s: dict, last_id: int, levels: list) -> str:
    """A whole book (side, price, size) as of ``last_id``."""
    s["book"], s["last"], s["state"] = {}, last_id, "SYNCING"
    _set(s, levels)
    _catch_up(s)
    return "SNAPSHOT"


def on_difference(s: dict, first: int, u: int, previous: int, levels: list) -> str:
    """Levels that changed from id ``first`` to ``u``, after the message ``previous``: what becomes of the message."""
    if s["state"] != "HEALTHY":
        if s["state"] == "INITIALISING":
            s["state"] = "SYNCING"
        s["buffer"] = [*s["buffer"], [first, u, previous, levels]][-BUFFER:]
        if s["state"] == "SYNCING" and s["last"] > 0:
            _catch_up(s)
        return "BUFFERED" if s["state"] != "HEALTHY" else "OK"
    if u <= s["last"]:
        return "DUPLICATE"
    if previous < s["last"]:
        return "OUT_OF_ORDER"
    if previous > s["last"]:
        s["state"], s["last"], s["book"], s["buffer"] = "RESYNCING", 0, {}, []
        return "GAP"
    s["last"] = u
    _set(s, levels)
    return "OK"


def on_message(s: dict, kind: str, first: int | None, u: int, previous: int | None, levels: list) -> tuple:
    """(verdict, state, best bid, best ask, number of levels) after a snapshot (``u`` is its id) or a difference; prices only of a healthy book."""
    levels = [(side, price, qty) for side, price, qty in levels or ()]
    verdict = on_snapshot(s, u, levels) if kind == "snapshot" else on_difference(s, first, u, previous, levels)
    shown = s["book"] if s["state"] == "HEALTHY" else {}
    bids, asks = [p for side, p in shown if side == "BID"], [p for side, p in shown if side == "ASK"]
    return verdict, s["state"], max(bids, default=None), min(asks, default=None), len(s["book"])
