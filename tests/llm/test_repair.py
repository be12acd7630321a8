"""Conversation repair against a plain search over all edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import repair

TURNS = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 4:
            role = "user"
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_repair(rows):
    """The least (cost, audit) by a forward search that keeps every state's best; rows of one conversation."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        solid = text.strip(BLANK)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    follow = {"": {"s", "u"}, "s": {"u"}, "u": {"a"}, "a": {"u"}}
    ways = {"": (0, "", ())}

    def inserted(ways):
        out = dict(ways)
        for _ in range(3):
            for state, (cost, audit, lines) in list(out.items()):
                new = "a" if state == "u" else "u"
                way = (cost + 2, audit + "I", (*lines, ("assistant:" if new == "a" else "user:")))
                out[new] = min(out.get(new, way), way)
        return out

    for (_, _, role, text), fault, initial in zip(rows, faults, initials, strict=True):
        nxt = {}
        for state, (cost, audit, lines) in inserted(ways).items():
            options = [(state, cost + 3, "D", ())]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if initial and initial in follow[state]:
                    options.append((initial, cost + more, "K", (f"{role}:{text}",)))
                new = "a" if state == "u" else "u"
                options.append((new, cost + 2 + more, "R", (f"{'assistant' if new == 'a' else 'user'}:{text}",)))
            for to, c, letter, line in options:
                way = (c, audit + letter, (*lines, *line))
                nxt[to] = min(nxt.get(to, way), way)
        ways = nxt
    cost, audit, lines = min(w for s, w in inserted(ways).items() if s in ("", "a"))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, "\n".join(lines))


def made(seed, convs, longest):
    r = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(r.randint(0, longest)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = r.choice(["Yes.", "No", "Why?", " ", None, f"t{r.randint(0, 9)}!", f"x {r.random()}", "end. \n"])
            rows.append((conv if conv else None, r.choice([turn, turn, turn, turn // 2, None]), role, text))
    return rows


def expected(rows, damaged):
    groups = {c: [] for c in {r[0] for r in rows}}
    for r in damaged:
        groups[r[0]].append(r)
    return {c: plain_repair(g) for c, g in groups.items()}


def results(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired) for r in df.collect()}


@pytest.mark.parametrize(("piece_rows", "longest"), [(4096, 9), (3, 40)])
def test_against_plain_search(spark, piece_rows, longest):
    rows = made(piece_rows, 60, longest)
    df = spark.createDataFrame(rows, TURNS).withColumn("_block", F.lit(1)).withColumn("copies", F.lit("x")).withColumn("part", F.lit(2))
    damaged = repair.damage(df)
    assert sorted(map(repr, (tuple(r)[:4] for r in damaged.collect() for _ in range(r.copies)))) == sorted(map(repr, plain_damage(rows)))
    assert results(repair.repair(damaged, piece_rows=piece_rows)) == expected(rows, plain_damage(rows))
    assert results(repair.repair(damaged, digest=True, piece_rows=piece_rows)) == {
        c: (*x[:-1], hashlib.sha256(x[-1].encode()).hexdigest()) for c, x in expected(rows, plain_damage(rows)).items()
    }


def test_undamaged_rows_and_repeats(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello!"), (2, 0, "user", "Hi."), (2, 0, "user", "Hi."), (2, 0, "user", "Hi."), (3, None, None, None), (4, 5, "system", "S.")]
    got = results(repair.repair(spark.createDataFrame(rows, TURNS)))
    assert got[1] == (0, 0, 0, 0, 0, 0, "KKK", "system:Be kind.\nuser:Hi.\nassistant:Hello!")
    assert got[2] == (0, 0, 2, 0, 2, 8, "KDDI", "user:Hi.\nassistant:")
    assert got[3] == (0, 1, 0, 0, 0, 3, "D", "")
    assert got[4] == plain_repair([rows[-1]])


def test_empty_table(spark):
    assert repair.repair(repair.damage(spark.createDataFrame([], TURNS)), digest=True).collect() == []


def test_long_conversation_in_pieces(spark):
    """One conversation that many tasks share, with repeats far apart."""
    rows = [(7, t, ("user", "assistant")[t % 2] if t % 11 else "tool", f"text {t % 700}{'.' if t % 5 else ''}") for t in range(3000)]
    got = results(repair.repair(spark.createDataFrame(rows, TURNS).repartition(8), piece_rows=128))
    assert got == {7: plain_repair(rows)}


def test_tensor_costs_are_the_search_costs():
    r = random.Random(4)
    codes = np.array([[r.choice([0, 1, 2, 3, 5, 6, 8]) for _ in range(50)] for _ in range(7)])
    extra = np.zeros_like(codes)
    back = repair.costs_back(codes, extra, np.tile(repair.ENDS, (50, 1)))
    names = {0: ("system", "a."), 1: ("user", "a."), 2: ("assistant", "a."), 3: ("tool", "a."), 5: ("user", "a"), 6: ("assistant", "a"), 8: ("user", "")}
    for i in range(50):
        rows = [(0, t, names[c][0], f"{t}{names[c][1]}" if names[c][1] else "") for t, c in enumerate(codes[:, i])]
        assert back[0, i, 0] == plain_repair(rows)[5]
