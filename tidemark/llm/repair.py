"""Conversation structure repair: the cheapest edits that make roles alternate.

A dynamic program over turns, on NumPy tensors with time as first axis:
conversations of like length stand side by side, the costs of their four
states are updated for all of them turn by turn from the end, all costs are
kept, and the edits are traced from the start, again for all at once.

States say what the repaired conversation ends with so far: nothing, a system
turn, a user turn, an assistant turn. It may stop at nothing or at an
assistant turn.

Rows are sorted over the cluster by conversation and turn, so a conversation
of any length is spread over tasks. What lies in one task whole is repaired
there. Of the others (two for each task at most, and those of over ``piece``
rows) each piece is a row; its costs from any state to any other are a small
matrix, the matrices of a conversation are chained from its end, and a last
pass traces piece after piece with the costs known at its end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lean_shuffles, materialise, shared_dir, table

#: Rows and characters in one piece of a conversation: bounds what a worker holds of it.
PIECE_ROWS, PIECE_CHARS = 4096, 8_000_000
#: Turns times conversations in one tensor; characters of conversations that wait for one.
CELLS, WAITING_CHARS = 1 << 16, 16_000_000
BLANK = " \t\n\x0b\x0c\r"
STOPS = ".!?"
DELETE, INSERT, KEEP, REROLE = (ord(c) for c in "DIKR")
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or reroled turn, by the state before.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: The state after a kept turn of initial s, u, a or another one, by the state before; 4: not allowed.
KEPT = np.array([[SYSTEM, 4, 4, 4], [USER, USER, 4, USER], [4, 4, ASSISTANT, 4], [4, 4, 4, 4]])
LEGAL = {"su", "ua", "au"}
FAR = 1 << 40
ENDS = np.array([0, FAR, FAR, 0], np.int64)
#: Codes of rows: class of the initial, whether truncated, whether it must go; padding.
TRUNCATED, GONE, PAD = 4, 8, 16

FIELDS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string"
PIECES = f"part int, piece int, turns array<long>, roles array<string>, texts array<string>, copies array<long>, {RESULT}"


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` with made faults, by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops a row (``copies`` 0), 1 empties its text, 2 takes its full stops,
    exclamation and question marks away, 3 repeats it (``copies`` 2), 4 makes it
    a user turn. Nulls count as one space. Returns conv_id, turn, role, text,
    copies; other columns aren't read.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    return turns.select(
        "conv_id", "turn",
        F.when(fault == 4, "user").otherwise(filled("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text")).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


class Piece:
    """Consecutive rows of one conversation, equal ones once with their number."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.roles, self.texts, self.copies, self.chars = conv_id, [], [], [], [], 0

    def add(self, turn, role: str, text: str, copies: int) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.copies.append(copies)
        self.chars += len(text) + len(role)

    def __len__(self) -> int:
        return len(self.turns)


class Tally:
    """What is counted in a conversation, piece after piece."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.initial = None

    def read(self, piece: Piece, first: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Code of each row, and how many more of it must go. ``first``: whether role and text are new in the conversation."""
        codes, extra = np.zeros(len(piece), np.int64), np.zeros(len(piece), np.int64)
        for i, (turn, role, text, copies) in enumerate(zip(piece.turns, piece.roles, piece.texts, piece.copies, strict=True)):
            initial, solid = role[:1], text.rstrip(BLANK)
            self.illegal += copies - 1 + (self.initial is not None and self.initial + initial not in LEGAL)
            self.initial = initial
            if turn is not None:
                if turn != self.high:
                    self.distinct += 1
                self.low, self.high = turn if self.low is None else self.low, turn
            extra[i] = copies - 1
            if not solid:
                codes[i], self.blank = GONE, self.blank + copies
            elif not first[i]:
                codes[i], self.duplicate = GONE, self.duplicate + copies
            else:
                cut = solid[-1] not in STOPS
                codes[i] = ("sua".find(initial) % 4 if initial else 3) + TRUNCATED * cut
                self.truncated, self.duplicate = self.truncated + cut, self.duplicate + copies - 1
        return codes, extra

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct


def firsts(piece: Piece) -> list[bool]:
    seen: set[tuple[str, str]] = set()
    return [len(seen) != (seen.add(x) or len(seen)) for x in zip(piece.roles, piece.texts, strict=True)]


def _relaxed(costs: np.ndarray) -> np.ndarray:
    """With up to two turns inserted first; a third never pays."""
    for _ in range(2):
        costs = np.minimum(costs, 2 + costs[:, NEXT])
    return costs


def _choices(codes: np.ndarray, extra: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs [n, 4] of deleting, keeping and reroling a row of each conversation, given the costs after it."""
    after = after + 3 * extra[:, None]
    more = ((codes & TRUNCATED) > 0)[:, None]
    stays = FAR * ((codes & GONE) > 0)[:, None]
    open_ended = np.concatenate([after, np.full((len(after), 1), FAR)], axis=1)
    kept = np.take_along_axis(open_ended, KEPT[codes & 3], axis=1)
    return after + 3, kept + more + stays, after[:, NEXT] + 2 + more + stays


def costs_back(codes: np.ndarray, extra: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """[time + 1, n, 4]: least cost from each state before each row to the end, whose costs are ``ends`` [n, 4]."""
    back = np.empty((len(codes) + 1, *ends.shape), np.int64)
    back[-1] = _relaxed(ends)
    for t in range(len(codes) - 1, -1, -1):
        delete, keep, rerole = _choices(codes[t], extra[t], back[t + 1])
        best = np.minimum(delete, np.minimum(keep, rerole))
        back[t] = np.where((codes[t] == PAD)[:, None], back[t + 1], _relaxed(best))
    return back


def trace(codes: np.ndarray, extra: np.ndarray, ends: np.ndarray, back: np.ndarray, state: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edits of least letters: letters and states after them, [time + 1, n, 3] (two insertions, then the row), and the last state.

    At each row the least letter that keeps to the least cost is taken: what
    follows a letter is the same for all ways to it, so this is the least audit.
    """
    size, n = codes.shape
    letters, states = np.zeros((size + 1, n, 3), np.uint8), np.zeros((size + 1, n, 3), np.uint8)
    each = np.arange(n)
    for t in range(size + 1):
        if t < size:
            delete, keep, _ = _choices(codes[t], extra[t], back[t + 1])
            here, stop = codes[t] != PAD, delete
        else:
            here, stop = np.full(n, last), ends
        for slot in range(2):
            now = back[t][each, state]
            put = here & (now != stop[each, state]) & (now == 2 + back[t][each, NEXT[state]])
            state = np.where(put, NEXT[state], state)
            letters[t, put, slot], states[t, put, slot] = INSERT, state[put]
        if t < size:
            now = back[t][each, state]
            letter = np.where(now == delete[each, state], DELETE, np.where(now == keep[each, state], KEEP, REROLE))
            after = np.where(letter == DELETE, state, np.where(letter == KEEP, KEPT[codes[t] & 3, state], NEXT[state]))
            state = np.where(here, after, state)
            letters[t, here, 2], states[t, here, 2] = letter[here], state[here]
    return letters, states, state


def written_out(piece: Piece, letters: np.ndarray, states: np.ndarray) -> tuple[str, list[str]]:
    """Audit and repaired turns of one piece, from its letters and states [time + 1, 3]."""
    audit, turns = [], []
    size = len(piece)
    for t, slot in np.argwhere(letters[: size + 1]):
        letter = letters[t, slot]
        audit.append(chr(letter))
        if letter == KEEP:
            turns.append(f"{piece.roles[t]}:{piece.texts[t]}")
        elif letter != DELETE:
            turns.append(f"{'user' if states[t, slot] == USER else 'assistant'}:{piece.texts[t] if letter == REROLE else ''}")
        if slot == 2 and piece.copies[t] > 1:
            audit.append("D" * (piece.copies[t] - 1))
    return "".join(audit), turns


def repaired(pieces: list[Piece], digest: bool) -> Iterator[tuple]:
    """Results of whole conversations, in tensors of like length."""
    buckets: dict[int, list[Piece]] = {}
    for p in pieces:
        buckets.setdefault(len(p).bit_length(), []).append(p)
    for bits, members in buckets.items():
        wide = max(1, CELLS >> bits)
        for lo in range(0, len(members), wide):
            group = members[lo : lo + wide]
            codes = np.full((max(map(len, group)), len(group)), PAD, np.int64)
            extra = np.zeros_like(codes)
            tallies = [Tally() for _ in group]
            for i, (p, tally) in enumerate(zip(group, tallies, strict=True)):
                codes[: len(p), i], extra[: len(p), i] = tally.read(p, firsts(p))
            ends = np.tile(ENDS, (len(group), 1))
            back = costs_back(codes, extra, ends)
            letters, states, _ = trace(codes, extra, ends, back, np.zeros(len(group), np.int64), True)
            # Insertions after the last turn are traced behind the padding; they belong behind the conversation's own rows.
            for i, (p, x) in enumerate(zip(group, tallies, strict=True)):
                rows = [*range(len(p)), len(codes)]
                audit, turns = written_out(p, letters[rows, i], states[rows, i])
                text = "\n".join(turns)
                yield p.conv_id, x.gaps(), x.blank, x.duplicate, x.truncated, x.illegal, int(back[0, i, NOTHING]), audit, hashlib.sha256(text.encode()).hexdigest() if digest else text


def _batch(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _arrow(*, pieces: bool) -> pa.Schema:
    whole = [(c, pa.string() if c in ("audit", "repaired") else pa.int64()) for c in FIELDS]
    lists = [("part", pa.int32()), ("piece", pa.int32()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("copies", pa.list_(pa.int64()))]
    return pa.schema([*lists, *whole] if pieces else whole)


def _cut(digest: bool, rows_limit: int, chars_limit: int):
    """Worker over sorted rows: results of conversations that lie in this task whole, and pieces of the others."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, part = _arrow(pieces=True), TaskContext.get().partitionId()
        number, edge, current, waiting, chars = 0, True, None, [], 0

        def piece_row(p: Piece) -> pa.RecordBatch:
            return _batch(schema, [{"part": part, "piece": number, "conv_id": p.conv_id, "turns": p.turns, "roles": p.roles, "texts": p.texts, "copies": p.copies}])

        for rows in batches:
            for conv_id, turn, role, text, copies in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if current is None or conv_id != current.conv_id:
                    if current is not None and edge:  # the first of the task, or cut before
                        yield piece_row(current)
                        number += 1
                    elif current is not None:
                        waiting.append(current)
                        chars += current.chars + 64 * len(current)
                        if chars > WAITING_CHARS:
                            yield _batch(schema, [dict(zip(FIELDS, x, strict=True)) for x in repaired(waiting, digest)])
                            waiting, chars = [], 0
                    current, edge = Piece(conv_id), current is None
                elif len(current) >= rows_limit or current.chars >= chars_limit:
                    yield piece_row(current)
                    number += 1
                    current, edge = Piece(conv_id), True
                if copies:
                    current.add(turn, role, text, copies)
        if waiting:
            yield _batch(schema, [dict(zip(FIELDS, x, strict=True)) for x in repaired(waiting, digest)])
        if current is not None:
            yield piece_row(current)

    return work


def _pieces(rows: pa.RecordBatch) -> Iterator[tuple[dict, Piece]]:
    for x in rows.to_pylist():
        p = Piece(x["conv_id"])
        p.turns, p.roles, p.texts, p.copies = x["turns"], x["roles"], x["texts"], x["copies"]
        yield x, p


def _new_rows(x: dict, p: Piece) -> list[bool]:
    known = set(x["firsts"] or ())
    return [i in known for i in range(len(p))]


MATRIX = "conv_id long, part int, piece int, matrix array<long>"


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Worker: cost from each state (last index) to each state after a piece."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int32()), ("matrix", pa.list_(pa.int64()))])
    for rows in batches:
        out = []
        for x, p in _pieces(rows):
            codes, extra = (np.repeat(a[:, None], 4, axis=1) for a in Tally().read(p, _new_rows(x, p)))
            back = costs_back(codes, extra, np.where(np.eye(4, dtype=bool), 0, FAR))
            out.append({k: x[k] for k in ("conv_id", "part", "piece")} | {"matrix": back[0].ravel().tolist()})
        yield _batch(schema, out)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Worker over pieces from the last to the first: costs at the end of each, and whether it is its conversation's last."""
    schema = pa.schema([("part", pa.int32()), ("piece", pa.int32()), ("ends", pa.list_(pa.int64())), ("last", pa.bool_())])
    started, conv_id, ends = False, None, ENDS
    for rows in batches:
        out = []
        for x in rows.to_pylist():
            last = not started or x["conv_id"] != conv_id
            started, conv_id, ends = True, x["conv_id"], ENDS if last else ends
            out.append({"part": x["part"], "piece": x["piece"], "ends": ends.tolist(), "last": last})
            ends = (np.array(x["matrix"]).reshape(4, 4) + ends[:, None]).min(axis=0)
        yield _batch(schema, out)


def _joined(digest: bool):
    """Worker over the pieces of conversations in order: traces each from the state that the one before has left."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(pieces=False)
        begin = True
        for rows in batches:
            for x, p in _pieces(rows):
                if begin:
                    tally, state, audits, texts, some, cost = Tally(), np.zeros(1, np.int64), [], [], False, None
                    hashed = hashlib.sha256()
                codes, extra = (a[:, None] for a in tally.read(p, _new_rows(x, p)))
                ends = np.array(x["ends"])[None, :]
                back = costs_back(codes, extra, ends)
                cost = int(back[0, 0, NOTHING]) if begin else cost
                letters, states, state = trace(codes, extra, ends, back, state, x["last"])
                audit, turns = written_out(p, letters[:, 0], states[:, 0])
                audits.append(audit)
                if turns:
                    text = ("\n" if some else "") + "\n".join(turns)
                    hashed.update(text.encode())
                    texts += [] if digest else [text]
                    some = True
                begin = x["last"]
                if begin:
                    values = (p.conv_id, tally.gaps(), tally.blank, tally.duplicate, tally.truncated, tally.illegal, cost, "".join(audits), hashed.hexdigest() if digest else "".join(texts))
                    yield _batch(schema, [dict(zip(FIELDS, values, strict=True))])

    return work


def repair(turns: DataFrame, digest: bool = False, piece_rows: int = PIECE_ROWS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """The cheapest repair of each conversation of ``turns`` (conv_id, turn, role, text and, if there, copies).

    Rows stand by turn (nulls first), then role and text. The first that holds
    counts: a row is blank (nothing but white space), a duplicate (its role and
    text were there before in the conversation) or truncated (it ends without
    full stop, exclamation or question mark). Keeping costs 0, a new role 2,
    deleting 3, inserting an empty turn 2; blank and duplicate rows must go; a
    truncated row that stays costs 1 more. Initials of the roles that remain
    must read ``(s?(ua)+)?``; a role without an initial can't be kept.

    Returns for each conv_id (null is one, too): gaps in turn numbers, the
    three counts, ``illegal`` neighbours before the repair, ``cost``, ``audit``
    (initials of the edits in order, least of the cheapest) and ``repaired``:
    its turns as ``role:text``, one on each line (with ``digest`` their SHA-256
    in lower-case hex). Nulls in role and text count as one space. Equal rows
    are so many ``copies``; a row with 0 copies only names its conversation.
    Other columns aren't read.
    """
    spark = turns.sparkSession
    base = shared_dir(spark)
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    copies = F.col("copies").cast("long") if "copies" in turns.columns else F.lit(1).cast("long")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled("role"), filled("text"), copies.alias("copies"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    # Long texts would make long bounds of ranges; rows that agree in a prefix stay together.
    dealt = rows.repartitionByRange("conv_id", "turn", F.substring("role", 1, 32), F.substring("text", 1, 32))
    ordered = dealt.sortWithinPartitions("conv_id", "turn", "role", "text")
    with lean_shuffles(spark):
        cut = materialise(ordered.mapInArrow(_cut(digest, piece_rows, piece_chars), PIECES), base, "cut")
        pieces = cut.where("part is not null").select("conv_id", "part", "piece", "turns", "roles", "texts", "copies")
        each = pieces.select("conv_id", "part", "piece", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "row"))
        shown = F.sha2(F.concat(F.length("row.roles").cast("string"), F.lit(":"), "row.roles", "row.texts"), 256)
        earliest = each.groupBy("conv_id", shown.alias("shown")).agg(F.min(F.struct("part", "piece", "at")).alias("first"))
        new = earliest.groupBy("first.part", "first.piece").agg(F.collect_list("first.at").alias("firsts"))
        known = materialise(pieces.join(new, ["part", "piece"], "left"), base, "pieces")
        matrices = known.select("conv_id", "part", "piece", "turns", "roles", "texts", "copies", "firsts").mapInArrow(_matrices, MATRIX)
        from_end = matrices.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("piece"))
        ends = materialise(from_end.mapInArrow(_chained, "part int, piece int, ends array<long>, last boolean"), base, "ends")
    rest = known.join(ends, ["part", "piece"]).repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return cut.where("part is null").select(*FIELDS).unionByName(rest.mapInArrow(_joined(digest), RESULT))


def op11(spark, sf_dir: str) -> DataFrame:
    """All ``conversations``, damaged and repaired."""
    return repair(damage(table(spark, sf_dir, "conversations")), digest=True).withColumnRenamed("repaired", "repaired_sha256")


OP11_SQL = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_reduce(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
           lambda c, ch: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda d, i: xor(d >> 1, 3988292384 * (d & 1)), xor(c, CAST(ascii(ch) AS BIGINT))), CAST(4294967295 AS BIGINT)) AS crc
  FROM conversations),
f AS (SELECT *, xor(crc, 4294967295) % 20 AS fault FROM k),
d AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE fault WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM f),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final, left(role, 1) AS c
  FROM d),
w AS (
  SELECT *, CASE WHEN final = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM n),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS size
  FROM w GROUP BY conv_id),
ins(s, u, more, letters, lines) AS (VALUES
  (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
  (0, 2, 2, 'I', chr(10) || 'user:'), (1, 2, 2, 'I', chr(10) || 'user:'), (2, 3, 2, 'I', chr(10) || 'assistant:'), (3, 2, 2, 'I', chr(10) || 'user:'),
  (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
ops(u, letter, c, v, more) AS (VALUES
  (0, 'D', NULL, 0, 3), (1, 'D', NULL, 1, 3), (2, 'D', NULL, 2, 3), (3, 'D', NULL, 3, 3),
  (0, 'R', NULL, 2, 2), (1, 'R', NULL, 2, 2), (2, 'R', NULL, 3, 2), (3, 'R', NULL, 2, 2),
  (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0)),
dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, {'cost': CAST(0 AS BIGINT), 'audit': '', 'rep': ''} AS x FROM counts
  UNION ALL
  SELECT dp.conv_id, dp.i + 1, ops.v,
         min({'cost': x.cost + ins.more + ops.more + CASE WHEN w.fault = 'truncated' AND ops.letter <> 'D' THEN 1 ELSE 0 END, 'audit': x.audit || ins.letters || ops.letter,
              'rep': x.rep || ins.lines || CASE ops.letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || w.role || ':' || w.text ELSE chr(10) || CASE ops.v WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || w.text END})
  FROM dp JOIN w ON w.conv_id IS NOT DISTINCT FROM dp.conv_id AND w.i = dp.i + 1 JOIN ins ON ins.s = dp.s
    JOIN ops ON ops.u = ins.u AND (ops.letter = 'D' OR (coalesce(w.fault, '') NOT IN ('blank', 'duplicate') AND (ops.letter = 'R' OR ops.c = w.c)))
  GROUP BY ALL),
best AS (
  SELECT dp.conv_id, min({'cost': x.cost + ins.more, 'audit': x.audit || ins.letters, 'rep': x.rep || ins.lines}) AS x
  FROM dp JOIN counts ON counts.conv_id IS NOT DISTINCT FROM dp.conv_id AND counts.size = dp.i JOIN ins ON ins.s = dp.s AND ins.u IN (0, 3) GROUP BY ALL)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(x.cost, 0) AS cost, coalesce(x.audit, '') AS audit, sha256(coalesce(substr(x.rep, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
"""
