"""Preference pairs, line dedup and source mixing."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark.llm import chat, linededup, mixing

TURNS = "conv_id long, turn int, role string, text string, side string"


def test_preference_pairs(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "good"), (0, 2, "user", "thanks"), (1, 0, "user", "hi"), (1, 1, "assistant", "bad"),
        (2, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "user", "alone"), (6, 0, "user", "q"), (6, 0, "user", "q"), (7, 0, "user", "q"),
        (8, 0, None, None), (8, None, "assistant", "z"), (9, 0, None, None), (9, None, "assistant", "z"), (None, 0, "user", "x"),
    ]
    out = chat.preference_turns(spark.createDataFrame([(*r, "mine") for r in rows], TURNS), chat.by_parity)
    got = {}
    for r in out.collect():
        got.setdefault((r.pair_id, r.part), []).append((r.turn, r.role, r.copies, r.trained))
    assert got[0, "prompt"] == [(0, "user", 1, False)] and sorted(got[0, "chosen"]) == [(1, "assistant", 1, True), (2, "user", 1, False)] and got[0, "rejected"] == [(1, "assistant", 1, True)]
    assert got[1, "prompt"] == [(0, "user", 1, False)] and (1, "chosen") not in got
    assert not [k for k in got if k[0] == 2]  # conversation 4 has no counterpart
    assert got[3, "chosen"] == [(0, "user", 2, False)] and got[3, "rejected"] == [(0, "user", 1, False)]
    assert got[4, "prompt"] == [(0, None, 1, False)] and got[4, "chosen"] == got[4, "rejected"] == [(None, "assistant", 1, True)]
    row = {r.pair_id: r for r in chat.assemble(out).collect()}[0]
    assert row.prompt == "<|user|>\nhi<|end|>\n" and row.chosen.startswith("<|assistant|>\ngood<|end|>\n")
    a, b = row.chosen_mask[0]
    assert row.chosen[a:b] == "<|assistant|>\ngood<|end|>\n" and len(row.chosen_mask) == 1
    pairs = {r.pair_id: r for r in chat.assemble(out).collect()}
    assert set(pairs) == {0, 1, 3, 4} and pairs[1].chosen == "" and not pairs[1].chosen_mask  # all of 1 is common
    for r in out.collect():
        whole = pairs[r.pair_id][r.part]
        assert whole[r.start : r.end] == r.rendered * r.copies
    long = [(k, t, "assistant" if t % 2 else "user", f"turn {t}" if t < 3000 else f"{k} says {t}") for k in (0, 1) for t in range(3100)]
    r = chat.assemble(chat.preference_turns(spark.createDataFrame([(*x, "z") for x in long], TURNS), chat.by_parity)).first()
    assert r.prompt.count("<|end|>") == 3000 and r.chosen.count("0 says") == 100 and len(r.rejected_mask) == 50
    assert all(r.rejected[a:b].startswith("<|assistant|>\n1 says") for a, b in r.rejected_mask)
    assert chat.preference_turns(out.sparkSession.createDataFrame([], TURNS), chat.by_parity).count() == 0


def pieces(text):
    """(start, end, words) of lines and sentences, found character by character."""
    out, at = [], 0
    for k, c in enumerate(text + "\n"):
        if c == "\n" or c == " " and k and text[k - 1] in ".!?":
            words = "".join(x.lower() if x.isascii() else x for x in text[at:k]).split()
            if words:
                out.append((at, k, tuple(words)))
            at = k + 1
    return out


def plain_passages(rows, least=35):
    """doc_id to (the spans that go, the units within passages), from (doc_id, text)."""
    units = {i: pieces(text or "") for i, text in rows}
    every = [w for us in units.values() for *_, w in us]
    again = {w for w in set(every) if every.count(w) > 1}
    marked, seen = {}, set()
    for i in sorted(units):
        marked[i], k = [], 0
        while k < len(units[i]):
            j = k
            while j < len(units[i]) and units[i][j][2] in again:
                j += 1
            if sum(len(w) for *_, w in units[i][k:j]) >= least:
                marked[i] += units[i][k:j]
            k = max(j, k + 1)
    out = {}
    for i in sorted(units):
        out[i] = ([], len(marked[i]))
        for a, b, w in marked[i]:
            if w in seen:
                out[i][0].append((a, b))
            seen.add(w)
    return out


def test_line_dedup(spark):
    rng = random.Random(2)
    short = ["the quick brown fox jumps", "The  quick brown\tfox jumps", "one two", "", "é b c d e 日本", "End. x y. z!", "ok."]
    long = [" ".join(f"w{k}x{j}" for j in range(9)) + "." for k in range(12)]
    rows = [(1, None), (2, ""), (3, "w " * 50_000)]
    for k in range(10, 60):
        lines = [rng.choice(short) for _ in range(rng.randint(0, 6))]
        at = rng.randrange(8)
        lines[len(lines) // 2 : 0] = [(" " if k % 2 else "\n").join(long[at : at + rng.randint(2, 5)]), f"own line of {k}"]
        rows.append((k, "\n".join(lines)))
    docs = spark.createDataFrame([(*r, "z", 5) for r in rows], "doc_id long, text string, digest string, words int")
    want = plain_passages(rows)
    assert sum(len(w[0]) for w in want.values()) > 50 and any(w[1] > len(w[0]) for w in want.values())
    got = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    text = dict(rows)
    for k, r in got.items():
        assert ([(a, b) for a, b in r._removed], r._repeated) == want[k]
        kept = text[k]
        for a, b in reversed(want[k][0]):
            kept = kept[:a] + kept[b + 1 :]
        assert r.text == kept and r.digest == "z" and r.words == 5 and (r._first_id is None) == (not r._repeated)
    # digests on both sides of the broadcast bound give the same
    few = {r.doc_id: r._removed for r in linededup.dedup_lines(docs, linededup.LineConfig(hot_digests=3)).collect()}
    assert few == {k: r._removed for k, r in got.items()}
    twice = docs.where("doc_id = 10").unionByName(docs.where("doc_id = 10")).unionByName(docs.where("doc_id = 10").withColumn("doc_id", F.lit(None).cast("long")))
    plain = plain_passages([(10, text[10]), (11, text[10])])  # a null id ranks after 10
    for r in linededup.dedup_lines(twice).collect():
        assert ([(a, b) for a, b in r._removed], r._repeated) == plain[10 if r.doc_id else 11] and r._first_id == 10
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_passages_are_caught_and_other_texts_left_alone(spark, sf_dir):
    """Documents that share a run of 50 words with another one, found word by word."""
    import __spark_entry__

    texts = {r.doc_id: (r.text or "").lower().split() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    holders: dict = {}
    for i, w in texts.items():
        for k in range(len(w) - 49):
            holders.setdefault(tuple(w[k : k + 50]), set()).add(i)
    shared = set().union(*(s for s in holders.values() if len(s) > 1))
    marked = {r.doc_id for r in __spark_entry__.queries()["op9_line_dedup"](spark, sf_dir).where("n_repeated > 0").collect()}
    clean = set(texts) - shared
    assert shared and len(clean - marked) >= 0.9 * len(clean)
    assert len(shared & marked) >= 0.85 * len(shared)  # 4 of 38 share what lies between two edits of a copy, across units


def test_targets_fill_like_water(spark):
    words = {"a": 1000, "b": 100, "c": 10, None: 50, "": 0}
    docs = [(k, " ".join("w" for _ in range(n // 10)), s, "t") for s, n in words.items() for k in range(10)]
    df = spark.createDataFrame([(i, *d[1:]) for i, d in enumerate(docs)], "doc_id long, text string, source string, target string")
    rows = mixing.mix_rates(df).collect()
    target = {r.source: r._target for r in rows}
    size = {s: n // 10 * 10 for s, n in words.items()}
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 and all(target[s] <= 2 * size[s] for s in size)
    assert target["b"] == 200 and target["c"] == 20 and target[None] == 100 and target[""] == 0
    assert {r.doc_id: r._copies for r in rows} == {r.doc_id: r._copies for r in mixing.mix_rates(df.repartition(5)).collect()}
    assert all(0 <= r._copies <= 2 for r in rows)
    assert mixing.mix(df).count() == sum(r._copies for r in rows) and mixing.mix(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None, None), (None, "a b", None), (None, "a b", None)], "doc_id long, text string, source string")
    assert len({r._copies for r in mixing.mix_rates(nulls).where("text is not null").collect()}) == 1


def test_taken_comes_near_the_target(spark):
    rng = random.Random(9)
    docs = [(k, " ".join("w" for _ in range(rng.randint(1, 60))), f"s{k % 4}" if k % 3 else "hot") for k in range(6000)]
    rows = mixing.mix_rates(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r._copies * r._size for r in own) / own[0]._target - 1) < 0.06


def test_ranks_run_on_over_ranges(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(mixing, "RANK_ROWS", 2)
    names = ["b", "a", "é", "Z", "", "10", "9", "zz", None]
    sizes = spark.createDataFrame([(n, 5) for n in names], "source string, source_size long")
    got = {r.source: r["rank"] for r in mixing._ranked(sizes, f"file://{tmp_path}").collect()}
    assert got == {n: k for k, n in enumerate([*sorted(n for n in names if n is not None), None])}
