"""Token alignment against a plain walk over both token lists."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import align

TEXTS = [
    "The cat sat on the mat.", "Two  spaces and\ttabs \n and lines\n\nhere ", " leading", "trailing ", "ünïcödé 日本語 текст 🙂🙂", "<s> </s> <unk> <|endoftext|> a", "a▁b marked", "▁", " ", "  ", "\n",
    "don't we'll it's 'quoted'", "x" * 300, "\x00 nul \x1c sep", "no-break space ​ zero 　 wide", "é vs é", "1234567890 12,345.67", "\r\nwindows\r\n", "The cat sat on the mat.", None, "",
]


def plain(rows):
    """Per row: n_a, n_b, n_groups, n_links, n_best, count_sum, groups."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(align.TOKENIZER_A)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=align.TOKENIZER_B)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(x for x in range(256) if x not in shown)}
    bytes_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, counts = [], Counter()
    for _, text in rows:
        found.append(None)
        if not text:
            continue
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spelt = [bytes_a(i) for i in ids[0]], [bytes_b(i) for i in ids[1]]
        if any(b"".join(x) != (" " + text).encode() for x in spelt):
            continue
        owner = [[i for i, x in enumerate(part) for _ in x] for part in spelt]  # the token of each byte
        links = sorted(set(zip(*owner, strict=True)))
        ends = [{i for i in range(len(o)) if i + 1 == len(o) or o[i] != o[i + 1]} for o in owner]
        groups, start = [], 0
        for cut in sorted(ends[0] & ends[1]):
            groups.append("|".join(",".join(str(ids[k][t]) for t in sorted(set(owner[k][start : cut + 1]))) for k in (0, 1)))
            start = cut + 1
        pairs = [(ids[0][x], ids[1][y]) for x, y in links]
        counts.update(pairs)
        found[-1] = (len(ids[0]), len(ids[1]), len(groups), pairs, ";".join(groups))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(0,) * 6 + ("",) if f is None else (*f[:3], len(f[3]), sum(counts[p] == best[p[1]] for p in f[3]), sum(counts[p] for p in f[3]), f[4]) for f in found]


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit("x")).withColumn("groups", F.lit(1)).repartition(3)
    return sorted((tuple(r) for r in align.align(df, **more).collect()), key=repr)


@pytest.mark.parametrize("chunk_chars", [align.CHUNK_CHARS, 40])
def test_against_plain_walk(spark, chunk_chars):
    r = random.Random(1)
    words = ["alpha", "Beta,", "gamma.", "x1y2", "naïve", "…", "the", "the", "of", "\n"]
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join(r.choices(words, k=r.randint(1, 60)))) for i in range(40)] + [(None, "null id"), (3, "same id"), (0, TEXTS[0])]
    want = sorted(((i, *x) for (i, _), x in zip(rows, plain(rows), strict=True)), key=repr)
    assert run(spark, rows, chunk_chars=chunk_chars) == want
    hashed = sorted(((*x[:-1], hashlib.sha256(x[-1].encode()).hexdigest() if x[-1] else "") for x in want), key=repr)
    assert run(spark, rows, digest=True, chunk_chars=chunk_chars) == hashed


def test_cuts():
    assert align.segments("a b  c d") == ["a", "b  c", "d"]
    assert align.segments(" a") == [" a"] and align.segments("a ") == ["a "] and align.segments("a\n b c") == ["a\n b", "c"]
    assert align.segments("a​ b") == ["a​ b"]


def test_vocabulary_that_merges_across_spaces_is_refused():
    with pytest.raises(ValueError, match="space inside"):
        align._piece_sizes(["▁the", "of▁the"], [False, False])


def test_no_rows_and_no_texts(spark):
    assert run(spark, [])  == []
    assert run(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_long_text_without_spaces(spark):
    text = "".join(random.Random(2).choices("abcdefgh日本", k=30_000))
    assert run(spark, [(1, text)]) == [(1, *plain([(1, text)])[0])]


def worked(monkeypatch, work, columns):
    """What a worker makes of one batch of ``columns``."""
    monkeypatch.setattr(align, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    return list(work(iter([pa.record_batch(list(columns.values()), names=list(columns))])))


def test_long_segments_leave_in_small_batches(monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choices("日本語文字列", k=5_000)) for _ in range(2000)]
    split = worked(monkeypatch, align._split(align.TOKENIZER_B, align.CHUNK_CHARS), {"doc_id": list(range(2000)), "text": texts})
    assert max(x.nbytes for x in split) < 17 << 20
    assert [x for b in split for x in b.column("segment").to_pylist() if x] == texts
    rows = {"segment": texts[:200] + ["short", texts[0] * 60, "last"], "n": list(range(203))}
    encoded = worked(monkeypatch, align._encode(align.TOKENIZER_A, align.TOKENIZER_B), rows)
    assert max(x.nbytes for x in encoded) < 17 << 20
    assert [(x["segment"], x["n"], x["w"]) for b in encoded for x in b.to_pylist()] == [*zip(rows["segment"], rows["n"], range(203), strict=True)]


def test_chunk_ends_after_a_million_segments(monkeypatch):
    texts = [" ".join(map(str, range(i, i + 100_000))) for i in range(0, 1_500_000, 100_000)]
    split = worked(monkeypatch, align._split(align.TOKENIZER_B, align.CHUNK_CHARS), {"doc_id": list(range(15)), "text": texts})
    keys = [k for b in split for k, x in zip(b.column("key").to_pylist(), b.column("segment").to_pylist(), strict=True) if x]
    assert sorted(Counter(k >> align.PLACE_BITS for k in keys).values()) == [500_000, 1_000_000]
