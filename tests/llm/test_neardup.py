"""Near-duplicate components against all pairs."""

from __future__ import annotations

import random

from tests.llm import brute
from tidemark.llm import neardup


def group(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(w))
            if rng.random() < 0.5:
                w[at] = f"w{rng.randint(0, 10**6)}"
            else:
                del w[at]
        out.append(" ".join(w))
    return out


def corpus(seed: int):
    rng = random.Random(seed)
    words = [f"v{k}" for k in range(500)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    texts: list[str | None] = [None, "", "  \n", "one two", "One  TWO", "two one", "a b c d e", "A B C D E", "same " * 5000]
    passage = make(40)
    for n, size, edits in ((60, 100, 2), (5, 60, 3), (12, 300, 12)):  # the first makes lists of over 32 classes
        texts += group(rng, make(size), n, edits)
    texts += [" ".join(passage + make(rng.choice((5, 10, 80)))) for _ in range(60)]
    texts += [" ".join(make(rng.randint(1, 40))) for _ in range(60)]
    texts += texts[-5:]
    rng.shuffle(texts)
    return list(enumerate(texts))


def cut_copies(rng):
    """Copies that make every value of a base hot, and some cut in one place."""
    base = [f"b{k}" for k in range(90)]
    short = base[:20] + base[36:]
    return group(rng, base, 60, 2) + [" ".join(short)] + group(rng, short, 6, 3)


def short_families():
    """Families whose first text has three shingles, all on lists of 41 classes."""
    texts = [" ".join(f"f{family}w{k}" for k in range(7)) for family in range(200)]
    odd = [t for t in texts if all(v % 2 for v in neardup.shingle_set(t.encode(), 5))]
    return [t for family, text in enumerate(odd[:4] + texts[:2]) for t in (text, *(f"{text} x{family}y{k}" for k in range(40)))]


def drift(rng, name, shared):
    """60 texts that make every value of a passage hot, and 40 that each lack five parts of it, of which few pairs are similar."""
    base, tail = [f"{name}p{k}" for k in range(600)], [f"{name}t{k}" for k in range(400)]
    texts = [" ".join(base + tail[:at] + [f"{name}e{at}"] + tail[at:]) for at in range(5, 365, 6)]
    for k in range(40):
        gone = {i for at in rng.sample(range(0, 578), 5) for i in range(at, at + 22)}
        texts.append(" ".join(f"{name}n{k // 2}" if shared and i == 597 - k // 2 else w for i, w in enumerate(base) if i not in gone))
    return texts


def sharers(rng):
    """Texts that share a passage but are mostly apart: few pairs may come up, and none be missed."""
    passage = [f"q{k}" for k in range(60)]
    texts = [" ".join(passage + [f"u{k}x{j}" for j in range(rng.randint(8, 40))]) for k in range(150)]
    return texts + group(rng, passage + [f"c{j}" for j in range(25)], 60, 2) + group(rng, [f"d{j}" for j in range(12)] + passage, 40, 3)


def test_components_match_all_pairs(spark):
    rng = random.Random(4)
    texts = [t for _, t in corpus(1)] + cut_copies(rng) + short_families() + drift(rng, "y", False) + drift(rng, "z", True) + sharers(rng)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, n string, digest long")
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    want = brute.components(rows)
    assert {k: r.component_id for k, r in got.items()} == want
    for k, t in rows:
        assert got[k].n_shingles == len(brute.shingles(t)) and got[k].kept == (want[k] == k)


def test_one_row_of_each_group_stays(spark):
    rows = corpus(3)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id int, text string, node string")
    want = brute.components(rows)
    out = neardup.drop_near_duplicates(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    assert sorted(r.doc_id for r in out.collect()) == sorted(k for k in want if want[k] == k)


def test_empty_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True)] * 2 + [(7, 7, True)] * 2


def test_long_chains_are_one_component(spark, tmp_path):
    rng = random.Random(3)
    links, at = [], 0
    for n in (200, 400, 1000, 3000):
        ids = list(range(at, at + n))
        rng.shuffle(ids)
        links += [(min(p), max(p)) for p in zip(ids, ids[1:])]  # noqa: B905
        at += n
    got = neardup.components(spark.createDataFrame(links, "a long, b long"), f"file://{tmp_path}", "c").collect()
    want = {k: low for low, high in ((0, 200), (200, 600), (600, 1600), (1600, 4600)) for k in range(low, high)}
    assert {r.node: r.comp for r in got} == want


def test_one_id_with_two_texts(spark):
    a, b = "a b c d e f g", "t u v w x y z"
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (9, b)], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert got == {(3, 3, 3, True), (5, 3, 3, False), (5, 3, 5, True), (9, 3, 5, False)}
    assert sorted(neardup.drop_near_duplicates(docs).collect()) == [(3, a), (5, b)]  # no text is lost
    linked = spark.createDataFrame([(3, a + " h i j"), (5, a + " h i k"), (5, b), (9, a + " h i j k")], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in neardup.near_duplicates(linked).collect()}
    assert got == {(3, 6): 3, (5, 6): 5, (5, 3): 5, (9, 7): 3}


def test_copies_cut_in_their_own_places_are_not_paired(spark, monkeypatch):
    """What the last pass compares must not grow with the square of a group of which many members are just too far apart."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(300)]

    def cut(n):  # n words away, no two within five words
        gone = {5 * i + at for i, at in enumerate(sorted(rng.sample(range(5, 240), n)), 1)}
        return " ".join(w for i, w in enumerate(base) if i not in gone)

    rows = list(enumerate([" ".join(base), *(cut(rng.randint(1, 3)) for _ in range(80)), *(cut(10) for _ in range(160))]))
    tables, write = {}, neardup.materialise
    monkeypatch.setattr(neardup, "materialise", lambda df, base, name, *more: tables.setdefault(name, write(df, base, name, *more)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.components(rows)
    assert len(set(got.values())) > 30
    assert tables["third"].count() < 3500  # 4632 by prefixes of full sets, 2377 by differences from a pivot
