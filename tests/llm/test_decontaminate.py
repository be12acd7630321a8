"""The positional index against a plain window search."""

from __future__ import annotations

import random

from tests.llm import brute
from tidemark.llm import decontaminate as dc
from tidemark.llm.common import shared_dir

WORDS = "alpha Beta gamma ümlaut x1 the of 日本 and".split()


def corpus(seed: int, n: int = 120):
    rng = random.Random(seed)
    items = [("a", " ".join(rng.choice(WORDS) for _ in range(25))), ("b", "Beta, gamma! beta"), ("c", None), ("d", "--"), ("a", "x1 x1 x1 the of"), (None, "of")]
    docs = [(1, None), (2, ""), (3, " ... "), (4, "word " * 30_000)]
    for k in range(n):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.4:
            w = items[0][1].split()
            a = rng.randint(0, 18)
            text += " . " + "-".join(w[a : a + rng.randint(5, 15)]).upper().replace("ÜMLAUT", "ümlaut") + " " + text
        docs.append((10 + k, text))
    return [*docs, docs[-1], (None, docs[-1][1])], items


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n_words string"), spark.createDataFrame(items, "item_id string, text string")


def check(spark, found, docs, items):
    known = [x for x in items if x[0] is not None]
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found.collect()), key=repr)
    assert got == sorted(((i, *brute.decontaminated(t, known)) for i, t in docs), key=repr)


def test_windows_and_items(spark):
    docs, items = corpus(1)
    d, b = frames(spark, docs, items)
    index = dc.build_index(d, shared_dir(spark), block_words=300)
    check(spark, dc.search_index(index, b), docs, items)
    check(spark, dc.search_index(index, b, block_words=3), docs, items)  # several blocks of tests


def test_proximity(spark):
    d, b = frames(spark, [(1, "one two three x four five"), (2, "two one three four five"), (3, "one two"), (4, "one three two")], [("t", "one two three four")])
    index = dc.build_index(d, shared_dir(spark))
    near = {r.doc_id: r["items"] for r in dc.search_index(index, b, slop=1).collect()}
    assert near == {1: ["t"], 2: ["t"], 3: [], 4: []}
    assert all(not r["items"] for r in dc.search_index(index, b).collect())


def test_clean_rows_stay_whole(spark):
    docs, items = corpus(2)
    d, b = frames(spark, docs, items)
    known = [x for x in items if x[0] is not None]
    clean = dc.drop_contaminated(d, b)
    assert clean.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=repr) == sorted((x for x in docs if not brute.decontaminated(x[1], known)[1]), key=repr)
    assert dc.drop_contaminated(d.limit(0), b).count() == 0
    assert dc.drop_contaminated(d, b.limit(0)).count() == d.count()


def test_stored_blocks_lie_in_small_row_groups(spark):
    """A reader decodes a whole row group at once, so a task's blocks may not all be in one."""
    import glob

    import pyarrow.parquet as pq

    rng = random.Random(5)
    docs = [(k, " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(20_000))) for k in range(150)]
    index = dc.build_index(frames(spark, docs, [("a", "x")])[0].coalesce(1), shared_dir(spark), block_words=100_000)
    files = [f for path in index.inputFiles() for f in glob.glob(path.removeprefix("file://"))]
    groups = [pq.ParquetFile(f).metadata.row_group(k) for f in files for k in range(pq.ParquetFile(f).num_row_groups)]
    assert sum(g.num_rows for g in groups) == index.count() == 30
    assert max(g.total_byte_size for g in groups) < 24 << 20
