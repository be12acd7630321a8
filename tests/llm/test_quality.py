"""Rule statistics against a plain count; verdicts of the forest."""

from __future__ import annotations

import random

import __spark_entry__

from tests.llm import brute
from tidemark.llm import quality


def test_statistics(spark):
    rng = random.Random(4)
    bits = ["the", "a", "x", "é", "日本", "#", "a|b", "\n", "\n", " ", "\t", "\x0b", "\xa0", "same line here\n"]
    texts = [None, "", "\n\n", "a\n a\na"] + ["".join(rng.choice(bits) + rng.choice(("", " ")) for _ in range(rng.randint(1, 200))) for _ in range(200)]
    texts.append("ab cd ef " * 100_000)
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_words string")
    for r in quality.rule_statistics(docs).collect():
        want = brute.rule_counts(r.text)
        assert {c: r._stats[c] for c in want if c != "base_failed"} == {c: v for c, v in want.items() if c != "base_failed"}


def test_forest_parts_odd_rows(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "the an of in to re st".split() for b in "ing er ed ion ly es".split()]
    good = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 200))).capitalize() + "." for _ in range(400)]
    odd = [" ".join(rng.choice(words) + "###$$$" for _ in range(80)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(good + odd)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 200)] + [(400, 0, 0), (401, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r._kept for r in quality.quality_verdicts(docs, labels).collect()}
    assert sum(out[k] for k in range(400)) >= 396 and not any(out[k] for k in range(400, 420))
    again = {r.doc_id: r._kept for r in quality.quality_verdicts(docs.repartition(7), labels.repartition(5)).collect()}
    assert again == out


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (2, "one two"), (None, "w " * 60)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.quality_verdicts(docs, none).collect()
    assert [r._kept for r in out] == [False] * 4
    assert quality.filter_quality(docs.limit(0), none).count() == 0
    assert quality.filter_quality(docs, none).columns == docs.columns


def test_query_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = __spark_entry__.queries()["op10_quality_forest"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute.rule_counts(docs[r.doc_id])
        assert {k: r[k] for k in want} == want
        assert not (r.kept and r.base_failed)
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [r for r in rows if r.doc_id in labels and labels[r.doc_id].quality == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.97 * len(good)


def test_rows_labelled_bad_are_rejected(spark):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in "the an of in to re st".split() for b in "ing er ed ion ly es".split()]
    make = lambda mark: " ".join(rng.choice(words) + mark * (rng.random() < 0.3) for _ in range(100)) + "."
    texts = [make("") for _ in range(300)] + [make("$$$") for _ in range(20)] + ["a|b $$$ 9 " * 3 + make("###$$$***") for _ in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 300 or k >= 320), 0) for k in range(323)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r._kept for r in quality.quality_verdicts(docs, labels).collect()}
    assert sum(out[k] for k in range(300)) >= 270 and sum(not out[k] for k in range(300, 320)) >= 18


def test_cut_counts_every_labelled_row():
    cfg = quality.ForestConfig(bins=100)
    assert quality._cut([(30, 50_000, 0), (40, 10_000, 100), (60, 2, 900)], cfg) == 0.41
    assert quality._cut([(30, 999, 0), (50, 1, 0)], cfg) == 0.31 and quality._cut([(30, 0, 5)], cfg) is None


def test_labels_of_the_tables(spark):
    """Both rates on labelled documents that pass the base rule."""
    sf = "/root/testdata/sf0.01"
    out = __spark_entry__.queries()["op10_quality_forest"](spark, sf).where("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good, bad = ([r.kept for r in out if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.98 * len(good) and sum(not k for k in bad) >= 0.95 * len(bad) and len(bad) >= 20
