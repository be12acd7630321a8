"""Exact top-k against a full scan."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import topk

ROWS = "vec_id long, vector array<float>"


def plain(rows, queries, k):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(1024 * x) for x in v]

    kept = [(i, w) for i, v in rows if i is not None and (w := whole(v)) is not None]
    out = []
    for q, own in {(i, tuple(w)) for i, v in queries if i is not None and (w := whole(v)) is not None}:
        found = sorted((-sum(a * b for a, b in zip(own, w, strict=False)), i) for i, w in kept if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def frames(spark, rows, queries):
    v = spark.createDataFrame(rows, ROWS).withColumn("ring", F.lit("x")).withColumn("q", F.lit(1))
    return v, spark.createDataFrame(queries, ROWS).withColumnRenamed("vec_id", "query_id").withColumn("least", F.lit(0))


def test_clusters_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    r = random.Random(3)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + r.gauss(0, 0.1) for c in r.choice(centres)]) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)]  # one very common vector
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (2004, []), (2005, [1.0, 2.0]), (None, centres[0]), rows[5], (2006, [0.0] * 6), (2007, [9.0] * 7)]
    queries = [x for x in rows if x[0] is not None and x[0] % 50 == 0] + [rows[0], (7, [0.0] * 6), (7, [1.0] * 6), (8, []), (9, None)]
    v, q = frames(spark, rows, queries)
    float32 = [(i, x) for i, x in ((row.vec_id, row.vector) for row in v.collect())]
    asked = [(row.query_id, row.vector) for row in q.collect()]
    assert got(topk.search(v, q, 10, pivots=8, rings=4, sample_rows=200)) == plain(float32, asked, 10)


def test_rings_are_left_out_and_results_stay(spark, monkeypatch):
    """Far clusters are never met; a bad fit changes nothing but the work."""
    r = random.Random(5)
    rows = [(i, [100.0 * (i % 4 == 0) + r.random(), 100.0 * (i % 4 == 1) + r.random(), 100.0 * (i % 4 == 2) + r.random()]) for i in range(400)]
    v, q = frames(spark, rows, rows[:40])
    want = plain([(x.vec_id, x.vector) for x in v.collect()], [(x.query_id, x.vector) for x in q.collect()], 5)
    for pivots, sample in ((4, 400), (1, 1), (16, 20)):
        assert got(topk.search(v, q, 5, pivots=pivots, rings=2, sample_rows=sample)) == want


@pytest.mark.parametrize("size", [1.0, 3e4, 2e5])
def test_large_components(spark, size):
    r = random.Random(int(size))
    rows = [(i, [float(round(r.uniform(-size, size))) for _ in range(3)]) for i in range(60)]
    v, q = frames(spark, rows, rows[:6])
    want = plain([(x.vec_id, x.vector) for x in v.collect()], [(x.query_id, x.vector) for x in q.collect()], 4)
    assert got(topk.search(v, q, 4, pivots=3, rings=2)) == want


def test_few_and_no_candidates(spark):
    v, q = frames(spark, [(1, [1.0]), (2, [2.0])], [(1, [1.0]), (5, [3.0])])
    assert got(topk.search(v, q, 10)) == [(1, 1, 2, 2048 * 1024), (5, 1, 2, 2048 * 3072), (5, 2, 1, 1024 * 3072)]
    empty, none = frames(spark, [], [])
    assert topk.search(empty, q, 10).collect() == [] and topk.search(v, none, 10).collect() == []


def test_scores_beyond_64_bits_are_the_largest():
    v = np.array([[1 << 40, 1 << 40], [-(1 << 40), -(1 << 40)], [3, -5]])
    space = topk.Space(2, "<i8", "wide", 2.0**41, np.zeros((1, 3)), np.zeros((1, 1)))
    assert space.scores(v, v).tolist() == [[2**63 - 1, -(2**63), -(2**41)], [-(2**63), 2**63 - 1, 2**41], [-(2**41), 2**41, 34]]
