"""Columns of a table that are named like an operator's own: nothing breaks, nothing is overwritten."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidemark.llm import entry, linededup

#: Names that operators use for themselves, and some in other case.
NAMES = (
    "_size", "_SOURCE_size", "_target", "_copies", "_source", "_id", "_th", "_i", "_t", "spans", "repeated", "first_id", "_removed", "_repeated", "_first_id", "_gone_id", "_gone_th", "_gone_key",
    "_pii", "_stats", "anomaly", "base_failed", "_kept", "rank", "digest", "n", "key", "flat", "items", "component_id", "kept", "node", "comp", "least", "most", "chunk", "place", "segment", "groups",
    "w", "ring", "cell", "away", "vector", "query_id", "copies", "_block", "part", "piece", "at", "u", "start", "end", "words", "th", "step", "pair_id", "side", "copy_", "_aside_0", "record", "host",
)
TABLES = ("documents", "pages", "benchmark", "labels", "conversations", "embeddings")


@pytest.fixture(scope="module")
def dirs(spark, sf_dir, tmp_path_factory):
    """The same rows with their own columns only, and with all the names."""
    plain, crowded = (str(tmp_path_factory.mktemp(n)) for n in ("plain", "crowded"))
    for t in TABLES:
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        df = df.limit(60).coalesce(1) if t in ("documents", "pages") else df
        df.write.parquet(f"{plain}/{t}.parquet")
        rows = spark.read.parquet(f"{plain}/{t}.parquet")
        rows.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES if n.lower() not in df.columns]).write.parquet(f"{crowded}/{t}.parquet")
    return plain, crowded


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_queries_give_the_same(spark, dirs, name):
    import __spark_entry__

    query = __spark_entry__.queries()[name]
    plain, crowded = (sorted(map(str, query(spark, d).collect())) for d in dirs)
    assert plain == crowded


def test_pipeline_keeps_all_columns(spark, dirs):
    rows = corpus_pipeline.run(spark, dirs[1])
    docs = spark.read.parquet(f"{dirs[1]}/documents.parquet")
    assert rows.columns == [*docs.columns, "copy"]
    found = rows.collect()
    assert found and all(r[n] == f"own {n}" for r in found for n in NAMES if n in docs.columns)
    assert sorted((r.doc_id, r.text, r.copy) for r in found) == sorted((r.doc_id, r.text, r.copy) for r in corpus_pipeline.run(spark, dirs[0]).collect())


def test_lines_of_repeated_rows_are_not_repeated_lines(spark):
    long = " ".join(f"w{i}" for i in range(60)) + "."
    texts = {3: "One text here.\nsee page nine", 5: "Quite another one.\nsee page nine", 7: "Nothing like it.", 8: long, 9: f"Before.\n{long}"}
    rows = [(k, t) for k, t in texts.items()] + [(k, texts[k]) for k in (3, 5, 7, 7, 8)]
    got = {}
    for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add((r.text, len(r._removed), r._repeated))
    assert got[3] == {(texts[3], 0, 0)} and got[5] == {(texts[5], 0, 0)} and got[7] == {(texts[7], 0, 0)}
    assert got[8] == {(long, 0, 1)} and got[9] == {("Before.\n", 1, 1)}


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (1, None, None, None, None), (None, "", None, None, None)]])
def test_pipeline_on_empty_and_null_rows(spark, sf_dir, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.collect() == []
