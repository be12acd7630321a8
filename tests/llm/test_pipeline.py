"""The corpus pipeline: each stage against a plain version on its own input, and the whole run."""

from __future__ import annotations

import corpus_pipeline
import pytest

from tests.llm import brute
from tidemark.llm import mixing


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Input and output rows of each stage."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf_dir).persist()
        out[name] = (docs.collect(), got.collect(), docs.columns, got.columns)
        docs = got
    return out


def test_order_and_columns(stages):
    assert list(stages) == ["quality", "near_dedup", "decontaminate", "pii", "mix"]
    for before, _, cols, new in list(stages.values())[:-1]:
        assert new == cols and before


def test_quality_keeps_clean_and_drops_failed(stages, spark, sf_dir):
    before, after, *_ = stages["quality"]
    kept = {r.doc_id for r in after}
    failed = {r.doc_id for r in before if brute.rule_counts(r.text)["base_failed"]}
    assert failed and not failed & kept
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    clean = [r.doc_id for r in before if r.doc_id in good and r.doc_id not in failed]
    assert sum(k in kept for k in clean) >= 0.97 * len(clean)


def test_near_dedup_keeps_the_first_of_each_group(stages):
    before, after, *_ = stages["near_dedup"]
    comp = brute.components([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(i for i in comp if comp[i] == i)


def test_decontaminated(stages, spark, sf_dir):
    before, after, *_ = stages["decontaminate"]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in after}
    for r in before:
        assert (r.doc_id in kept) == (brute.decontaminated(r.text, items)[1] == 0)


def test_personal_data_is_gone(stages):
    before, after, *_ = stages["pii"]
    assert len(before) == len(after)
    assert any(brute.pii_base(r.text) for r in before) and not any(k == "email" for r in after for *_, k in brute.pii_base(r.text))


def test_mix_emits_the_counted_copies(stages, spark):
    before, after, cols, new = stages["mix"]
    want = {r.doc_id: r._copies for r in mixing.mix_rates(spark.createDataFrame(before)).collect()}
    got: dict = {}
    for r in after:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in want.items() if v} and new == [*cols, "copy"]


def test_run_equals_the_stages(stages, spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(map(str, rows)) == sorted(map(str, stages["mix"][1]))
