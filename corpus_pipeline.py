"""The training corpus from start to end: filter, deduplicate, decontaminate, redact, mix.

Each stage reads what the one before it has written. SQL cannot express the
forest of the first stage or the field of the fourth, so there is no oracle;
``tests/llm/test_pipeline.py`` holds ``run`` against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, mixing, neardup, pii, quality
from tidemark.llm.common import materialise, shared_dir, table
from tidemark.session import ship


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and the forest accept."""
    ship(spark)
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of smallest id."""
    ship(spark)
    return neardup.drop_near_duplicates(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    ship(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    ship(spark)
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their source's rate says, numbered by ``copy``."""
    ship(spark)
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", keep_one_of_each_group),
    ("decontaminate", keep_uncontaminated),
    ("pii", redact),
    ("mix", mix),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, docs = shared_dir(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), base, name)
    return STAGES[-1][1](spark, docs, sf_dir)
