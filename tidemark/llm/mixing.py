"""Mixing sources to target weights: repetition rates per source, whole copies plus one Bernoulli copy.

DataFrame functions only. Tokens are summed per source; the targets fill up
like water: each source gets a share by weight, none more than ``cap`` times
its size, and what is cut off goes to the others by weight. A document is then
emitted floor(rate) times, plus once more if a hash of its id falls below the
fraction of the rate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BLANK_WORD, materialise, set_aside, shared_dir, table

#: Weights by rank of the source name, repeating.
WEIGHTS = (3, 1, 2)
SHARE, CAP, SEED = 1.5, 2.0, "mix-1"
#: The columns that rates add to documents.
RATES = ("_size", "_source_size", "_target", "_copies")
#: A table of at most so many sources is broadcast (some 100 bytes each); larger ones are joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Rows of the source table in one partition when names are ranked.
RANK_ROWS = 200_000


def count_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(BLANK_WORD)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame, base: str) -> DataFrame:
    """``sources`` (source, source_size) with ``rank`` from 0 by code point, null last.

    Range partitions are ranked each on its own and then shifted by the rows
    before them, so that no task needs all the names.
    """
    n = max(1, -(-sources.count() // RANK_ROWS))
    order = [F.col("source").isNull(), F.col("source")]
    parts = sources.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    parts = materialise(parts, base, "ranges")
    local = Window.partitionBy("part").orderBy(*order)
    parts = parts.withColumn("local_rank", F.row_number().over(local) - 1)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("shift"))  # one row for RANK_ROWS sources
    return parts.join(F.broadcast(shift), "part").select("source", "source_size", (F.col("local_rank") + F.col("shift")).alias("rank"))


def source_targets(sizes: DataFrame, base: str, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """From (source, source_size) to (source, source_size, target).

    The water level L solves sum(min(cap * size, L * weight)) = share * sum(size).
    Each pass takes the sources that the level so far would overfill as full and
    shares the rest anew; it ends when no more become full. Only sums reach the driver.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialise(_ranked(sizes, base).withColumn("weight", weight).withColumn("most", cap * F.col("source_size")), base, "ranked")
    total, level, full = None, 0.0, -1
    while True:
        over = F.col("most") <= level * F.col("weight")
        got = ranked.agg(
            F.sum("source_size").alias("size"), F.sum(F.when(over, F.col("most")).otherwise(0.0)).alias("capped"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open"), F.sum(over.cast("long")).alias("n"),
        ).first()
        total = share * (got["size"] or 0)
        if not got["open"] or got["n"] == full:
            break
        full, level = got["n"], (total - got["capped"]) / got["open"]
    return ranked.withColumn("target", F.least(F.col("most"), F.lit(level) * F.col("weight"))).select("source", "source_size", "target")


def mix_rates(docs: DataFrame, *, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """``docs`` with ``_size``, ``_source_size``, ``_target`` and ``_copies``.

    A null text has size 0 and a null source is a source of its own, the last
    in order. Sources of size 0 have target 0; their documents get no copy.
    The Bernoulli draw hashes the seed and doc_id (null: the text), so reruns
    agree and repeated rows share their fate. Other columns stay as they are;
    columns that already have one of the four names are replaced. An empty
    table gives an empty table.
    """
    docs, replaced = set_aside(docs, *RATES, "_source")
    own = {k: v for k, v in replaced.items() if k.lower() == "_source"}
    docs = docs.drop(*(v for k, v in replaced.items() if k not in own))
    base = shared_dir(docs.sparkSession)
    sizes = docs.select("source", count_words(F.col("text")).alias("n")).groupBy("source").agg(F.sum("n").alias("source_size"))
    targets = source_targets(materialise(sizes, base, "sizes"), base, weights, share, cap)
    targets = materialise(targets.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target")), base, "targets")
    small = targets.count() <= BROADCAST_SOURCES
    sized = docs.withColumn("_size", count_words(F.col("text")))
    joined = sized.join(F.broadcast(targets) if small else targets, sized["source"].eqNullSafe(targets["_source"]), "left")
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit("")))))
    draw = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(16.0**13)
    copies = F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")
    return joined.withColumn("_copies", copies).drop("_source").withColumnsRenamed({v: k for k, v in own.items()})


def emit_copies(rated: DataFrame, columns: list[str]) -> DataFrame:
    """Each document ``_copies`` times, numbered from 0 in ``copy``."""
    copies = F.when(F.col("_copies") > 0, F.sequence(F.lit(0), (F.col("_copies") - 1).cast("int")))
    return rated.select(*columns, F.explode(copies).alias("copy"))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, whatever their names, and ``copy`` (which replaces one of that name)."""
    docs = docs.drop("copy")
    plain, moved = set_aside(docs, *RATES)
    return emit_copies(mix_rates(plain, **kw), plain.columns).withColumnsRenamed({v: k for k, v in moved.items()})


def op5(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of each row of ``documents``."""
    out = mix_rates(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.round("_target", 6).alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"),
    )


#: The same level by sorting sources by how soon they fill.
OP5_SQL = r"""
WITH d AS (SELECT doc_id, text, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most FROM s),
o AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             sum(weight) OVER (ORDER BY most / weight, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
             1.5::DOUBLE * sum(source_size) OVER () AS total FROM r),
l AS (SELECT coalesce(arg_min((total - capped) / open, (most / weight, capped)) FILTER (WHERE (total - capped) / open <= most / weight), max(most / weight)) AS level FROM o),
t AS (SELECT source, source_size, least(most, level * weight) AS target FROM r, l),
p AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))), 1, 13) AS BIGINT) / 4503599627370496.0 AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM p
"""
