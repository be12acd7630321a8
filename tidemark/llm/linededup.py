"""Substring dedup by line hashing: the earliest copy of a passage stays, the rest go.

Units are lines, cut once more after each sentence end, so that a passage is
found whether or not it stands on lines of its own. Units are normalised (A-Z
lowered, white space joined) and hashed; digests are grouped over the whole
corpus. A passage is a run of neighbouring units that all occur elsewhere and
that has ``least_words`` words in all: shorter ones recur by chance or as
boilerplate and stay. Of each unit within passages the occurrence that ranks
first is kept. What is removed is returned with its offsets in the original
text.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, hot_join, materialise, set_aside, shared_dir, table


@dataclass(frozen=True)
class LineConfig:
    #: Words of a passage at least.
    least_words: int = 35
    #: At most so many digests (16 bytes each) are broadcast: those that each hold over 1 / ``hot_digests`` of all units.
    hot_digests: int = 50_000


def _units(text: bytes) -> list[tuple[int, int, bytes, int]]:
    """(start, end, normal form, words) of the units with a word, in code points, the break excluded."""
    out, at = [], 0
    for mark in (b".", b"!", b"?"):  # a blank after a sentence end is a break as a new line is
        text = text.replace(mark + b" ", mark + b"\n")
    for unit in text.split(b"\n"):
        size = len(unit) if unit.isascii() else len(unit.decode("utf-8"))
        words = unit.translate(LOWER).split()
        if words:
            out.append((at, at + size, b" ".join(words), len(words)))
        at += size + 1
    return out


def _identified(docs: DataFrame) -> DataFrame:
    """A row's identity: its doc_id and a hash of its text, as ids may be null or recur with another text."""
    return docs.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_th", F.xxhash64("text"))


def line_units(docs: DataFrame) -> DataFrame:
    """(_id, _th, at, start, end, words, digest) of each unit; ``at`` counts a text's units, digest is 128 bits of the normal form."""

    @F.arrow_udf("array<struct<start:int,end:int,words:int,digest:binary>>")
    def units(texts: pa.Array) -> pa.Array:
        import xxhash

        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("digest", pa.binary())]))
        rows = (x.as_py() for x in texts)  # one text at a time as Python bytes
        return pa.array([[(a, b, n, xxhash.xxh3_128_digest(s)) for a, b, s, n in _units(t)] if t else [] for t in rows], kind)

    found = _identified(docs).select("_id", "_th", F.posexplode(units.asNondeterministic()(F.encode("text", "UTF-8"))).alias("at", "u"))
    return found.select("_id", "_th", "at", "u.start", "u.end", "u.words", "u.digest")


def passages(docs: DataFrame, cfg: LineConfig | None = None, base: str | None = None) -> DataFrame:
    """(_id, _th, start, end, first) of every unit within a passage; ``first`` ranks lowest among the unit's occurrences.

    Occurrences rank by doc_id (null last), text hash, offset. Repeated rows
    (same doc_id and text) count as one. Counts cover all documents and are
    summed before the shuffle.
    """
    cfg = cfg or LineConfig()
    base = base or shared_dir(docs.sparkSession)
    units = materialise(line_units(docs), base, "units")
    # Repeated rows hold a unit at the same place of the same text: a unit is repeated if two places differ.
    place = F.xxhash64("_id", "_th", "at")
    counts = units.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("least"), F.max(place).alias("most"))
    counts = materialise(counts.where("least <> most").select("digest", "n"), base, "counts")
    limit = units.count() / cfg.hot_digests
    hot = counts.where(F.col("n") > limit).select("digest")
    repeated = hot_join(units, counts.select("digest"), hot, ["digest"]).distinct()

    doc = Window.partitionBy("_id", "_th")
    run = repeated.withColumn("run", F.col("at") - F.row_number().over(doc.orderBy("at")))
    run = run.withColumn("in_run", F.sum("words").over(Window.partitionBy("_id", "_th", "run"))).where(F.col("in_run") >= cfg.least_words)
    within = materialise(run.select("_id", "_th", "start", "end", "digest"), base, "within")
    rank = F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_th").alias("th"), F.col("start").alias("start"))
    first = materialise(within.groupBy("digest").agg(F.min(rank).alias("first")), base, "first")
    return hot_join(within, first, hot, ["digest"]).select("_id", "_th", "start", "end", "first")


def removals(docs: DataFrame, cfg: LineConfig | None = None) -> DataFrame:
    """(_id, _th, spans, repeated, first_id) per document with passages: the sorted spans that go, units within passages, least doc_id that keeps one."""
    base = shared_dir(docs.sparkSession)
    rank = F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_th").alias("th"), F.col("start").alias("start"))
    span = F.when(rank != F.col("first"), F.struct("start", "end"))
    own = passages(docs, cfg, base).groupBy("_id", "_th").agg(
        F.array_sort(F.collect_list(span)).alias("spans"), F.count("*").alias("repeated"), F.min("first.id").alias("first_id"))
    return materialise(own, base, "gone")


def dedup_lines(docs: DataFrame, cfg: LineConfig | None = None) -> DataFrame:
    """``docs`` with the text that stays, ``_removed``, ``_repeated`` and ``_first_id``.

    ``_removed`` is the array of (start, end) of the units removed from the
    original text, each with the one character after it; ``_repeated`` counts
    the units within passages, kept ones too; ``_first_id`` is the least doc_id
    that keeps one of them (null if there is none). Null and empty texts stay
    as they are. Other columns stay, whatever their names, but for those three,
    which are replaced; repeated rows stay repeated and share their fate; an
    empty table gives an empty table.
    """
    columns = [c for c in docs.columns if c.lower() not in ("_removed", "_repeated", "_first_id")]
    docs, moved = set_aside(docs.select(*[f"`{c}`" for c in columns]), "_id", "_th", "_i", "_t", "spans", "repeated", "first_id")
    gone = removals(docs, cfg).select(F.col("_id").alias("_i"), F.col("_th").alias("_t"), "spans", "repeated", "first_id")
    own = _identified(docs)
    out = own.join(gone, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t")), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))
    kept = F.transform(
        F.arrays_zip(F.concat(F.array(F.lit(0)), F.transform("_removed", lambda x: x["end"] + 1)).alias("a"), F.concat(F.transform("_removed", lambda x: x["start"]), F.array(F.length("text"))).alias("b")),
        lambda x: F.substring(F.col("text"), x["a"] + 1, F.greatest(F.lit(0), x["b"] - x["a"])),
    )
    clean = F.when(F.size("_removed") > 0, F.array_join(kept, "")).otherwise(F.col("text"))
    out = out.withColumn("_removed", spans).withColumn("text", clean).withColumn("_repeated", F.coalesce("repeated", F.lit(0))).withColumn("_first_id", F.col("first_id"))
    return out.select(*[f"`{c}`" for c in docs.columns], "_removed", "_repeated", "_first_id").withColumnsRenamed({v: k for k, v in moved.items()})


def op9(spark, sf_dir: str) -> DataFrame:
    """What line dedup finds in and removes from each row of ``documents``."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("_removed", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.select(
        "doc_id", F.col("_repeated").alias("n_repeated"), F.size("_removed").cast("long").alias("n_removed"),
        F.aggregate("_removed", F.lit(0), lambda s, x: s + x["end"] - x["start"]).cast("long").alias("removed_chars"),
        F.col("_first_id").alias("first_doc_id"), spans.alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


OP9_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, text, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS l FROM d),
o AS (
  SELECT *, CAST(coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a,
         regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM u),
n AS (SELECT doc_id, i, a, l, len(w) AS n, array_to_string(w, ' ') AS k FROM o WHERE len(w) > 0),
c AS (SELECT *, min({'d': doc_id, 'i': i}) OVER (PARTITION BY k) <> max({'d': doc_id, 'i': i}) OVER (PARTITION BY k) AS again, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM n),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS isle FROM c WHERE again),
p AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, isle) AS total FROM g),
q AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, a) > 1 AS gone, first_value(doc_id) OVER (PARTITION BY k ORDER BY doc_id, a) AS first_id FROM p WHERE total >= 35),
s AS (
  SELECT doc_id, count(*) AS n_repeated, count(*) FILTER (WHERE gone) AS n_removed, CAST(coalesce(sum(length(l)) FILTER (WHERE gone), 0) AS BIGINT) AS removed_chars,
         min(first_id) AS first_doc_id, coalesce(string_agg(a || ':' || (a + length(l)), ',' ORDER BY i) FILTER (WHERE gone), '') AS removed
  FROM q GROUP BY doc_id),
t AS (
  SELECT o.doc_id, string_agg(substring(o.text, o.a + 1, length(o.l) + 1), '' ORDER BY o.i) AS kept
  FROM o LEFT JOIN q ON q.doc_id = o.doc_id AND q.i = o.i AND q.gone WHERE q.doc_id IS NULL GROUP BY o.doc_id)
SELECT d.doc_id, coalesce(n_repeated, 0) AS n_repeated, coalesce(n_removed, 0) AS n_removed, coalesce(removed_chars, 0) AS removed_chars,
       first_doc_id, coalesce(removed, '') AS removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN t USING (doc_id)
"""
