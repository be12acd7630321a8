"""Preference formatting of chat pairs, in DataFrame functions only.

The longest common turn prefix of a chosen and a rejected conversation is
rendered once, as prompt; what follows in each is its completion, in which
only assistant turns are trained on. The work is on rows of turns that say
where in the prompt or completion they stand, so a conversation of any length
is spread over tasks; no conversation is gathered into one row on the main
path. :func:`assemble` gathers them for trainers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table

ROLES = ("system", "user", "assistant", "tool")
#: Turn numbers in one block; positions are added up within blocks and over blocks.
BLOCK = 1024
LAST = 2**62


def render(role, text):
    """One turn in the template; a null role is "unknown", a null text is empty."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def adjacent_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, pair_id, side): conversation 2k is chosen, 2k + 1 rejected, in pair k. Null ids are in no pair."""
    ids = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    return ids.select("conv_id", F.floor(F.col("conv_id") / 2).alias("pair_id"), F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"))


def preference_turns(turns: DataFrame, sides) -> DataFrame:
    """One row for each distinct turn of each pair: prompt, chosen or rejected.

    ``sides`` is a table (conv_id, pair_id, side), or a function of ``turns``
    that adds the columns pair_id and side without a join. Turns are ordered
    by their number. Rows that agree in conversation, turn, role and text are
    one turn with ``copies``; several different rows under one number stand
    side by side. A number belongs to the common prefix if both sides have the
    same rows under it and under every number before it. A pair with one side
    missing states no preference and is left out. Null turn numbers come last
    and are never common. Prompt rows come from the chosen side, once.
    ``start`` and ``end`` are a turn's characters in its part; the trained ones
    of a completion are its mask. Extra columns aren't read.
    """
    slim = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = slim.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = sides(rows) if callable(sides) else rows.join(sides, "conv_id")
    # Under each number: is what one side has also what the other has? Hashes add up on both sides of the shuffle.
    sign = F.when(F.col("side") == "chosen", 1).otherwise(-1)
    one = F.xxhash64("role", "text", "copies")
    two = F.xxhash64(F.lit(1), "text", "role", "copies")
    part = lambda h, k: F.sum(sign * F.pmod(h, F.lit(k)))
    same = rows.groupBy("pair_id", "turn").agg(
        part(one, 2147483647).alias("p"), part(two, 2147483629).alias("q"), F.sum(sign.cast("long")).alias("r"), F.min("side").alias("low"), F.max("side").alias("high")
    )
    differs = F.col("turn").isNull() | (F.col("p") != 0) | (F.col("q") != 0) | (F.col("r") != 0)
    end = same.groupBy("pair_id").agg(F.min(F.when(differs, F.coalesce("turn", F.lit(LAST)))).alias("end"), F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high")
    out = rows.join(end.select("pair_id", "end"), "pair_id")
    common = F.col("turn").isNotNull() & (F.col("end").isNull() | (F.col("turn") < F.col("end")))
    out = out.withColumn("part", F.when(common, "prompt").otherwise(F.col("side"))).where(~common | (F.col("side") == "chosen"))
    out = out.select(
        "pair_id", "part", "conv_id", "turn", "role", "copies", render(F.col("role"), F.col("text")).alias("rendered"),
        (~common & F.coalesce(F.col("role") == "assistant", F.lit(False))).alias("trained"),
    )
    return _positioned(out)


def _positioned(rows: DataFrame) -> DataFrame:
    """``rows`` with ``start`` and ``end`` in the text of their part, whose turns stand by number, role and text."""
    key = ["pair_id", "part", "_block"]
    size = F.length("rendered") * F.col("copies")
    rows = rows.withColumn("_block", F.floor(F.coalesce("turn", F.lit(LAST)) / BLOCK)).withColumn("_size", size)
    sums = rows.groupBy(*key).agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy("pair_id", "part").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    own = Window.partitionBy(*key).orderBy(F.coalesce("turn", F.lit(LAST)), F.coalesce("role", F.lit("")), "rendered", "copies").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_run", F.sum("_size").over(own)).join(sums, key)
    end = F.col("_before") + F.col("_run")
    return out.withColumn("start", end - F.col("_size")).withColumn("end", end).drop("_block", "_size", "_run", "_before")


def by_parity(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pair_id", F.floor(F.col("conv_id") / 2)).withColumn("side", F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected"))


def assemble(formatted: DataFrame) -> DataFrame:
    """One row for each pair, for trainers: prompt, chosen, rejected and their trained character spans.

    Each conversation of ``formatted`` must fit in a row here; the turn rows don't need that.
    """
    piece = F.struct("start", "end", "rendered", "copies", "trained")
    grouped = formatted.groupBy("pair_id").pivot("part", ["prompt", "chosen", "rejected"]).agg(F.array_sort(F.collect_list(piece)))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.repeat(x["rendered"], x["copies"].cast("int"))), "")
    mask = lambda c: F.transform(F.filter(c, lambda x: x["trained"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return grouped.select("pair_id", text("prompt").alias("prompt"), text("chosen").alias("chosen"), text("rejected").alias("rejected"), mask("chosen").alias("chosen_mask"), mask("rejected").alias("rejected_mask"))


def op3(spark, sf_dir: str) -> DataFrame:
    """All ``conversations`` as preference pairs (2k chosen, 2k + 1 rejected), a row for each turn."""
    return preference_turns(table(spark, sf_dir, "conversations"), by_parity)


OP3_SQL = r"""
WITH r AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text, count(*) AS copies,
         CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, CASE WHEN ((conv_id % 2) + 2) % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL),
s AS (
  SELECT pair_id, turn,
         list(struct_pack(r := role, t := text, c := copies) ORDER BY role, text, copies) FILTER (WHERE side = 'chosen') AS x,
         list(struct_pack(r := role, t := text, c := copies) ORDER BY role, text, copies) FILTER (WHERE side = 'rejected') AS y
  FROM r GROUP BY ALL),
e AS (SELECT pair_id, min(CASE WHEN turn IS NULL OR x IS DISTINCT FROM y THEN coalesce(turn, 4611686018427387904) END) AS stop FROM s GROUP BY pair_id HAVING bool_or(x IS NOT NULL) AND bool_or(y IS NOT NULL)),
m AS (SELECT r.*, turn IS NOT NULL AND (stop IS NULL OR turn < stop) AS common FROM r JOIN e USING (pair_id)),
p AS (
  SELECT pair_id, CASE WHEN common THEN 'prompt' ELSE side END AS part, conv_id, turn, role, copies,
         '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS rendered,
         NOT common AND coalesce(role = 'assistant', false) AS trained
  FROM m WHERE NOT common OR side = 'chosen'),
q AS (
  SELECT *, CAST(sum(length(rendered) * copies) OVER (PARTITION BY pair_id, part ORDER BY coalesce(turn, 4611686018427387904), coalesce(role, ''), rendered, copies ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end" FROM p)
SELECT *, "end" - length(rendered) * copies AS start FROM q
"""
