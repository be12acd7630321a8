"""Time blocks: what lets per-symbol windows run on more tasks than there are symbols.

A symbol's history is cut into blocks of fixed length. A row that later rows
look back on is copied into the blocks that its reach touches, so that each
(symbol, block) is self-contained; copies never appear in results. Trailing
sums come from running sums to which each row is added at its time and from
which it is taken when it leaves the window, so that a row costs the same
however full its windows are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_blocks(df: DataFrame, at: str, reach: int, width: int) -> DataFrame:
    """``df`` with ``_block`` and ``_own``: rows copied forward into every block within ``reach``."""
    first = F.floor(F.col(at) / width)
    last = F.floor((F.col(at) + reach) / width)
    return df.withColumn("_block", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_block") == first)


def trailing_sums(df: DataFrame, keys: list[str], at: str, values: dict[str, Column], windows: dict[str, int], width: int) -> DataFrame:
    """``df`` with ``{value}_{window}``: sums over [t - w, t], both ends included.

    ``at`` is an integer; rows of equal time see each other. Sums are in the
    type of the value, so take integers or decimals for exact results.
    """
    cols = df.columns
    reach = max(windows.values()) + 1
    rows = df.select(*cols, *[v.alias(f"_v_{n}") for n, v in values.items()])
    names = list(windows)
    enter = F.struct(F.col(at).alias("t"), F.lit("").alias("w"))
    leave = [F.struct((F.col(at) + windows[n] + 1).alias("t"), F.lit(n).alias("w")) for n in names]
    rows = rows.withColumn("_e", F.explode(F.array(enter, *leave)))
    rows = rows.withColumn("_t", F.col("_e.t")).withColumn("_w", F.col("_e.w")).drop("_e")
    # A row lives in the blocks of its time to that of its last leaving.
    first, last = F.floor(F.col(at) / width), F.floor((F.col(at) + reach) / width)
    rows = rows.withColumn("_block", F.explode(F.sequence(first, last))).withColumn("_own", (F.col("_block") == first) & (F.col("_w") == ""))
    run = Window.partitionBy(*keys, "_block").orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    for n in names:
        step = lambda v: F.when(F.col("_w") == "", v).when(F.col("_w") == n, -v)  # noqa: B023,E731
        rows = rows.withColumns({f"{v}_{n}": F.sum(step(F.col(f"_v_{v}"))).over(run) for v in values})
    return rows.where("_own").select(*cols, *[f"{v}_{n}" for n in names for v in values])


def running_sum(df: DataFrame, keys: list[str], order: list[str], at: str, value: Column, name: str, width: int) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows of the key up to each row.

    Blocks are summed first; a block's rows start from the sum of those before it.
    """
    cols = df.columns
    rows = df.withColumn("_v", value).withColumn("_block", F.floor(F.col(at) / width))
    blocks = rows.groupBy(*keys, "_block").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    own = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.sum("_v").over(own)).join(blocks, [*keys, "_block"])
    return rows.select(*cols, (F.col("_run") + F.col("_before")).alias(name))


def neighbour(df: DataFrame, keys: list[str], order: list[str], at: str, width: int, value: Column, name: str, ahead: bool = False) -> DataFrame:
    """``df`` with ``value`` of the row before (``ahead``: after) in ``order`` within the keys; null where there is none.

    A block's first row takes it from the nearest block before that has rows
    of the key, so only one row for each block meets in a window over a key.
    """
    cols = df.columns
    rows = df.withColumns({"_block": F.floor(F.col(at) / width), "_value": F.struct(value.alias("v"))})
    way = [F.desc(c) for c in order] if ahead else [F.asc(c) for c in order]
    own = Window.partitionBy(*keys, "_block").orderBy(*way)
    nearest = F.min_by if ahead else F.max_by
    edges = rows.groupBy(*keys, "_block").agg(nearest("_value", F.struct(*order)).alias("_edge"))
    over = Window.partitionBy(*keys).orderBy(F.desc("_block") if ahead else "_block")
    edges = edges.select(*keys, "_block", F.lag("_edge").over(over).alias("_beyond"))
    out = rows.withColumn("_near", F.lag("_value").over(own)).join(edges, [*keys, "_block"], "left")
    return out.select(*cols, F.coalesce("_near", "_beyond")["v"].alias(name))


def last_seen(points: DataFrame, rows: DataFrame, keys: list[str], at: str, value: Column, name: str, width: float, ahead: bool = False) -> DataFrame:
    """``points`` with ``value`` of the latest of ``rows`` at or before their time (both have ``keys`` and ``at``); the largest value of equal times.

    ``ahead``: of the earliest at or after it. One line of both within blocks;
    what blocks before have seen last comes from one row for each block.
    """
    if ahead:
        turned = lambda df: df.withColumn(at, -F.col(at))
        return turned(last_seen(turned(points), turned(rows.withColumn("_v", value)), keys, at, F.col("_v"), name, width))
    cols = points.columns
    seen = F.struct(F.col(at).alias("t"), value.alias("v"))
    line = points.withColumns({"_own": F.lit(True), "_seen": F.lit(None)}).unionByName(rows.select(*keys, at, seen.alias("_seen"), F.lit(False).alias("_own")), allowMissingColumns=True)
    line = line.withColumn("_block", F.floor(F.col(at) / width))
    over = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    edges = line.groupBy(*keys, "_block").agg(F.max("_seen").alias("_edge")).select(*keys, "_block", F.max("_edge").over(over).alias("_before"))
    own = Window.partitionBy(*keys, "_block").orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("_seen", F.max("_seen").over(own)).where("_own").join(edges, [*keys, "_block"], "left")
    return line.select(*cols, F.coalesce("_seen", "_before")["v"].alias(name))


def hopping(df: DataFrame, at: str, grid: int, window: int) -> DataFrame:
    """``df`` with ``tick``: each row once for every multiple T of ``grid`` with T - window <= t <= T."""
    first = F.ceil(F.col(at) / grid)
    last = F.floor((F.col(at) + window) / grid)
    return df.where(last >= first).withColumn("tick", F.explode(F.sequence(first, last))).withColumn("tick", F.col("tick") * grid)


def range_pairs(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, low: int, high: int, width: int) -> DataFrame:
    """Pairs with low <= right_at - at <= high, as an equi-join on blocks of ``width``; ``right_at`` must be a column of ``right`` alone."""
    left = left.withColumn("_block", F.explode(F.sequence(F.floor((F.col(at) + low) / width), F.floor((F.col(at) + high) / width))))
    right = right.withColumn("_block", F.floor(F.col(right_at) / width))
    gap = F.col(right_at) - F.col(at)
    return left.join(right, [*keys, "_block"]).where((gap >= low) & (gap <= high)).drop("_block")
