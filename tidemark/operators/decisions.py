"""Sweep scores, gates and the state machine, from one time line for each symbol.

Trades, alerts, book snapshots, sweeps and ticks are put on one time line and
cut into blocks; every "latest" and "within the last" is a running aggregate
over it, so no row is joined to a range of others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import BEARISH_CONFLICTS, BULLISH_CONFLICTS, WINDOWS, Config
from tidemark.functions.scalars import dec, ratio, signed
from tidemark.operators.blocks import last_seen

C = Config()


def _timeline(parts: dict[str, DataFrame], reach: int, width: int) -> DataFrame:
    """All rows by kind; each lives in the blocks from its time to ``reach`` later."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("kind", F.lit(k)) for k, df in parts.items()])
    first, last = F.floor(F.col("ms") / width), F.floor((F.col("ms") + reach) / width)
    return rows.withColumn("_block", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_block") == first)


def _trade_steps(trades: DataFrame, windows: dict[str, int]) -> DataFrame:
    """Each trade when it enters, and when it leaves each window (with the opposite sign)."""
    value = signed(F.col("side"), F.col("notional"))
    buy = F.when(F.col("side") == "BUY", F.col("notional")).otherwise(dec(F.lit(0)))
    zero = dec(F.lit(0))
    enter = F.struct(F.col("ms").alias("ms"), *[x for w in windows for x in (value.alias(f"d_{w}"), buy.alias(f"b_{w}"), F.col("notional").alias(f"t_{w}"))])
    leave = [
        F.struct((F.col("ms") + ms + 1).alias("ms"), *[x for w in windows for x in ((-value if w == name else zero).alias(f"d_{w}"), (-buy if w == name else zero).alias(f"b_{w}"), (-F.col("notional") if w == name else zero).alias(f"t_{w}"))])
        for name, ms in windows.items()
    ]
    cast = lambda s: s.cast("struct<ms:bigint," + ",".join(f"{x}_{w}:decimal(28,6)" for w in windows for x in "dbt") + ">")
    steps = trades.select("symbol", F.col("ms").alias("born"), F.explode(F.array(*[cast(s) for s in (enter, *leave)])).alias("s"))
    return steps.select("symbol", "born", "s.*")


def features_at(points: DataFrame, trades: DataFrame, alerts: DataFrame, book: DataFrame, sweeps: DataFrame | None = None, cfg: Config = C, windows: dict[str, int] = WINDOWS) -> DataFrame:
    """``points`` (symbol, ms, ...) with what is known at their time.

    Per window the delta and the buy ratio; per alert type the time of the last
    one; the last book (all its columns, and its age); the last sweep
    (direction, score, time). What is older than its limit is null. Rows of
    equal time count.
    """
    own = points.columns
    reach = max(*windows.values(), cfg.alert_ms, cfg.stale_ms, cfg.sweep_active_ms) + 1
    carried = [c for c in book.columns if c not in ("symbol", "snap_ms")]
    parts = {
        "point": points, "alert": alerts.select("symbol", "ms", F.col("type").alias("alert")),
        "book": book.select("symbol", F.col("snap_ms").alias("ms"), *carried),
    }
    if sweeps is not None:
        parts["sweep"] = sweeps.select("symbol", "ms", "sweep_id", F.col("direction").alias("s_direction"), F.col("score").alias("s_score"))
    width = cfg.block_ms
    line = _timeline(parts, reach, width)
    # A step of a trade belongs to the blocks of the trade's own reach, whenever the step is.
    steps = _trade_steps(trades, windows)
    steps = steps.withColumn("_block", F.explode(F.sequence(F.floor(F.col("born") / width), F.floor((F.col("born") + reach) / width)))).drop("born")
    rows = line.unionByName(steps.withColumn("kind", F.lit("trade")).withColumn("_own", F.lit(False)), allowMissingColumns=True)
    run = Window.partitionBy("symbol", "_block").orderBy("ms").rangeBetween(Window.unboundedPreceding, 0)
    types = sorted({*BEARISH_CONFLICTS, *BULLISH_CONFLICTS, "BULLISH_ABSORPTION", "BEARISH_ABSORPTION"})
    known = {}
    for w in windows:
        zero = dec(F.lit(0))
        known |= {f"{x}_{w}": F.coalesce(F.sum(f"{x}_{w}").over(run), zero) for x in "dbt"}
    known |= {f"last_{t}": F.max(F.when(F.col("alert") == t, F.col("ms"))).over(run) for t in types}
    known["last_book"] = F.max(F.when(F.col("kind") == "book", F.struct("ms", *carried))).over(run)
    if sweeps is not None:
        known["last_sweep"] = F.max(F.when(F.col("kind") == "sweep", F.struct("ms", "sweep_id", "s_direction", "s_score"))).over(run)
    # ``d_1m`` and so on are step columns of the same name: compute first, rename after.
    rows = rows.select(*own, "kind", "_own", *[c.alias(f"known_{n}") for n, c in known.items()]).where("kind = 'point' and _own")
    out = {}
    for w in windows:
        out[f"delta_{w}"] = F.col(f"known_d_{w}").cast("double")
        out[f"buy_ratio_{w}"] = ratio(F.col(f"known_b_{w}"), F.col(f"known_t_{w}"), 0.5)
    for t in types:
        out[f"ago_{t}"] = F.when(F.col("ms") - F.col(f"known_last_{t}") <= cfg.alert_ms, F.col("ms") - F.col(f"known_last_{t}"))
    b = F.col("known_last_book")
    out["book_age"] = F.when(F.col("ms") - b["ms"] <= cfg.stale_ms, F.col("ms") - b["ms"])
    fresh = F.col("ms") - b["ms"] <= cfg.stale_ms
    out |= {n: F.when(fresh, b[n]) for n in carried}
    if sweeps is not None:
        s = F.col("known_last_sweep")
        live = F.col("ms") - s["ms"] <= cfg.sweep_active_ms
        out |= {"sweep_direction": F.when(live, s["s_direction"]), "sweep_score": F.when(live, s["s_score"]), "sweep_age": F.when(live, F.col("ms") - s["ms"])}
    return rows.select(*own, *[c.alias(n) for n, c in out.items()])


def _seen(*types: str, within: int | None = None) -> Column:
    test = lambda t: F.col(f"ago_{t}").isNotNull() if within is None else F.coalesce(F.col(f"ago_{t}") <= within, F.lit(False))
    return reduce(lambda a, b: a | b, [test(t) for t in types])


def score_sweeps(sweeps: DataFrame, trades: DataFrame, alerts: DataFrame, book: DataFrame, cfg: Config = C) -> DataFrame:
    """Sweeps (sweep_id, symbol, ms, direction) with score 0 to 10, its parts and status.

    Exhaustion gives 2 (1 without the pressure before), absorption 3,
    divergence 2, a leaning book 3 unless it is stale.
    """
    x = features_at(sweeps, trades, alerts, book, None, cfg)
    bull = F.upper("direction") == "BULLISH"
    pick = lambda a, b: F.when(bull, a).otherwise(b)
    pressure = pick((F.col("delta_15m") <= -cfg.sweep_pressure) | _seen("SELL_AGGRESSION"), (F.col("delta_15m") >= cfg.sweep_pressure) | _seen("BUY_AGGRESSION"))
    recovering = pick((F.col("delta_5m") >= -cfg.sweep_recovery) | (F.col("delta_1m") > 0), (F.col("delta_5m") <= cfg.sweep_recovery) | (F.col("delta_1m") < 0))
    absorbed = pick(*[_seen(f"{k}_ABSORPTION", f"POSSIBLE_{k}_ABSORPTION", f"CONFIRMED_{k}_ABSORPTION") for k in ("BULLISH", "BEARISH")])
    diverged = pick(_seen("BULLISH_DIVERGENCE"), _seen("BEARISH_DIVERGENCE"))
    leaning = F.coalesce(pick(F.col("imbalance") >= cfg.confirm_imbalance, F.col("imbalance") <= -cfg.confirm_imbalance), F.lit(False))
    exhaustion = F.when(pressure & recovering, 2).when(recovering, 1).otherwise(0)
    out = x.withColumns({"exhaustion": exhaustion, "absorption": F.when(absorbed, 3).otherwise(0), "divergence": F.when(diverged, 2).otherwise(0), "leaning": F.when(leaning, 3).otherwise(0), "stale": F.col("book_age").isNull()})
    known = F.upper("direction").isin("BULLISH", "BEARISH")
    score = F.when(known, F.col("exhaustion") + F.col("absorption") + F.col("divergence") + F.col("leaning")).otherwise(0)
    out = out.withColumn("score", score)
    return out.withColumn("status", F.when(F.col("score") >= cfg.sweep_score, "SWEEP_CONFLUENCE").otherwise("LOW_CONFLUENCE"))


def cooldown_reason() -> Column:
    return F.format_string("Signal cooldown active (%.1fs remaining)", (F.col("cooldown_until") - F.col("ms")) / 1000)


def with_cooldowns(committed: DataFrame) -> DataFrame:
    """Committed decisions as the state machine would have given them had it known the cooldown: reason, gates and candidate of COOLDOWN rows."""
    cooling = F.col("committed") == "COOLDOWN"
    shown = {"reason": cooldown_reason(), "gates": F.create_map(F.lit("cooldown_inactive"), F.lit("FAIL")), "candidate": F.lit(False)}
    return committed.withColumns({c: F.when(cooling, v).otherwise(F.col(c)) for c, v in shown.items()})


def evaluate(x: DataFrame, cfg: Config = C) -> DataFrame:
    """The state machine over rows of features: action, reason, gates, candidate, gated.

    ``x`` has symbol, ms, delta_1m, delta_5m, buy_ratio_5m, imbalance,
    net_shift, valid, book_age, warming, bearish (a conflicting event is
    recent), bullish, sweep_direction, sweep_score, and optionally
    cooldown_until and book_ms (time of the last book, however old). Gates
    come in order: validity, freshness, warm-up, cooldown; then long and short
    candidates are weighed.
    """
    asked = x.columns
    for optional in ("cooldown_until", "book_ms"):
        if optional not in x.columns:
            x = x.withColumn(optional, F.lit(None).cast("long"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    active = yes(F.col("sweep_score") >= cfg.sweep_score)
    swept = {"long": active & yes(F.col("sweep_direction") == "BULLISH"), "short": active & yes(F.col("sweep_direction") == "BEARISH")}
    d1, d5, r, imb, shift = (F.coalesce(F.col(c), F.lit(v)) for c, v in (("delta_1m", 0.0), ("delta_5m", 0.0), ("buy_ratio_5m", 0.5), ("imbalance", 0.0), ("net_shift", 0.0)))
    tests = {
        "long": {"1m_delta_positive": d1 > 0, "5m_delta_bias": (d5 >= cfg.bias_delta) | swept["long"], "buy_aggression": r >= 0.58, "imbalance_bullish": imb >= cfg.confirm_imbalance, "stacking_bullish": shift > 0, "no_bearish_conflict": ~yes(F.col("bearish"))},
        "short": {"1m_delta_negative": d1 < 0, "5m_delta_bias": (d5 <= -cfg.bias_delta) | swept["short"], "sell_aggression": r <= 0.42, "imbalance_bearish": imb <= -cfg.confirm_imbalance, "stacking_bearish": shift < 0, "no_bullish_conflict": ~yes(F.col("bullish"))},
    }
    early = {"long": (d5 > cfg.watch_delta) & (r >= 0.55), "short": (d5 < -cfg.watch_delta) & (r <= 0.45)}
    words = {"long": ("Bullish", "bullish"), "short": ("Bearish", "bearish")}
    best, gates, blocked = {}, {}, {}
    for side, t in tests.items():
        moving, bias, pushed, leaning, stacked, clear = t.values()
        text = lambda s: F.lit(s)
        up, low = words[side]
        full = bias & pushed & leaning
        rule = lambda p, why: F.struct(F.lit(p).alias("priority"), text(why).alias("reason"))
        best[side] = (
            F.when(clear & swept[side] & moving, rule(2, f"{up} sweep confluence confirmed"))
            .when(clear & swept[side], rule(1, f"{up} sweep waiting for confirmation gates"))
            .when(clear & full & stacked & moving, rule(2, f"{up} order flow bias confirmed"))
            .when(clear & full, rule(1, "Flow bias watching stacking/pulling details"))
            .when(clear & (bias | early[side]), rule(1, f"Delta/Aggression turning {low}"))
            .otherwise(rule(0, ""))
        )
        gates[side] = F.map_from_arrays(F.array(*[F.lit(k) for k in t]), F.array(*[F.when(v, "PASS").otherwise("FAIL") for v in t.values()]))
        blocked[side] = (bias | swept[side]) & ~clear
    x = x.withColumns({"_long": best["long"], "_short": best["short"], "_long_gates": gates["long"], "_short_gates": gates["short"]})
    lp, sp = F.col("_long.priority"), F.col("_short.priority")
    longer, shorter = (lp > sp), (sp > lp)
    # The side's 5m gate stands in both maps under one name; the short side's is the last word where both are shown.
    both = F.map_from_entries(F.concat(F.filter(F.map_entries("_long_gates"), lambda e: e["key"] != "5m_delta_bias"), F.map_entries("_short_gates")))
    name = lambda p, side: F.when(p == 2, f"CONFIRMED_{side}").otherwise(f"WATCH_{side}")
    single = lambda k: F.create_map(F.lit(k), F.lit("FAIL"))
    # Without any book the age is said to be this.
    age = F.coalesce(F.col("ms") - F.col("book_ms"), F.col("book_age"), F.lit(9999)).cast("long")
    result = lambda action, reason, g, candidate, gated: F.struct(action.alias("action"), reason.alias("reason"), g.alias("gates"), F.lit(candidate).alias("candidate") if isinstance(candidate, bool) else candidate.alias("candidate"), F.lit(gated).alias("gated"))
    waiting = lambda reason, g: result(F.lit("WAITING"), F.lit(reason), g, False, False)
    decided = (
        F.when(F.col("valid").eqNullSafe(False), result(F.lit("DATA_INVALID"), F.lit("Book sync invalid or sequence gap active"), single("book_synced"), False, True))
        .when(F.col("book_age").isNull() | (F.col("book_age") > cfg.stale_ms), result(F.lit("DATA_STALE"), F.format_string("Depth stale (age: %dms)", age), single("freshness"), False, True))
        .when(yes(F.col("warming")), result(F.lit("WARMING_UP"), F.lit("Rolling window is warming up"), single("warmup_complete"), False, True))
        .when(yes(F.col("ms") < F.col("cooldown_until")), result(F.lit("COOLDOWN"), cooldown_reason(), single("cooldown_inactive"), False, False))
        .when((lp > 0) & (lp == sp), waiting("AMBIGUOUS_DIRECTIONAL_CONFLICT", both))
        .when(longer, result(name(lp, "LONG"), F.col("_long.reason"), F.col("_long_gates"), lp == 2, False))
        .when(shorter, result(name(sp, "SHORT"), F.col("_short.reason"), F.col("_short_gates"), sp == 2, False))
        .when(blocked["long"], waiting("LONG_SUPPRESSED:Bearish conflict active", F.col("_long_gates")))
        .when(blocked["short"], waiting("SHORT_SUPPRESSED:Bullish conflict active", F.col("_short_gates")))
        .otherwise(waiting("No active signal triggers", both))
    )
    out = x.withColumn("_d", decided).drop("_long", "_short", "_long_gates", "_short_gates")
    return out.select(*asked, "_d.*")


def decision_inputs(trades: DataFrame, alerts: DataFrame, book: DataFrame, scored: DataFrame, grid: int, cfg: Config = C, windows: dict[str, int] = WINDOWS) -> DataFrame:
    """Ticks (symbol, ms: every multiple of ``grid`` after a cell with trades) with the features of the state machine."""
    cells = trades.groupBy("symbol", (F.floor(F.col("ms") / grid) + 1).alias("cell")).agg(F.max_by("price", F.struct("ms", "agg_id")).alias("price"))
    ticks = cells.select("symbol", (F.col("cell") * grid).alias("ms"), "price")
    x = features_at(ticks, trades, alerts, book, scored, cfg, windows)
    start = trades.groupBy("symbol").agg(F.min("ms").alias("_start"))
    x = x.join(start, "symbol").withColumn("warming", F.col("ms") - F.col("_start") < max(windows.values())).drop("_start")
    x = last_seen(x, book.select("symbol", F.col("snap_ms").alias("ms")), ["symbol"], "ms", F.col("ms"), "book_ms", cfg.block_ms)
    return x.withColumn("bearish", _seen(*BEARISH_CONFLICTS, within=cfg.conflict_ms)).withColumn("bullish", _seen(*BULLISH_CONFLICTS, within=cfg.conflict_ms))


def transitions(committed: DataFrame) -> DataFrame:
    """Rows where the committed action changes."""
    return committed.where(~F.col("committed").eqNullSafe(F.col("old_action")))
