"""Sinks: recordings, event logs, reports, JSON answers. Each formats columns and leaves writing to Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.readers import BIAS_SIGNALS, FLOW_EVENTS

TIME = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _places(c: Column, n: int) -> Column:
    return F.when(c.isNotNull(), F.format_string(f"%.{n}f", c.cast("double"))).otherwise("")


def flow_event_rows(events: DataFrame) -> DataFrame:
    """Event-log columns as text: volumes to 4 places, ratios to 2, ages to 1; absent columns are empty."""
    places = {"buy_volume": 4, "sell_volume": 4, "delta": 4, "cvd": 4, "buy_ratio": 2, "sell_ratio": 2, "price": 4, "order_book_imbalance_at_score": 4, "depth_snapshot_age_ms": 1}
    out = []
    for name in (x.split()[0] for x in FLOW_EVENTS.split(", ")):
        c = F.col(name) if name in events.columns else F.lit(None)
        out.append((_places(c, places[name]) if name in places else F.coalesce(c.cast("string"), F.lit(""))).alias(name))
    return events.select(*out)


#: Columns of the logs, in their order.
TRANSITIONS = ("timestamp", "symbol", "old_action", "new_action", "price", "latest_event", "suppression_reason", "reason")
CONTEXT_LOG = (
    "timestamp", "symbol", "mark_price", "index_price", "mark_premium_pct", "funding_rate_pct", "open_interest", "trend_1m", "trend_5m", "trend_15m",
    "orderbook_snapshot_imbalance", "context_quality", "context_confirm", "warnings_json",
)
PERFORMANCE = ("timestamp", "signal_type", "price", "reason")
PERFORMANCE_PARTS = ("mfe_pct", "mae_pct", "pnl_pct", "win")


def laid_out(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``rows`` in a log's columns, as text; what the rows lack is empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    return rows.select(*[text(c).alias(c) for c in columns])


def _iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), TIME)


def transition_rows(changes: DataFrame) -> DataFrame:
    """Transitions (symbol, ms, old_action, committed, price, reason) as log lines; a suppressed side stands in its own column."""
    held = F.when(F.col("reason").contains("SUPPRESSED"), F.col("reason"))
    return laid_out(changes.withColumns({"timestamp": _iso(F.col("ms")), "new_action": F.col("committed"), "suppression_reason": held}), TRANSITIONS)


def signal_rows(outcomes: DataFrame, horizon: str = "15m") -> DataFrame:
    """Finished signals (signal_id, symbol, ms, action, direction, price, after_*, best, worst and final of ``horizon``) as log lines."""
    names = {
        "entry_time": _iso(F.col("ms")), "entry_price": F.col("price"), "price_after_1m": F.col("after_1m"), "price_after_5m": F.col("after_5m"), "price_after_15m": F.col("after_15m"),
        "max_favorable_pct": F.col(f"best_{horizon}"), "max_adverse_pct": F.col(f"worst_{horizon}"), "final_return_pct": F.col(f"final_{horizon}"),
    }
    return laid_out(outcomes.withColumns(names), tuple(x.split()[0] for x in BIAS_SIGNALS.split(", ")))


def context_rows(contexts: DataFrame) -> DataFrame:
    """Market contexts (ms, symbol, mark, index, ..., warnings) as log lines; warnings become JSON."""
    names = {
        "timestamp": _iso(F.col("ms")), "mark_price": F.col("mark"), "index_price": F.col("index"), "mark_premium_pct": F.col("premium_pct"), "funding_rate_pct": F.col("funding_pct"),
        "orderbook_snapshot_imbalance": F.col("rest_imbalance"), "context_quality": F.col("quality"), "context_confirm": F.col("label"), "warnings_json": F.to_json("warnings"),
    }
    return laid_out(contexts.withColumns(names), CONTEXT_LOG)


def performance_rows(outcomes: DataFrame, horizons: tuple[str, ...] = ("5m", "15m", "1h")) -> DataFrame:
    """Outcomes (ms, action, price, best, worst, final and win by horizon) as report lines."""
    names = {"timestamp": _iso(F.col("ms")), "signal_type": F.col("action")}
    parts = dict(zip(PERFORMANCE_PARTS, ("best", "worst", "final", "win"), strict=True))
    names |= {f"{h}_{p}": F.col(f"{c}_{h}") for h in horizons for p, c in parts.items()}
    return laid_out(outcomes.withColumns(names), (*PERFORMANCE, *(f"{h}_{p}" for h in horizons for p in PERFORMANCE_PARTS)))


def missing_columns(expected: Column, found: Column) -> Column:
    """The columns of a header that a file lacks, in their order."""
    return F.array_except(expected, found)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def write_recording(rows: DataFrame, path: str) -> None:
    """Recordings (stream, data, receive_time, exchange_time, symbol) as gzip JSON lines by symbol and day."""
    day = F.to_date(F.timestamp_seconds(F.col("receive_time").cast("double")))
    rows.withColumn("date", day).write.mode("append").partitionBy("symbol", "date").option("compression", "gzip").json(path)


def stream_to_csv(rows: DataFrame, path: str, checkpoint: str, **trigger):
    """A running query that appends CSV part files exactly once."""
    return rows.writeStream.format("csv").option("header", True).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def migrate(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; columns that one lacks are null (additive migration)."""
    return old.unionByName(new, allowMissingColumns=True)


def audit_rows(answers: DataFrame) -> DataFrame:
    """Interpretation audit: nested values as JSON text, times in ISO form."""
    nested = lambda t: t.startswith(("struct", "array", "map"))
    return answers.select(*[(F.to_json(c) if nested(t) else F.date_format(c, TIME) if t.startswith("timestamp") else F.col(c)).alias(c) for c, t in answers.dtypes])


def as_json(df: DataFrame, name: str = "value") -> DataFrame:
    """Each row as one JSON object: what an HTTP endpoint would answer."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def symbol_state(*parts: DataFrame) -> DataFrame:
    """One row for each symbol from several per-symbol tables, joined from the first on."""
    return reduce(lambda a, b: a.join(b, "symbol", "left"), parts)
