"""Health counters of queries while they run, without a pass of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

#: Verdicts of depth messages that are counted, by counter.
COUNTED = {"gaps": "GAP", "duplicates": "DUPLICATE", "out_of_order": "OUT_OF_ORDER"}


def counters(symbols: list[str], latency_ms: Column | None = None) -> list[Column]:
    """Aggregates over depth messages (symbol, verdict, epoch) of the watched symbols, named ``counter:symbol``."""
    out = []
    for s in symbols:
        own = F.col("symbol") == s
        out += [F.count_if(own).alias(f"messages:{s}"), F.max(F.when(own, F.col("epoch"))).alias(f"resyncs:{s}")]
        out += [F.count_if(own & (F.col("verdict") == v)).alias(f"{n}:{s}") for n, v in COUNTED.items()]
        if latency_ms is not None:
            out.append(F.max(F.when(own, latency_ms)).alias(f"latency:{s}"))
    return out


def by_symbol(metrics: dict) -> dict[str, dict[str, int]]:
    """Observed figures by symbol; symbols without a message are left out."""
    out: dict[str, dict[str, int]] = {}
    for name, value in metrics.items():
        counter, symbol = name.split(":", 1)
        out.setdefault(symbol, {})[counter] = value
    return {s: x for s, x in out.items() if x["messages"]}


def observed(verdicts: DataFrame, symbols: list[str]) -> tuple[DataFrame, Observation]:
    """``verdicts`` that count themselves while something else is done with them; ``by_symbol(observation.get)`` tells once that is done."""
    watch = Observation("depth health")
    return verdicts.observe(watch, *counters(symbols)), watch


class HealthListener(StreamingQueryListener):
    """Keeps the counters of running streams that call ``observe(name, *counters(...))``: sums over micro-batches, the largest of resyncs and latencies."""

    def __init__(self, name: str):
        self.name, self.totals = name, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        for symbol, figures in by_symbol(row.asDict() if row else {}).items():
            known = self.totals.setdefault(symbol, {})
            for counter, value in figures.items():
                largest = counter in ("resyncs", "latency")
                known[counter] = max(known.get(counter, 0), value or 0) if largest else known.get(counter, 0) + value

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
