"""Market context of a symbol: marks, open interest, klines, REST depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import labels


def open_interest_change(rows: DataFrame) -> DataFrame:
    """(symbol, ms, open_interest) with the change in percent since the row before; null where that isn't positive."""
    before = F.lag("open_interest").over(Window.partitionBy("symbol").orderBy("ms"))
    return rows.withColumn("_before", before).withColumn("oi_change_pct", F.when(F.col("_before") > 0, (F.col("open_interest") - F.col("_before")) / F.col("_before") * 100)).drop("_before")


def kline_trends(klines: DataFrame) -> DataFrame:
    """(symbol, trend_1m, trend_5m, trend_15m) of the last kline (symbol, interval, ms, open, close) of each interval."""
    last = klines.groupBy("symbol", "interval").agg(F.max_by(F.struct("open", "close"), "ms").alias("k"))
    trend = labels.kline_trend(F.col("k.open").cast("double"), F.col("k.close").cast("double"))
    pivot = last.withColumn("t", trend).groupBy("symbol").pivot("interval", ["1m", "5m", "15m"]).agg(F.first("t"))
    return pivot.select("symbol", *[F.col(i).alias(f"trend_{i}") for i in ("1m", "5m", "15m")])


def market_context(rows: DataFrame) -> DataFrame:
    """Rows (symbol, action, mark, index, funding_rate, open_interest, oi_change_pct, trends, rest_imbalance, imbalance) with premium, drift, quality, warnings and label."""
    out = rows.withColumns({
        "premium_pct": labels.premium_pct(F.col("mark"), F.col("index")), "funding_pct": F.col("funding_rate") * 100,
        "drift": F.abs(F.col("rest_imbalance") - F.col("imbalance")),
        "quality": labels.context_quality(F.col("mark"), F.col("index"), F.col("open_interest"), F.col("trend_5m"), F.col("rest_imbalance")),
    })
    out = out.withColumn("warnings", labels.context_warnings(F.col("quality"), F.col("funding_pct"), F.col("premium_pct"), F.col("drift"), F.col("imbalance")))
    return out.withColumn("label", labels.context_label(*[F.col(c) for c in ("action", "quality", "trend_5m", "trend_15m", "premium_pct", "rest_imbalance", "oi_change_pct")]))


# --- from REST responses ------------------------------------------------------------------------


def from_responses(responses: DataFrame) -> DataFrame:
    """One row for each symbol from landed responses (symbol, endpoint, ms, body: JSON text), the last of each endpoint.

    Endpoints: premiumIndex, depth, bookTicker, openInterest, and klines_1m,
    klines_5m, klines_15m. Gives mark, index, funding_rate, next_funding, bid,
    ask, rest_imbalance, open_interest and its change since the response
    before, and the trend of each interval's last kline. What an endpoint
    hasn't told, or not as a number, is null; a body that is no JSON tells
    nothing.
    """
    number = lambda path: F.get_json_object("body", path).try_cast("double")
    at = lambda endpoint: responses.where(F.col("endpoint") == endpoint).select("symbol", "ms", "body")
    last = lambda df, **columns: df.groupBy("symbol").agg(*[F.max(F.struct("ms", c.alias("v"))).getField("v").alias(n) for n, c in columns.items()])
    side = lambda name: F.from_json(F.get_json_object("body", f"$.{name}"), "array<array<string>>")
    worth = lambda levels: F.aggregate(F.coalesce(levels, F.array().cast("array<array<string>>")), F.lit(0.0), lambda s, x: s + F.coalesce(x[0].try_cast("double") * x[1].try_cast("double"), F.lit(0.0)))
    bids, asks = worth(side("bids")), worth(side("asks"))
    interest = open_interest_change(at("openInterest").select("symbol", "ms", number("$.openInterest").alias("open_interest")).where("open_interest is not null"))
    out = responses.select("symbol").distinct()
    out = out.join(last(at("premiumIndex"), mark=number("$.markPrice"), index=number("$.indexPrice"), funding_rate=number("$.lastFundingRate"), next_funding=F.get_json_object("body", "$.nextFundingTime").try_cast("long")), "symbol", "left")
    out = out.join(last(at("depth"), rest_imbalance=F.when(bids + asks > 0, (bids - asks) / (bids + asks))), "symbol", "left")
    out = out.join(last(at("bookTicker"), bid=number("$.bidPrice"), ask=number("$.askPrice")), "symbol", "left")
    out = out.join(last(interest, open_interest=F.col("open_interest"), oi_change_pct=F.col("oi_change_pct")), "symbol", "left")
    # A kline is an array: open time, open, high, low, close; the last one counts.
    lines = responses.where(F.col("endpoint").startswith("klines_")).select("symbol", F.substring_index("endpoint", "_", -1).alias("interval"), F.explode(F.from_json("body", "array<array<string>>")).alias("k"))
    klines = lines.select("symbol", "interval", F.col("k")[0].try_cast("long").alias("ms"), F.col("k")[1].alias("open"), F.col("k")[4].alias("close")).where("ms is not null")
    return out.join(kline_trends(klines), "symbol", "left")
