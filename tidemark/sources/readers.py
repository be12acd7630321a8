"""Sources: recordings, raw trade and depth messages, sweeps, event logs, snapshots.

All files are read by Spark with explicit schemas, in batch or as streams of
landing files; bad rows become nulls and are filtered, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDING = "stream string, data string, receive_time double, exchange_time double"
TRADE_FIELDS = "struct<e:string,p:string,q:string,T:bigint,m:boolean,a:bigint,s:string,price:double,quantity:double,side:string,timestamp:double>"
#: States of sweeps that a restart takes up again.
LIVE_STATES = ("RAW_SWEEP", "MSS_PENDING", "VALID_ENTRY_READY")
FLOW_EVENTS = (
    "timestamp string, symbol string, window string, event_type string, buy_volume double, sell_volume double, delta double, cvd double, buy_ratio double, sell_ratio double, price double, "
    "sweep_id string, source_sweep_time string, confluence_score int, matched_conditions string, order_book_imbalance_at_score double, depth_snapshot_age_ms double, notes string"
)
BIAS_SIGNALS = (
    "signal_id string, symbol string, action string, direction string, entry_time string, entry_price double, entry_delta_5m double, entry_imbalance double, entry_aggression double, entry_latest_event string, entry_cvd double, "
    "price_after_1m double, price_after_5m double, price_after_15m double, max_favorable_pct double, max_adverse_pct double, final_return_pct double, completed_time string"
)


#: REST tables of the market context: fields, and how often they are fetched.
REST_TABLES = {
    "mark_prices": ("symbol string, markPrice string, indexPrice string, lastFundingRate string, time long", 30_000),
    "book_tickers": ("symbol string, bidPrice string, bidQty string, askPrice string, askQty string, time long", 30_000),
    "depth_snapshots": ("symbol string, lastUpdateId long, bids array<array<string>>, asks array<array<string>>, time long", 30_000),
    "open_interest": ("symbol string, openInterest string, time long", 60_000),
    "klines": ("symbol string, interval string, openTime long, open string, high string, low string, close string, volume string, closeTime long", 60_000),
}


def rest_table(spark: SparkSession, path: str, name: str, streaming: bool = False) -> DataFrame:
    """A REST table from landed JSON lines, with numbers parsed (null where malformed)."""
    reader = (spark.readStream if streaming else spark.read).schema(REST_TABLES[name][0]).option("mode", "DROPMALFORMED")
    rows = reader.json(path).where("symbol is not null").withColumn("symbol", F.lower("symbol"))
    number = [f.name for f in rows.schema if f.dataType.simpleString() == "string" and f.name not in ("symbol", "interval")]
    return rows.withColumns({c: F.col(c).try_cast("double") for c in number})


def due(rows: DataFrame, name: str, at: str = "time") -> DataFrame:
    """The last row of each symbol in each fetch of the table's cadence."""
    own = F.floor(F.col(at) / REST_TABLES[name][1])
    return rows.groupBy("symbol", own.alias("fetch")).agg(F.max_by(F.struct(*[c for c in rows.columns if c != "symbol"]), at).alias("x")).select("symbol", "fetch", "x.*")


def stream_symbol(stream: Column) -> Column:
    return F.lower(F.split_part(stream, F.lit("@"), F.lit(1)))


def parse_trade(json: Column) -> Column:
    """A trade from a raw message (p, q, T, m, a) or from a parsed one (price, quantity, timestamp, side).

    The buyer being the maker means that the seller was the aggressor. Null
    where price, quantity or time are missing.
    """
    x = F.from_json(json, TRADE_FIELDS, {"mode": "PERMISSIVE"})
    price = F.coalesce(x["p"].try_cast("double"), x["price"])
    quantity = F.coalesce(x["q"].try_cast("double"), x["quantity"])
    ms = F.coalesce(x["T"], F.round(x["timestamp"] * 1000).cast("bigint"))
    side = F.when(x["m"], "SELL").when(~x["m"], "BUY").otherwise(x["side"])
    whole = price.isNotNull() & quantity.isNotNull() & ms.isNotNull() & side.isNotNull()
    return F.when(whole & F.coalesce(x["e"] == "aggTrade", F.lit(True)), F.struct(ms.alias("ms"), price.alias("price"), quantity.alias("quantity"), side.alias("side"), F.coalesce(x["a"], F.lit(0)).alias("agg_id"), F.to_date(F.timestamp_millis(ms)).alias("day"), (price.cast("decimal(18,6)") * quantity.cast("decimal(18,6)")).cast("decimal(28,6)").alias("notional")))


def parse_depth(json: Column) -> Column:
    """A depth message; names differ in case only (e and E, u and U), so fields are taken by path."""
    get = lambda name, kind: F.get_json_object(json, f"$.{name}").try_cast(kind)
    side = lambda name: F.from_json(F.get_json_object(json, f"$.{name}"), "array<array<string>>")
    fields = F.struct(get("E", "long").alias("ms"), get("U", "long").alias("first_u"), get("u", "long").alias("u"), get("pu", "long").alias("pu"), side("b").alias("bids"), side("a").alias("asks"))
    return F.when((get("e", "string") == "depthUpdate") & get("u", "long").isNotNull(), fields)


def recordings(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Rows of gzip JSON lines with symbol (from the stream, else the file name) and receive time.

    ``data`` stays JSON text; :func:`trades_of` and :func:`depth_of` parse it.
    """
    reader = spark.readStream if streaming else spark.read
    rows = reader.schema(RECORDING).option("mode", "DROPMALFORMED").json(path)
    by_file = F.lower(F.regexp_extract(F.input_file_name(), r"recording_([^_/]+)_", 1))
    symbol = F.when(F.coalesce(F.col("stream"), F.lit("")) != "", stream_symbol(F.col("stream"))).otherwise(by_file)
    return rows.withColumn("symbol", symbol)


def trades_of(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("stream").contains("@aggTrade")).select("symbol", "receive_time", parse_trade(F.col("data")).alias("t")).where("t is not null").select("symbol", "receive_time", "t.*")


def depth_of(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("stream").contains("@depth")).select("symbol", "receive_time", parse_depth(F.col("data")).alias("x")).where("x is not null").select("symbol", "receive_time", "x.*")


def level_changes(depth: DataFrame) -> DataFrame:
    """(symbol, u, ms, side, price, qty): one row for each changed level of depth messages."""
    side = lambda c, name: F.transform(F.coalesce(c, F.array().cast("array<array<string>>")), lambda x: F.struct(F.lit(name).alias("side"), F.get(x, F.lit(0)).try_cast("double").alias("price"), F.get(x, F.lit(1)).try_cast("double").alias("qty")))
    rows = depth.select("symbol", "u", "ms", F.explode(F.concat(side(F.col("bids"), "BID"), side(F.col("asks"), "ASK"))).alias("c"))
    return rows.select("symbol", "u", "ms", "c.*").where("price is not null and qty is not null")


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """REST depth snapshots (symbol, last_id, bids, asks), one JSON object for each line with its symbol."""
    return spark.read.schema("symbol string, lastUpdateId long, bids array<array<string>>, asks array<array<string>>").json(path).select(F.lower("symbol").alias("symbol"), F.col("lastUpdateId").alias("last_id"), "bids", "asks")


def _time(c: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


def sweeps(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """The sweeps in the files of a folder (:func:`parse_sweeps`)."""
    return parse_sweeps((spark.readStream if streaming else spark.read).text(path))


def parse_sweeps(lines: DataFrame) -> DataFrame:
    """(sweep_id, symbol, time, direction, level, state, source) from lines (``value``) of either width.

    Rows of 15 fields or more are positional (time, symbol, direction, level,
    then state at 7, id at 13, source at 14); shorter ones are the first
    format: the id is the fifth field, or is made of the first four where that
    is missing. Headers and rows of under four fields are dropped.
    """
    x = F.from_csv(F.col("value"), F.lit(", ".join(f"c{k} string" for k in range(15))), {"mode": "PERMISSIVE"})
    rows = lines.select(x.alias("x"), F.size(F.split("value", ",")).alias("n")).where("n >= 4 and lower(trim(x.c0)) <> 'timestamp'")
    wide = F.col("n") >= 15
    pick = lambda a, b: F.trim(F.when(wide, F.col(f"x.{a}")).otherwise(F.col(f"x.{b}") if b else F.lit(None)))
    made = F.concat(F.lit("swp_"), F.concat_ws("_", *[F.trim(f"x.c{k}") for k in range(4)]))
    return rows.select(
        F.when(F.col("n") == 4, made).otherwise(pick("c13", "c4")).alias("sweep_id"), F.lower(pick("c1", "c1")).alias("symbol"), _time(pick("c0", "c0")).alias("time"), F.upper(pick("c2", "c2")).alias("direction"),
        pick("c3", "c3").try_cast("double").alias("level"), F.when(wide, F.trim("x.c7")).when(F.col("n") > 7, F.trim("x.c7")).alias("state"), pick("c14", None).alias("source")).where("sweep_id <> '' and time is not null")


def sweeps_to_replay(rows: DataFrame, now: Column, hours: float = 12.0) -> DataFrame:
    """Live sweeps of an open state, at most ``hours`` old, one for each id."""
    age = F.unix_timestamp(now) - F.unix_timestamp(F.col("time"))
    return rows.where((F.col("source") == "live") & F.col("state").isin(*LIVE_STATES) & (age <= hours * 3600)).dropDuplicates(["sweep_id"])


def flow_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FLOW_EVENTS).option("header", True).option("mode", "DROPMALFORMED").csv(path).where("timestamp is not null")


def bias_signals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BIAS_SIGNALS).option("header", True).option("mode", "DROPMALFORMED").csv(path).where("signal_id is not null")


def csv_tail(df: DataFrame, by: str, n: int) -> DataFrame:
    """The last ``n`` rows in the order of ``by``."""
    return df.orderBy(F.desc(by)).limit(n)


def mock_sweeps(spark: SparkSession, symbols: list[str], n: int, start_s: int = 1_700_000_000) -> DataFrame:
    """``n`` generated sweeps, one a minute, for trials."""
    i = F.col("id")
    return spark.range(n).select(
        F.concat(F.lit("mock_"), i.cast("string")).alias("sweep_id"), F.get(F.array(*[F.lit(s) for s in symbols]), (i % len(symbols)).cast("int")).alias("symbol"),
        F.timestamp_seconds(start_s + i * 60).alias("time"), F.when(F.xxhash64(i) % 2 == 0, "BULLISH").otherwise("BEARISH").alias("direction"), (100 + F.pmod(F.xxhash64(i), F.lit(1000)) / 10).alias("level"),
        F.lit("RAW_SWEEP").alias("state"), F.lit("mock").alias("source"))
