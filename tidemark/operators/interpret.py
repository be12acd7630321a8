"""The data side of machine-written interpretations: snapshots, repair, validation, audit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import redact_credentials, strip_fence

#: Fixed values of the response format.
RISKS = ("low", "medium", "high")
REGIMES = ("trending", "choppy", "absorbing", "sweep-heavy", "mixed")
REQUIRED = ("market_summary", "symbol_interpretations", "overall_risk", "cleanest_bias_symbols", "suppressed_symbols", "regime", "data_quality_warnings", "not_trade_advice")
NO_SUMMARY = "Provider returned a partial interpretation; schema repaired for display."


def compact_snapshot(rows: DataFrame) -> DataFrame:
    """(symbol, price, delta_1m, delta_5m, delta_15m, cvd, imbalance, action) rounded, as JSON, with its hash."""
    thousands = lambda c: (F.rint(F.col(c) / 1000) * 1000).cast("long")
    out = rows.select(
        "symbol", F.when(F.col("price") >= 1, F.bround("price", 2)).otherwise(F.bround("price", 4)).alias("price"),
        *[thousands(c).alias(c) for c in ("delta_1m", "delta_5m", "delta_15m", "cvd")], F.bround("imbalance", 2).alias("imbalance"), "action")
    body = F.concat_ws("|", F.format_string("%.4f", "price"), *[F.col(c).cast("string") for c in ("delta_1m", "delta_5m", "delta_15m", "cvd")], F.format_string("%.2f", "imbalance"), "action")
    return out.withColumn("snapshot", F.to_json(F.struct(*out.columns))).withColumn("input_hash", F.sha2(F.concat_ws("|", "symbol", body), 256))


def _text(json: Column, *paths: str) -> Column:
    """The first non-empty of the paths as trimmed text."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(json, f"$.{p}")), F.lit("")) for p in paths])


def _word(values: tuple[str, ...], *texts: Column) -> Column:
    """The first of ``values`` found in the first text that has one."""
    return F.coalesce(*[F.coalesce(*[F.when(F.lower(t).contains(v), v) for v in values]) for t in texts])


def _list(json: Column, *paths: str) -> Column:
    """The first non-empty path as array of texts; a single text becomes an array of one."""
    def one(p):
        raw = F.nullif(F.get_json_object(json, f"$.{p}"), F.lit(""))
        return F.when(raw.startswith("["), F.filter(F.from_json(raw, "array<string>"), lambda x: F.trim(x) != "")).when(raw.isNotNull(), F.array(raw))

    return F.coalesce(*[F.when(F.size(one(p)) > 0, one(p)) for p in paths], F.array().cast("array<string>"))


def repair(rows: DataFrame, json: str = "response") -> DataFrame:
    """``rows`` with ``repaired`` (a struct of the required fields) and whether anything had to change.

    Fields of other names are taken over, enumerations normalised, and
    defaults set: medium risk, mixed regime, empty lists.
    """
    j = F.col(json)
    summary = F.coalesce(_text(j, "market_summary", "overall_market_assessment", "market_assessment", "market_read", "summary", "market_conditions"), F.nullif(F.concat_ws(" | ", _text(j, "recent_activity"), _text(j, "risk_flags")), F.lit("")), F.lit(NO_SUMMARY))
    risk = F.coalesce(F.when(_text(j, "overall_risk").isin(*RISKS), _text(j, "overall_risk")), _word(RISKS, *[_text(j, p) for p in ("overall_risk", "risk", "risk_level", "risk_flags")]), F.lit("medium"))
    regime = F.coalesce(F.when(_text(j, "regime").isin(*REGIMES), _text(j, "regime")), _word(REGIMES, *[_text(j, p) for p in ("regime", "market_regime", "overall_market_assessment")]), F.lit("mixed"))
    symbols = F.coalesce(*[F.when(F.get_json_object(j, f"$.{p}").startswith("{"), F.get_json_object(j, f"$.{p}")) for p in ("symbol_interpretations", "symbol_insights", "symbol_analysis", "symbols")])
    details = F.coalesce(F.from_json(symbols, "map<string,string>"), F.create_map().cast("map<string,string>"))

    def interpreted(k, v):
        plain = ~v.startswith("{")
        return F.struct(
            F.when(plain, "WAITING").otherwise(F.coalesce(_text(v, "bias", "scanner_bias", "next_action"), F.lit("WAITING"))).alias("bias"),
            F.when(plain, F.trim(v)).otherwise(F.coalesce(_text(v, "explanation", "analysis"), v)).alias("explanation"),
            F.when(plain, 0.0).otherwise(F.coalesce(F.get_json_object(v, "$.confidence").try_cast("double"), F.lit(0.0))).alias("confidence"),
            F.when(plain, F.array().cast("array<string>")).otherwise(_list(v, "risk_flags", "risks")).alias("risk_flags"),
            F.when(plain, "").otherwise(F.coalesce(_text(v, "what_to_watch_next", "watch_next"), F.lit(""))).alias("what_to_watch_next"),
        )

    fixed = F.struct(
        summary.alias("market_summary"), F.transform_values(F.transform_keys(details, lambda k, _: F.upper(k)), interpreted).alias("symbol_interpretations"),
        risk.alias("overall_risk"), regime.alias("regime"), _list(j, "cleanest_bias_symbols", "cleanest_biases", "cleanest_symbols").alias("cleanest_bias_symbols"),
        _list(j, "suppressed_symbols", "suppressed_signals").alias("suppressed_symbols"), _list(j, "data_quality_warnings", "warnings").alias("data_quality_warnings"),
        F.coalesce(F.get_json_object(j, "$.not_trade_advice").try_cast("boolean"), F.lit(False)).alias("not_trade_advice"))
    whole = F.lit(True)
    for k in REQUIRED[:-1]:
        whole = whole & F.get_json_object(j, f"$.{k}").isNotNull()
    whole = whole & F.coalesce(_text(j, "overall_risk").isin(*RISKS) & _text(j, "regime").isin(*REGIMES), F.lit(False))
    return rows.withColumn("repaired", fixed).withColumn("changed", ~whole)


def validation_error(json: Column) -> Column:
    """Null for a valid response, else what is wrong with it first."""
    get = lambda k: F.get_json_object(json, f"$.{k}")
    checks = [F.when(json.isNull() | ~F.trim(json).startswith("{"), "Response is not a dictionary.")]
    checks += [F.when(get(k).isNull(), f"Missing required JSON schema key: '{k}'.") for k in REQUIRED]
    checks += [
        F.when(~get("overall_risk").isin(*RISKS), F.concat(F.lit("Invalid overall_risk value: '"), get("overall_risk"), F.lit("' (must be low, medium, or high)."))),
        F.when(~get("regime").isin(*REGIMES), F.concat(F.lit("Invalid regime value: '"), get("regime"), F.lit("' (must be trending, choppy, absorbing, sweep-heavy, or mixed)."))),
        F.when(~get("symbol_interpretations").startswith("{"), "symbol_interpretations is not an object."),
        F.when(~get("cleanest_bias_symbols").startswith("["), "cleanest_bias_symbols is not an array."),
        F.when(~get("suppressed_symbols").startswith("["), "suppressed_symbols is not an array."),
        F.when(get("not_trade_advice") != "true", "not_trade_advice must be set to true."),
    ]
    return F.coalesce(*checks)


def enforce_actions(told: DataFrame, actions: DataFrame) -> DataFrame:
    """(symbol, bias, ...) with the scanner's action in place of a bias that differs, which is kept beside it."""
    x = told.join(actions.select("symbol", "action"), "symbol", "left")
    differs = F.col("action").isNotNull() & ~F.col("bias").eqNullSafe(F.col("action"))
    return x.withColumn("reported_bias", F.when(differs, F.col("bias"))).withColumn("enforced", differs).withColumn("bias", F.when(differs, F.col("action")).otherwise(F.col("bias"))).drop("action")


def mismatches(enforced: DataFrame) -> DataFrame:
    return enforced.agg(F.count_if("enforced").alias("mismatches"), F.count("*").alias("symbols"))


def freshness(rows: DataFrame, now: Column, limit_ms: int = 30_000) -> DataFrame:
    """One row: the youngest depth age decides whether an interpretation may be asked for."""
    return rows.agg(F.min(now - F.col("depth_ms")).alias("age_ms")).withColumn("fresh", F.coalesce(F.col("age_ms") <= limit_ms, F.lit(False)))


def top_confidence(told: DataFrame, n: int = 6) -> DataFrame:
    return told.orderBy(F.desc("confidence"), "symbol").limit(n)


def provider_comparison(audit: DataFrame) -> DataFrame:
    """Per provider and model: calls, successes, repairs, fallbacks, average latency, last error."""
    return audit.groupBy("provider", "model").agg(
        F.count("*").alias("calls"), F.count_if("ok").alias("ok"), F.count_if("schema_repaired").alias("repaired"), F.count_if("fallback_used").alias("fallbacks"),
        F.round(F.sum("latency_ms").cast("double") / F.count("latency_ms"), 4).alias("latency_ms"), F.max(F.when(~F.col("ok"), F.struct("ms", "error"))).getField("error").alias("last_error"))


def rate_limited(calls: DataFrame, gap_ms: int = 30_000) -> DataFrame:
    """Manual calls (scope, ms) with whether the gap to the one before is long enough."""
    before = F.lag("ms").over(Window.partitionBy("scope").orderBy("ms"))
    return calls.withColumn("allowed", F.coalesce(F.col("ms") - before >= gap_ms, F.lit(True)))


ANSWER = "scope string, provider string, model string, ok boolean, raw_text string, latency_ms long, error string"


def ask(requests: DataFrame, call: Callable[[str], str], provider: str, model: str) -> DataFrame:
    """Rows (scope, prompt) answered by ``call``, which runs on the executors; a failure is a row with its error."""

    def answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for batch in batches:
            rows = []
            for scope, prompt in zip(batch["scope"], batch["prompt"], strict=True):
                began, text, error = time.monotonic(), None, None
                try:
                    text = call(prompt)
                except Exception as e:  # noqa: BLE001  whatever a provider raises is an answer that failed
                    error = str(e)
                rows.append((scope, provider, model, error is None, text, int((time.monotonic() - began) * 1000), error))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in ANSWER.split(", ")])

    out = requests.select("scope", "prompt").mapInPandas(answers, ANSWER)
    return out.withColumn("raw_text", strip_fence(F.col("raw_text"))).withColumn("error", redact_credentials(F.col("error")))


#: Fixed by the services: where each one's response holds the answer.
ANSWER_PATHS = {
    "openai": "$.choices[0].message.content",
    "deepseek": "$.choices[0].message.content",
    "gemini": "$.candidates[0].content.parts[0].text",
    "claude": "$.content[0].text",
}


def answers_of(responses: DataFrame) -> DataFrame:
    """Stored responses (provider, body: JSON text, ...) with ``raw_text``, ``ok`` and ``error``.

    The answer lies where the provider puts it and loses its fence. It is good
    if it is JSON (whether of the right form :func:`validation_error` tells);
    else the error says what is wrong, and the whole body stands in its place,
    without credentials.
    """
    text = F.lit(None).cast("string")
    for provider, path in ANSWER_PATHS.items():
        text = F.when(F.lower("provider") == provider, F.get_json_object("body", path)).otherwise(text)
    raw = strip_fence(text)
    parsed = F.try_parse_json(raw)
    error = (
        F.when(~F.coalesce(F.lower("provider").isin(*ANSWER_PATHS), F.lit(False)), "Unknown provider.")
        .when(raw.isNull(), "JSON Parse Error: the response holds no answer.")
        .when(parsed.isNull(), "JSON Parse Error: the answer is no JSON.")
    )
    shown = F.when(error.isNull(), raw).otherwise(redact_credentials(F.col("body")))
    return responses.withColumns({"raw_text": shown, "error": error}).withColumn("ok", F.col("error").isNull())
