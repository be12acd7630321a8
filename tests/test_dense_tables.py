"""Queries on tables so dense that pairs of rows near each other far outnumber the rows; against their SQL."""

from __future__ import annotations

import random

import duckdb
import pytest

import __spark_entry__
from tidemark.operators import outcomes

EVENTS = 3_000


@pytest.fixture(scope="module")
def dense(spark, tmp_path_factory):
    """Some 26 minutes of trades, of which the first holds nearly all."""
    r, d = random.Random(4), tmp_path_factory.mktemp("dense")
    kinds = ("click", "error", "purchase", "signup", "view")
    rows = [(i, (1_704_067_200 + (r.randint(0, 3_599) if i % 10 else 600 * r.randint(0, 155))) * 1_000_000 + r.randint(0, 999_999), r.randint(0, 99), r.choice(kinds), r.randint(1, 900) / 4, f'{{"k": {r.randint(0, 99)}}}') for i in range(EVENTS)]
    df = spark.createDataFrame(rows, "event_id long, micros long, user_id long, event_type string, value double, props string")
    df.selectExpr("event_id", "timestamp_micros(micros) as ts", "user_id", "event_type", "value", "props").write.parquet(str(d / "events.parquet"))
    return str(d)


def plain(rows):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else str(x) for x in row) for row in rows)


def of_sql(name, d):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{d}/events.parquet/*.parquet')")
    return con.execute(__spark_entry__.oracle_sql()[name])


def rows_made(spark, run):
    """What ``run`` gives, and the most rows that a step of the plans made that it ran."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    each = lambda seq: [seq.apply(i) for i in range(seq.size())]
    bus.waitUntilEmpty(60_000)
    before, most = {e.executionId() for e in each(store.executionsList())}, 0
    out = run()
    bus.waitUntilEmpty(60_000)
    for e in {e.executionId() for e in each(store.executionsList())} - before:
        values = store.executionMetrics(e)
        ids = [m.accumulatorId() for node in each(store.planGraph(e).allNodes()) for m in each(node.metrics()) if m.name() == "number of output rows"]
        most = max([most, *(int(values.apply(i).replace(",", "")) for i in ids if values.contains(i))])
    return out, most


@pytest.mark.parametrize("name", ["a17_performance_report", "j7_a16_forward_excursion", "s13_performance_log", "s10_s20_signal_log", "a18_bias_performance"])
def test_rows_grow_with_the_table_and_not_with_pairs(spark, dense, name):
    want = of_sql(name, dense)
    columns = [c[0] for c in want.description]
    got, most = rows_made(spark, lambda: __spark_entry__.queries()[name](spark, dense).select(*columns).collect())
    assert plain(got) == plain(want.fetchall())
    assert EVENTS <= most < 10 * EVENTS


def test_prices_at_a_horizon_take_frames_that_only_grow(spark, dense):
    name = "j8_horizon_prices"
    df = __spark_entry__.queries()[name](spark, dense)
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
    want = of_sql(name, dense)
    got = df.select(*[c[0] for c in want.description]).collect()
    assert plain(got) == plain(want.fetchall())


def test_trades_without_a_price_are_passed_over(spark):
    s = spark.createDataFrame([(1, "btc", 0, "CONFIRMED_LONG", 10.0)], "signal_id long, symbol string, ms long, action string, price double")
    t = spark.createDataFrame([("btc", 1, 60_000, None), ("btc", 2, 61_000, 11.0), ("btc", 3, 70_000, None)], "symbol string, agg_id long, ms long, price double")
    assert outcomes.horizon_prices(s, t).first().after_1m == 11.0
    assert outcomes.forward_excursion(s, t).first().final_5m == 10.0
