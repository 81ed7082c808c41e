"""Running values over blocks, and sums told by their changes, against plain loops."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from storyloom.operators import alerts, metrics
from storyloom.operators.ordering import along

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
STEP = timedelta(seconds=30)
S0 = int(T0.timestamp()) // 30


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_along_carries_between_blocks(spark, block):
    rng = random.Random(block)
    rows = [(k, p, rng.choice([None, 1, 2, 5])) for k in ("a", None, "b") for p in rng.sample(range(-30, 30), 20)]
    rows.append(("alone", 7, 3))
    df = spark.createDataFrame(rows, "k string, p long, v long")
    found = along(df, ["k"], "p", block, sums={"total": "v"}, previous={"last": "v"}, following="next")
    want = set()
    for key in {r[0] for r in rows}:
        mine = sorted((p, v) for k, p, v in rows if k == key)
        for i, (p, v) in enumerate(mine):
            total = sum(x or 0 for _, x in mine[: i + 1])
            want.add((key, p, v, total, mine[i - 1][1] if i else None, mine[i + 1][0] if i + 1 < len(mine) else None))
    got = {tuple(r) for r in found.collect()}
    assert got == want and found.count() == len(rows)


def events(spark, seed, n=60):
    rng = random.Random(seed)
    rows = [(rng.choice(["x", None, "y"]), T0 + timedelta(microseconds=rng.choice([0, 30_000_000, rng.randrange(600_000_000)])), rng.randint(-3, 5)) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "s string, ts timestamp, v long")


def expected(rows, key, slot, window):
    at = T0 + timedelta(seconds=30 * (slot - S0))
    inside = [v for s, ts, v in rows if s == key and at - window < ts <= at]
    return len(inside), sum(inside)


@pytest.mark.parametrize("seed,steps,block", [(1, 1, 100_000), (2, 7, 3), (3, 40, 100_000)])
def test_changes_hold_between_their_ticks(spark, seed, steps, block, monkeypatch):
    monkeypatch.setattr(metrics, "BLOCK_STEPS", block)
    rows, df = events(spark, seed)
    window = steps * STEP
    found = metrics.window_changes(df, ["s"], window, STEP, {"v": F.col("v")}).collect()
    for r in found:
        for slot in {r.slot, (r.until or r.slot + 1) - 1}:
            assert (r.events, r.v) == expected(rows, r.s, slot, window)
        assert (r.events_before, r.v_before) == expected(rows, r.s, r.slot - 1, window)
    assert len(found) <= 2 * len(rows) and all(r.until is not None or r.events == 0 for r in found)
    dense = {(r.s, int(r.tick.timestamp()) // 30): r.increase for r in metrics.sliding_increase(df, ["s"], window, STEP, F.col("v")).collect()}
    slots = range(S0 - 2, S0 + 25 + steps)
    want = {(s, t): expected(rows, s, t, window) for s in ("x", None, "y") for t in slots}
    assert dense == {k: v for k, (n, v) in want.items() if n}


def test_a_period_begins_with_every_series(spark):
    rows, df = events(spark, 4)
    series = spark.createDataFrame([("x",), (None,), ("y",), ("quiet",)], "s string")
    period = (T0 + 3 * STEP, T0 + 12 * STEP)
    found = metrics.window_changes(df, ["s"], 2 * STEP, STEP, {"v": F.col("v")}, series, period).collect()
    firsts = [r for r in found if r.slot == S0 + 3]
    assert len(firsts) == 4 and all(r.v_before is None and r.events_before is None for r in firsts)
    covered = sorted((str(r.s), t) for r in found for t in range(r.slot, r.until or S0 + 13))
    assert covered == sorted((s, t) for s in ("None", "quiet", "x", "y") for t in range(S0 + 3, S0 + 13))
    for r in found:
        assert (r.events, r.v) == (expected(rows, r.s, r.slot, 2 * STEP) if r.s != "quiet" else (0, 0))
    with pytest.raises(ValueError):
        metrics.window_changes(df, ["s"], STEP, STEP, {}, series, (T0 + timedelta(seconds=1), T0))


def test_held_alerts_of_changes_equal_those_of_all_ticks(spark):
    rows, df = events(spark, 5, 40)
    rules = [
        alerts.Rule("some", "n", "gt", 0.0, "w", "d", timedelta(seconds=50)),
        alerts.Rule("none", "n", "eq", 0.0, "w", "d", timedelta(seconds=60)),
        alerts.Rule("odd", "n", "between", 0.0, "w", "d"),
    ]
    series = spark.createDataFrame([("x",), ("y",), ("z",)], "s string")
    period = (T0, T0 + 30 * STEP)
    named = df.filter("s IS NOT NULL")
    grown = metrics.sliding_increase(named, ["s"], 2 * STEP, STEP)
    full = alerts.on_ticks(grown, ["s"], series, *period, STEP)
    dense = alerts.evaluate(full.select(F.lit("n").alias("metric"), F.col("s").alias("series"), "tick", F.col("increase").cast("double").alias("value")), rules)
    changes = metrics.window_changes(named, ["s"], 2 * STEP, STEP, {"n": F.lit(1)}, series, period)
    sparse = alerts.evaluate_changes(alerts.value_changes(changes, "n", F.col("s"), lambda get: get("n"), STEP), rules)

    def plain(df):
        return sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())

    assert plain(alerts.held_changes(sparse, period[1], STEP)) == plain(alerts.held_alerts(dense))
    for of in (alerts.transitions, alerts.episodes, alerts.edges_with_start):
        assert plain(of(sparse)) == plain(of(dense))
    assert sparse.count() < dense.count()


def test_gauges_keep_their_last_value(spark):
    at = [(-100, 1, 1.0), (-40, 2, 0.0), (10, 3, 5.0), (10, 4, 6.0), (200, 5, 0.0), (10_000, 6, 9.0)]
    rows = [("g", T0 + timedelta(seconds=s), n, v) for s, n, v in at]
    df = spark.createDataFrame(rows, "s string, ts timestamp, seq long, value double")
    found = metrics.gauge_changes(df, ["s"], STEP, (T0, T0 + 20 * STEP)).orderBy("slot").collect()
    assert [(r.slot - S0, r.until and r.until - S0, r.value, r.value_before) for r in found] == [
        (0, 1, 0.0, None), (1, 7, 6.0, 0.0), (7, None, 0.0, 6.0),
    ]


def test_counters_tell_open_breakers_and_deliveries_given_up(spark):
    logs = spark.createDataFrame(
        [("f", "error", "Circuit breaker is open", 0), ("f", "error", "HTTP 500", 0), ("f", "success", "", 2)],
        "feed_url string, status string, message string, new_articles long",
    )
    hooks = spark.createDataFrame([(500, 1), (500, 2), (500, 3), (None, 3), (204, 3)], "response_code int, attempt int")
    summaries = spark.createDataFrame([], "model string, status string")
    admitted = spark.createDataFrame([], "feed_url string, status string")
    rows = {(r.metric, r.value_1, r.value_2): r.total for r in metrics.counter_metrics(logs, admitted, summaries, hooks).collect()}
    assert rows["rss_fetch_total", "f", "circuit_breaker_open"] == rows["rss_fetch_total", "f", "error"] == 1
    assert rows["rss_fetch_errors_total", "f", "circuit_breaker_open"] == 1
    assert rows["discord_webhook_errors_total", "max_retries_exceeded", ""] == 2
    assert rows["discord_webhook_errors_total", "server_error", ""] == 3
