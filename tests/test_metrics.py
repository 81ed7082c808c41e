from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from storyloom.operators import alerts as al
from storyloom.operators import metrics as mt

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)
HOUR = timedelta(hours=1)


def events(spark, offsets):
    return spark.createDataFrame([("a", T0 + timedelta(seconds=s)) for s in offsets], "k string, ts timestamp")


def test_buckets_are_cumulative_and_inclusive(spark):
    df = spark.createDataFrame([("x", v) for v in (0.1, 0.5, 0.51, 70.0)] + [("x", None)], "k string, s double")
    got = {r.le: r.n for r in mt.latency_histogram(df, F.col("s"), ["k"], [0.1, 0.5, 60.0]).collect()}
    assert got == {"0.1": 1, "0.5": 2, "60": 3, "+Inf": 4}


@pytest.mark.parametrize(("values", "q", "want"), [([0.2] * 10, 0.5, 0.3), ([0.2] * 5 + [3.0] * 5, 0.95, 4.6), ([99.0], 0.9, 5.0)])
def test_quantile_interpolates_within_its_bucket(spark, values, q, want):
    df = spark.createDataFrame([("x", v) for v in values], "k string, s double")
    buckets = mt.latency_histogram(df, F.col("s"), ["k"], [0.1, 0.5, 1.0, 5.0])
    assert mt.histogram_quantile(buckets, ["k"], q).first()["quantile"] == pytest.approx(want)


def test_increase_covers_the_half_open_window(spark):
    df = events(spark, [0, 1, 3600])
    assert mt.increase(df, ["k"], T0 + HOUR, HOUR).first().increase == 2
    assert mt.rate(df, ["k"], T0 + HOUR, HOUR).first().rate == pytest.approx(2 / 3600)


def test_sliding_increase_equals_increase_at_every_tick(spark):
    df = events(spark, [0, 10, 3599, 3600, 3601, 9000])
    got = {r.tick.replace(tzinfo=timezone.utc): r.increase
           for r in mt.sliding_increase(df, ["k"], 2 * HOUR, HOUR).withColumn("tick", F.col("tick").cast("timestamp_ntz")).collect()}
    for i in range(6):
        now = T0 + i * HOUR
        row = mt.increase(df, ["k"], now, 2 * HOUR).first()
        assert got.get(now) == (row.increase if row else None), now


def samples(spark, values):
    rows = [("m", "s", T0 + i * HOUR, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "metric string, series string, tick timestamp, value double")


def rule(op, threshold, hold=timedelta(0)):
    return al.Rule("r", "m", op, threshold, "warning", "d", hold)


@pytest.mark.parametrize(
    ("op", "firing"), [("gt", [0, 0, 1]), ("lt", [1, 0, 0]), ("eq", [0, 1, 0]), ("ne", [1, 0, 1]), ("ge", [0, 0, 0])]
)
def test_operators(spark, op, firing):
    got = al.evaluate(samples(spark, [1, 2, 3]), [rule(op, 2.0)]).orderBy("tick").collect()
    assert [int(r.firing) for r in got] == firing


def test_edges_episodes_and_hold(spark):
    evaluated = al.evaluate(samples(spark, [0, 5, 5, 0, 5, 5, 5]), [rule("gt", 1.0, 2 * HOUR)])
    edges = [(r.status, r.value) for r in al.transitions(evaluated).orderBy("tick").collect()]
    assert edges == [("firing", 5.0), ("resolved", 0.0), ("firing", 5.0)]
    hours = lambda t: None if t is None else int((t.replace(tzinfo=timezone.utc) - T0) / HOUR)
    plain = lambda df, *cs: df.select(*[F.col(c).cast("timestamp_ntz") for c in cs]).collect()
    found = sorted([tuple(hours(t) for t in r) for r in plain(al.episodes(evaluated), "starts_at", "ends_at")])
    assert found == [(1, 3), (4, None)]
    held = [tuple(hours(t) for t in r) for r in plain(al.held_alerts(evaluated), "pending_since", "fired_at", "ended_at")]
    assert held == [(4, 6, None)]


def test_resolved_edge_carries_start_and_value(spark):
    evaluated = al.evaluate(samples(spark, [5, 0]), [rule("gt", 1.0)])
    got = al.alert_payloads(al.edges_with_start(evaluated)).orderBy("tick").collect()
    assert '"color":15158332' in got[0].embed_payload and '"value":"5.00"' in got[1].embed_payload
    assert '"color":"good"' in got[1].attachment_payload and f'"ts":{int(T0.timestamp())}' in got[1].attachment_payload


def test_standard_rules_are_complete():
    assert len(al.STANDARD_RULES) == 8 and len(al.VOLUME_RULES) == 3
    assert {r.operator for r in al.STANDARD_RULES} == {"gt", "lt", "eq"}


def test_daily_ingestion_shows_empty_days(spark):
    logs = spark.createDataFrame(
        [(T0, "processed"), (T0, "save_failed"), (T0 + timedelta(days=2), "processed")], "created_at timestamp, status string"
    )
    got = [(str(r.day), r.saved, r.failed) for r in mt.daily_ingestion(logs, T0 + timedelta(days=2), 3).orderBy("day").collect()]
    assert got == [("2025-01-01", 1, 1), ("2025-01-02", 0, 0), ("2025-01-03", 1, 0)]
