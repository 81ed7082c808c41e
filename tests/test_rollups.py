"""Roll-ups of a stream with late events, replays and bases against the events themselves."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from storyloom.plans import stream_queries
from storyloom.plans.metric_queries import stage_events
from storyloom.operators import metrics
from storyloom.streaming import rollups

T0 = datetime(2025, 6, 30, 22, 58, tzinfo=timezone.utc)
SCHEMA = "ts timestamp, stage string, ok boolean, seconds double"
DRAIN = {"availableNow": True}


def make_events(spark, seed, n):
    rng = random.Random(seed)
    edges = [0, 60, 120, 3600, 3720]
    at = lambda: T0 + timedelta(seconds=rng.choice([rng.uniform(0, 7200), rng.choice(edges)]))
    rows = [(at(), rng.choice(["fetch", "save", "summary", "delivery"]), rng.random() < 0.7, rng.choice([None, rng.expovariate(1)])) for _ in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def plain(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in df.select(*sorted(df.columns)).collect())


def check(spark, path, events):
    for minutes, window in ((2, 1), (62, 60), (62, 3), (120, 120), (1, 1)):
        now = T0 + timedelta(minutes=minutes)
        want = metrics.latency_p95(events, now, timedelta(minutes=window))
        assert plain(rollups.rollup_p95(spark, path, now, timedelta(minutes=window))) == plain(want)
    saves = events.filter("stage = 'save'").select(F.col("ts").alias("created_at"), F.when(F.col("ok"), "processed").otherwise("save_failed").alias("status"))
    now = T0 + timedelta(days=3)
    assert plain(rollups.rollup_daily_ingestion(spark, path, now, 5)) == plain(metrics.daily_ingestion(saves, now, 5))
    for level in rollups.LEVELS:
        sums = events.groupBy("stage", F.date_trunc(level, "ts").alias("slot")).agg(F.count(F.lit(1)).alias("events"), F.count_if("ok").alias("good"))
        got = rollups.read_totals(spark, path, level).groupBy("stage", "slot").agg(F.sum("events").alias("events"), F.sum("good").alias("good"))
        assert plain(got) == plain(sums)


def test_totals_follow_late_batches_replays_and_bases(spark, tmp_path):
    path, landing = str(tmp_path / "rollups"), str(tmp_path / "landing")
    parts = [make_events(spark, seed, 150).coalesce(1) for seed in range(4)]  # all over the same two hours
    so_far = parts[0].limit(0)
    for run, part in enumerate(parts):
        part.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(SCHEMA).parquet(landing)
        rollups.rollup_stream(stream, path, str(tmp_path / "state"), DRAIN).awaitTermination()
        so_far = so_far.unionByName(part)
        if run == 2:
            rollups.add_totals(part, path, run)  # a batch that is run again
            rollups.compact(spark, path, 1)
            rollups.compact(spark, path, 1)
    check(spark, path, so_far)
    rollups.compact(spark, path, 3)
    check(spark, path, so_far)


def test_a_base_without_its_mark_does_not_count(spark, tmp_path):
    path = str(tmp_path / "rollups")
    parts = [make_events(spark, seed, 50) for seed in (7, 8)]
    for run, part in enumerate(parts):
        rollups.add_totals(part, path, run)
    # The driver went down while it wrote a base.
    rollups.totals(parts[0]).limit(3).write.parquet(f"{path}/minute-base/run=1")
    check(spark, path, parts[0].unionByName(parts[1]))
    rollups.compact(spark, path, 1)
    check(spark, path, parts[0].unionByName(parts[1]))


def test_minutes_hold_whole_minutes(spark, tmp_path):
    with pytest.raises(ValueError):
        rollups.rollup_p95(spark, str(tmp_path), T0 + timedelta(seconds=1), timedelta(minutes=1))


def test_stage_events_land_in_files_of_many_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(stream_queries, "shared_folder", lambda _, name: str(tmp_path / name))
    path = stream_queries._rollups(spark, "/root/testdata/sf0.001")
    assert len(list((tmp_path / "stage-events").glob("*.parquet"))) > 4
    assert sorted(p.name for p in (tmp_path / "rollups" / "hour").glob("run=*")) == [f"run={k}" for k in range(4)]
    assert rollups.read_totals(spark, path, "day").agg({"events": "sum"}).first()[0] == stage_events(spark, "/root/testdata/sf0.001").count()
