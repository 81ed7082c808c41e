import random
from datetime import datetime, timedelta, timezone

import pytest

from storyloom.operators import breaker as br

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)
SECOND = 1_000_000


def states(events, config=br.FEED_BREAKER):
    rows, end = br.replay([(int(s * SECOND), ok) for s, ok in events], br.FRESH, config)
    return [(allowed, after, trip) for allowed, _, after, trip in rows], end


def test_opens_at_the_third_failure_and_rejects():
    got, end = states([(0, False), (1, False), (2, False), (3, True), (122, True)])
    assert got == [
        (True, "closed", False), (True, "closed", False), (True, "open", True), (False, "open", False), (False, "open", False),
    ]
    assert end == ("open", 0, 0, 2 * SECOND)


def test_half_open_needs_two_successes():
    base = [(0, False), (1, False), (2, False)]
    got, end = states([*base, (123, True), (124, True)])
    assert got[3:] == [(True, "half_open", False), (True, "closed", False)] and end == br.FRESH
    got, end = states([*base, (123, True), (124, False), (125, True)])
    assert got[3:] == [(True, "half_open", False), (True, "open", True), (False, "open", False)]


def test_success_and_calm_clear_the_count():
    got, _ = states([(0, False), (1, False), (2, True), (3, False), (4, False)])
    assert all(after == "closed" for _, after, _ in got)
    got, _ = states([(0, False), (1, False), (302, False), (303, False)])
    assert [trip for _, _, trip in got] == [False] * 4
    got, _ = states([(0, False), (1, False), (301, False)])
    assert got[-1] == (True, "open", True)


def test_other_settings():
    config = br.BreakerConfig(1, 1, timedelta(seconds=5), timedelta(seconds=5))
    got, end = states([(0, False), (5, True), (6, True)], config)
    assert got == [(True, "open", True), (False, "open", False), (True, "closed", False)] and end == br.FRESH


@pytest.mark.parametrize("slice_rows", [1_000_000, 40])
def test_slices_replay_like_one_sequence(spark, slice_rows):
    rng = random.Random(4)
    rows, at = [], {"hot": 0.0, "b": 0.0, "c": 0.0}
    for seq in range(500):
        name = "hot" if seq % 3 else rng.choice(["b", "c"])
        at[name] += rng.choice([1, 5, 30, 121, 301])
        rows.append((name, T0 + timedelta(seconds=at[name]), seq, rng.random() < 0.45))
    df = spark.createDataFrame(rows, "name string, ts timestamp, seq long, ok boolean")
    got = {(r.name, r.seq): (r.allowed, r.state_before, r.state_after, r.trip)
           for r in br.breaker_replay(df, slice_rows=slice_rows).collect()}
    want = {}
    for name in at:
        mine = sorted((r for r in rows if r[0] == name), key=lambda r: (r[1], r[2]))
        events = [(int((r[1] - T0).total_seconds() * SECOND), r[3]) for r in mine]
        for r, out in zip(mine, br.replay(events, br.FRESH, br.FEED_BREAKER)[0], strict=True):
            want[name, r[2]] = out
    assert got == want
    legal = {("closed", "closed"), ("closed", "open"), ("open", "open"), ("open", "half_open"), ("half_open", "half_open"),
             ("half_open", "open"), ("half_open", "closed")}
    assert {(b, a) for _, b, a, _ in got.values()} <= legal


def test_slices_replay_where_they_lie_and_take_null_names(spark):
    rng = random.Random(9)
    rows, at = [], 0.0
    for seq in range(400):
        at += rng.choice([1, 5, 30, 121, 301])
        rows.append((None if seq % 4 else "b", T0 + timedelta(seconds=at), seq, rng.random() < 0.4))
    df = spark.createDataFrame(rows, "name string, ts timestamp, seq long, ok boolean")
    replayed = br.breaker_replay(df, slice_rows=30)
    assert "Exchange" not in replayed._jdf.queryExecution().executedPlan().toString()
    got = {r.seq: (r.allowed, r.state_before, r.state_after, r.trip) for r in replayed.collect()}
    want = {}
    for name in (None, "b"):
        mine = [r for r in rows if r[0] == name]
        events = [(int((r[1] - T0).total_seconds() * SECOND), r[3]) for r in mine]
        want |= {r[2]: out for r, out in zip(mine, br.replay(events, br.FRESH, br.FEED_BREAKER)[0], strict=True)}
    assert got == want


def test_an_open_breaker_is_carried_over_many_slices(spark):
    # Rejected all along after three failures: no slice but the first may begin afresh.
    rows = [("a", T0 + timedelta(milliseconds=100 * i), i, i > 2) for i in range(600)]
    df = spark.createDataFrame(rows, "name string, ts timestamp, seq long, ok boolean")
    got = {r.seq: r.allowed for r in br.breaker_replay(df, slice_rows=25).collect()}
    assert got == {i: i <= 2 for i in range(600)}
