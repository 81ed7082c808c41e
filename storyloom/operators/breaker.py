"""Circuit-breaker replay over attempt logs.

The breaker is a small state machine per name. A name with very many attempts is cut into time
slices that replay in parallel, each where it lies. Only the first name of a slice can have begun
in an earlier one; its state there is carried from slice to slice. A slice is looked into again only
if it holds that name alone and the state it was assumed to start from turns out wrong, and only until
both states meet: breakers forget quickly (a success while closed clears them). The result equals one
sequential replay.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.operators.ordering import order_slices

CLOSED, HALF_OPEN, OPEN = "closed", "half_open", "open"

#: Attempts replayed by one task.
REPLAY_ROWS = 250_000
STATE_SCHEMA = "state string, failures int, successes int, last_failure long"
STATE_FIELDS = ["state", "failures", "successes", "last_failure"]
ENDS_SCHEMA = f"_slice int, first string, last string, alone boolean, {STATE_SCHEMA}"
REPLAY_SCHEMA = (
    "name string, ts timestamp, seq long, ok boolean, allowed boolean, "
    "state_before string, state_after string, trip boolean"
)


@dataclass(frozen=True)
class BreakerConfig:
    failure_threshold: int = 5
    success_threshold: int = 3
    timeout: timedelta = timedelta(minutes=2)
    reset_timeout: timedelta = timedelta(minutes=5)


# Fixed value: settings for feed fetching.
FEED_BREAKER = BreakerConfig(failure_threshold=3, success_threshold=2)
FRESH = (CLOSED, 0, 0, None)


def replay(events: Iterable[tuple[int, bool]], start: tuple, config: BreakerConfig) -> tuple[list[tuple], tuple]:
    """Replay (micros, ok) events in order. Returns (allowed, before, after, trip) rows and the end state."""
    wait = config.timeout // timedelta(microseconds=1)
    calm = config.reset_timeout // timedelta(microseconds=1)
    state, failures, successes, last = start
    rows = []
    for at, ok in events:
        before, trip = state, False
        if state == OPEN:
            if at - last <= wait:
                rows.append((False, before, state, False))
                continue
            state, successes = HALF_OPEN, 0
        elif state == CLOSED and last is not None and at - last > calm:
            failures = 0
        if not ok:
            last = at
            if state == CLOSED:
                failures += 1
                trip = failures >= config.failure_threshold
            else:
                trip = True
            if trip:
                state, failures, successes = OPEN, 0, 0
        elif state == HALF_OPEN:
            successes += 1
            if successes >= config.success_threshold:
                state, failures, successes = CLOSED, 0, 0
        else:
            failures = 0
        rows.append((True, before, state, trip))
    # Forget what cannot matter any more, so that equal futures have equal states.
    keeps_time = state == OPEN or (state == CLOSED and failures > 0)
    return rows, (state, failures, successes, last if keeps_time else None)


def _sorted_events(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[tuple[int, bool]]]:
    pdf = pdf.sort_values(["ts", "seq"])
    micros = pdf["ts"].astype("datetime64[us]").astype("int64")
    return pdf, list(zip(micros.tolist(), pdf["ok"].tolist(), strict=True))


def replay_frame(pdf: pd.DataFrame, start: tuple, config: BreakerConfig) -> tuple[pd.DataFrame, tuple]:
    pdf, events = _sorted_events(pdf)
    rows, end = replay(events, start, config)
    steps = pd.DataFrame(rows, columns=["allowed", "state_before", "state_after", "trip"], index=pdf.index)
    return pd.concat([pdf[["name", "ts", "seq", "ok"]], steps], axis=1), end


def breaker_replay(
    attempts: DataFrame, config: BreakerConfig = FEED_BREAKER, slice_rows: int = REPLAY_ROWS
) -> DataFrame:
    """``attempts``: name, ts, seq (breaks ties), ok. Adds what the breaker did with each attempt.

    ``ok`` of a rejected attempt is the logged outcome and has no effect.
    """
    events = attempts.select("name", "ts", F.col("seq").cast("long").alias("seq"), "ok")
    order = [F.col("ts").asc_nulls_last(), F.col("seq").asc_nulls_last()]
    sliced, slices = order_slices(events, ["name"], order, slice_rows, sort=True)
    if slices == 1:
        return sliced.groupBy("name").applyInPandas(lambda pdf: replay_frame(pdf, FRESH, config)[0], REPLAY_SCHEMA)
    starts = _settled_starts(sliced, config)  # a state a slice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            if state is None and batch.num_rows:
                name, state = batch.column("name")[0].as_py(), starts.get(batch.column("_slice")[0].as_py(), FRESH)
            steps: list[tuple] = []
            for own, events in _runs(batch):
                rows, state = replay(events, state if own == name else FRESH, config)
                name = own
                steps += rows
            kinds = {"allowed": pa.bool_(), "state_before": pa.string(), "state_after": pa.string(), "trip": pa.bool_()}
            columns = zip(*steps, strict=True) if steps else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("name", "ts", "seq", "ok")],
                    *[pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)],
                ],
                ["name", "ts", "seq", "ok", *kinds],
            )

    return sliced.mapInArrow(run, REPLAY_SCHEMA)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str | None, list[tuple[int, bool]]]]:
    """(name, (micros, ok) events) of each run of rows of one name. Times that are null come last, as in pandas."""
    codes = batch.column("name").dictionary_encode(null_encoding="encode")
    micros = batch.column("ts").cast(pa.int64()).fill_null(-(2**63)).to_pylist()
    events = list(zip(micros, batch.column("ok").to_pylist(), strict=True))
    at = [*np.flatnonzero(np.diff(codes.indices.to_numpy(), prepend=-1)).tolist(), len(events)]
    for lo, hi in zip(at, at[1:], strict=False):
        yield codes[lo].as_py(), events[lo:hi]


def _settled_starts(sliced: DataFrame, config: BreakerConfig) -> dict[int, tuple]:
    """The state in which the first name of each slice begins there. What reaches the driver is a row a slice."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, name, alone, state, at = None, None, True, None, None
        for batch in batches:
            for own, events in _runs(batch):
                if state is None:
                    first, state, at = own, FRESH, batch.column("_slice")[0].as_py()
                elif own != name:
                    alone, state = False, FRESH
                _, state = replay(events, state, config)
                name = own
        if state is not None:
            yield _end_row(at, first, name, alone, state)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, new, at, name = None, None, None, None
        for batch in batches:
            for own, events in _runs(batch):
                if at is None:
                    at, name = batch.column("_slice")[0].as_py(), own
                    old, new = todo[at]
                if old != new:  # from where they meet, all is as before
                    old, new = replay(events, old, config)[1], replay(events, new, config)[1]
        if old != new:
            yield _end_row(at, name, name, True, new)

    slices = {r["_slice"]: r for r in sliced.mapInArrow(ends, ENDS_SCHEMA).collect()}
    assumed = dict.fromkeys(slices, FRESH)
    end = {s: tuple(r[f] for f in STATE_FIELDS) for s, r in slices.items()}
    while True:
        starts, before = {}, None
        for s in sorted(slices):
            carried = before is not None and slices[before]["last"] == slices[s]["first"]
            starts[s], before = end[before] if carried else FRESH, s
        # Where another name follows, the end does not depend on the start.
        todo = {s: (assumed[s], starts[s]) for s in slices if slices[s]["alone"] and starts[s] != assumed[s]}
        if not todo:
            return starts
        found = sliced.filter(F.col("_slice").isin(list(todo))).mapInArrow(again, ENDS_SCHEMA).collect()
        end |= {r["_slice"]: tuple(r[f] for f in STATE_FIELDS) for r in found}
        assumed |= {s: new for s, (_, new) in todo.items()}


def _end_row(at: int, first: str | None, last: str | None, alone: bool, state: tuple) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.int64())
    row = (at, first, last, alone, *state)
    return pa.RecordBatch.from_arrays(
        [pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["_slice", "first", "last", "alone", *STATE_FIELDS]
    )


def breaker_states(replayed: DataFrame) -> DataFrame:
    """Current state per breaker, one row per possible state with 1 for the current one."""
    last = replayed.groupBy("name").agg(F.max_by("state_after", F.struct("ts", "seq")).alias("current"))
    each = F.explode(F.array(F.lit(CLOSED), F.lit(HALF_OPEN), F.lit(OPEN)))
    return last.select("name", "current", each.alias("state")).select(
        "name", "state", (F.col("current") == F.col("state")).cast("double").alias("value")
    )
