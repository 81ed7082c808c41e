"""Alert edges and breaker replay with state kept per key across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from storyloom.operators.alerts import FIRING, RESOLVED, Rule, evaluate
from storyloom.operators.breaker import (
    FEED_BREAKER,
    FRESH,
    REPLAY_SCHEMA,
    STATE_SCHEMA,
    BreakerConfig,
    replay,
    replay_frame,
)
from storyloom.streaming.ordered import Fold, fold_in_order

EDGE_SCHEMA = "rule string, series string, status string, tick timestamp, value double"


def _edges_in_order(key: tuple, rows: list[tuple], state: tuple | None) -> tuple[list[tuple], tuple]:
    active, out = bool(state and state[0]), []
    for at, _, value, firing in rows:
        if firing != active:
            active = firing
            out.append((*key, FIRING if firing else RESOLVED, at, value))
    return out, (active,)


def alert_stream(samples: DataFrame, rules: Sequence[Rule], delay: str | None = None) -> DataFrame:
    """Firing and resolved edges per (rule, series).

    With ``delay``, samples may arrive in any order up to that much late: each is taken in the order of ticks once
    the watermark has passed it. Without, samples of a key must arrive in tick order, and are taken at once.
    """
    if delay is not None:
        evaluated = evaluate(samples, rules).select("rule", "series", "tick", "value", "firing")
        edges = fold_in_order(
            evaluated, ["rule", "series"], "tick", delay, "_us long, rule string, value double, firing boolean",
            "active boolean", "rule string, series string, status string, at long, value double", _edges_in_order,
        )
        return edges.select("rule", "series", "status", F.timestamp_micros("at").alias("tick"), "value")

    def edges(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active = state.get[0] if state.exists else False
        pdf = pd.concat(list(batches)).sort_values("tick")
        before = pdf["firing"].shift(fill_value=active).astype(bool)
        out = pdf[pdf["firing"] != before]
        state.update((bool(pdf["firing"].iloc[-1]),))
        status = out["firing"].map({True: FIRING, False: RESOLVED})
        yield pd.DataFrame(
            {"rule": key[0], "series": key[1], "status": status, "tick": out["tick"], "value": out["value"]}
        )

    evaluated = evaluate(samples, rules).select("rule", "series", "tick", "value", "firing")
    return evaluated.groupBy("rule", "series").applyInPandasWithState(
        edges, EDGE_SCHEMA, "active boolean", "append", GroupStateTimeout.NoTimeout
    )


def _replay_in_order(config: BreakerConfig) -> Fold:
    def fold(key: tuple, rows: list[tuple], state: tuple | None) -> tuple[list[tuple], tuple]:
        steps, end = replay([(at, ok) for at, _, ok in rows], state or FRESH, config)
        return [(*key, at, seq, ok, *step) for (at, seq, ok), step in zip(rows, steps, strict=True)], end

    return fold


def breaker_stream(
    attempts: DataFrame, config: BreakerConfig = FEED_BREAKER, delay: str | None = None
) -> DataFrame:
    """Breaker replay of a stream of attempts (name, ts, seq, ok), state carried per name.

    With ``delay``, attempts may arrive in any order up to that much late: each is replayed in the order of (ts, seq)
    once the watermark has passed it. Without, attempts of a name must arrive in order, and are replayed at once.
    """
    if delay is not None:
        steps = fold_in_order(
            attempts.withColumn("seq", F.col("seq").cast("long")), ["name"], "ts", delay,
            "_us long, seq long, ok boolean", STATE_SCHEMA,
            "name string, at long, seq long, ok boolean, allowed boolean, state_before string, state_after string, trip boolean",
            _replay_in_order(config),
        )
        columns = [c.split()[0] for c in REPLAY_SCHEMA.split(", ")]
        return steps.withColumn("ts", F.timestamp_micros("at")).select(*columns)

    def step(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches))
        out, end = replay_frame(pdf, state.get if state.exists else FRESH, config)
        state.update(end)
        yield out

    events = attempts.select("name", "ts", F.col("seq").cast("long").alias("seq"), "ok")
    return events.groupBy("name").applyInPandasWithState(
        step, REPLAY_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )
