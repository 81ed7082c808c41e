"""Folding the rows of a key in the order of their times, however they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: (key, rows in order, state or None) to (output rows, state).
Fold = Callable[[tuple, list[tuple], tuple | None], tuple[list[tuple], tuple]]


class InOrder(StatefulProcessor):
    """Rows wait until the watermark has passed them; then they are folded, sorted by their first two fields.

    A timer at the earliest waiting row wakes the key, so keys without due rows are not touched. What waits for a
    key is what came within the delay of the watermark.
    """

    def __init__(self, columns: Sequence[str], buffer: str, state: str, output: Sequence[str], fold: Fold) -> None:
        self.columns, self.buffer, self.state_schema, self.output, self.fold = columns, buffer, state, output, fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.buffer)
        self.folded = handle.getValueState("folded", self.state_schema)
        self.wake = handle.getValueState("wake", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        got = [tuple(r[c] for c in self.columns) for r in rows]
        self.waiting.appendList(got)
        self._wake_after(min(g[0] for g in got))
        return iter([])

    def _wake_after(self, us: int) -> None:
        """One timer a key, just behind the earliest row that waits. Timers fire when the watermark has reached them."""
        at = us // 1000 + 1
        if self.wake.exists():
            (before,) = self.wake.get()
            if before <= at:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.wake.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due, rest = [], []
        for row in self.waiting.get():
            (due if row[0] < passed else rest).append(tuple(row))
        self.wake.clear()
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
            self._wake_after(min(r[0] for r in rest))
        if not due:
            return iter([])
        start = tuple(self.folded.get()) if self.folded.exists() else None
        found, end = self.fold(tuple(key), sorted(due, key=lambda r: r[:2]), start)
        self.folded.update(end)
        return iter([Row(**dict(zip(self.output, r, strict=True))) for r in found])

    def close(self) -> None:
        pass


def fold_in_order(
    rows: DataFrame,
    keys: Sequence[str],
    time: str,
    delay: str,
    buffer: str,
    state: str,
    output: str,
    fold: Fold,
) -> DataFrame:
    """``fold`` over the stream ``rows`` per ``keys``, for rows before the watermark, which is ``delay`` behind ``time``.

    ``buffer`` is the schema of what a row's fold needs: first ``_us`` (its time in microseconds, added here), then
    what breaks ties, then other columns. Rows that come later than ``delay`` are dropped. Schemas are plain
    "name type, ..." lists.
    """
    columns = [c.split()[0] for c in buffer.split(", ")]
    names = [c.split()[0] for c in output.split(", ")]
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)  # lists and timers need it
    timed = rows.withWatermark(time, delay).withColumn("_us", F.unix_micros(time))
    return timed.groupBy(*keys).transformWithState(
        InOrder(columns, buffer, state, names, fold), output, "append", "eventTime"
    )
