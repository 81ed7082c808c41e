"""Calls to the outside that are made once, however often a task or a query is run.

A ledger is a folder with a log per slot of keys. Before calls are made, the log says so; their outcomes are logged
behind them. A task that is run again, and a query that is evaluated again, reads the log of its slots first: calls
with a logged outcome are not made again. A call that was begun and has no outcome is in doubt, since its task went
down during it: it is not made again either, unless the caller asks for that.

Logs are small files that are only ever added. On a mounted folder a second task of the same slot fails at the first
file that exists already (speculative execution, tasks given up as lost but alive). Stores without such exclusive
files need speculation off.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import groupby, islice

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.session import bound_batches

#: Slots of a new ledger, and calls that are logged together.
SLOTS, TOGETHER = 256, 20
SKIP, AGAIN = "skip", "again"

#: (key, attempt) of a call.
Call = tuple[str, int]


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder
    return pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


class SlotLog:
    """The log of one slot, as a task sees it."""

    def __init__(self, folder: str, slot: int) -> None:
        self.store, path = _open(folder)
        self.path = f"{path}/slot={slot:06d}"
        self.store.create_dir(self.path)
        self.begun: set[Call] = set()
        self.outcomes: dict[Call, dict] = {}
        found = self.store.get_file_info(pafs.FileSelector(self.path))
        names = sorted(f.path for f in found if f.base_name.endswith(".json"))
        self.next = 0
        for name in names:
            self.next = max(self.next, int(os.path.basename(name).split("-")[0]) + 1)
            with self.store.open_input_stream(name) as f:
                entry = json.loads(f.read())
            self.begun.update((k, n) for k, n in entry.get("begun", []))
            self.outcomes.update({(k, n): outcome for k, n, outcome in entry.get("outcomes", [])})

    def _add(self, entry: Mapping) -> None:
        data = json.dumps(entry).encode()
        if isinstance(self.store, pafs.LocalFileSystem):
            # Written whole under another name first: a file that is there is complete. Linking fails if it exists.
            name, part = f"{self.path}/{self.next:08d}-.json", f"{self.path}/{uuid.uuid4().hex}.part"
            with open(part, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(part, name)
            finally:
                os.unlink(part)
        else:
            with self.store.open_output_stream(f"{self.path}/{self.next:08d}-{uuid.uuid4().hex}.json") as f:
                f.write(data)
        self.next += 1

    def begin(self, calls: Sequence[Call]) -> None:
        self._add({"begun": calls})
        self.begun.update(calls)

    def end(self, outcomes: Mapping[Call, dict]) -> None:
        self._add({"outcomes": [(k, n, outcome) for (k, n), outcome in outcomes.items()]})
        self.outcomes.update(outcomes)


@dataclass(frozen=True)
class Outcome:
    """What an attempt came to. ``fields`` is None for one that is in doubt."""

    attempt: int
    fields: dict | None


def attempts_once(
    log: SlotLog,
    rows: Sequence[tuple[str, Row]],
    call: Callable[[Row, int], dict],
    done: Callable[[dict], bool],
    attempts: int,
    in_doubt: str,
) -> list[list[Outcome]]:
    """The attempts of each of ``rows`` (key, row), those made now and those of the log.

    Attempts go on until one is ``done`` or in doubt. A round of attempts is logged before its first call.
    """
    found: list[list[Outcome]] = [[] for _ in rows]
    open_ = list(range(len(rows)))
    for attempt in range(1, attempts + 1):
        calls = {i: (rows[i][0], attempt) for i in open_}
        fresh = [i for i in open_ if calls[i] not in log.outcomes and (calls[i] not in log.begun or in_doubt == AGAIN)]
        if fresh:
            log.begin([calls[i] for i in fresh])
            log.end({calls[i]: call(rows[i][1], attempt) for i in fresh})
        for i in open_:
            found[i].append(Outcome(attempt, log.outcomes.get(calls[i])))
        open_ = [i for i in open_ if found[i][-1].fields is not None and not done(found[i][-1].fields)]
    return found


def call_once(
    requests: DataFrame,
    ledger: str,
    keys: Sequence[str],
    call: Callable[[Row, int], dict],
    done: Callable[[dict], bool],
    outcome: str,
    attempts: int = 3,
    slots: int = SLOTS,
    together: int = TOGETHER,
    in_doubt: str = SKIP,
) -> DataFrame:
    """``requests`` times the attempts made for each: with attempt, in_doubt and the fields of ``outcome``.

    ``keys`` tell requests apart; equal ones are one request. ``call`` makes one attempt and returns its fields (a
    dictionary that JSON can hold), or raises to take the task down. ``slots`` must be the same for all uses of a
    ledger. Fields of attempts in doubt are null.
    """
    if in_doubt not in (SKIP, AGAIN):
        raise ValueError(f"in_doubt is {SKIP!r} or {AGAIN!r}")
    kept = requests.columns
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    single = requests.dropDuplicates(list(keys)).withColumn("_key", key)
    slotted = single.withColumn("_slot", F.pmod(F.xxhash64("_key"), F.lit(slots)).cast("int"))
    dealt = slotted.repartition(slots, "_slot").sortWithinPartitions("_slot", "_key")
    fields = T.StructType.fromDDL(outcome)
    schema = T.StructType(
        [*requests.schema.fields, T.StructField("attempt", T.IntegerType()), T.StructField("in_doubt", T.BooleanType()), *fields.fields]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for slot, held in groupby(rows(batches), key=lambda r: r["_slot"]):
            log = SlotLog(ledger, slot)
            while part := list(islice(held, together)):
                named = [(r["_key"], Row(**{c: r[c] for c in kept})) for r in part]
                found = attempts_once(log, named, call, done, attempts, in_doubt)
                out = [
                    {**{c: r[c] for c in kept}, "attempt": o.attempt, "in_doubt": o.fields is None, **(o.fields or {})}
                    for r, outcomes in zip(part, found, strict=True)
                    for o in outcomes
                ]
                yield pa.RecordBatch.from_pylist(out, arrow)

    bound_batches(dealt.sparkSession)
    return dealt.mapInArrow(work, schema)
