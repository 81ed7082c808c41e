"""First-fit decreasing with a tournament tree of bin capacities, in random groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import in_batches, texts, written
from storyloom.llm.tokens import encoder

#: Tails of documents that are packed together. A group holds at most some 8 MB of ids.
GROUP_TAILS = 4096

TAIL = "doc_id long, start long, length long, ids binary, doc_tokens long, draw long"
PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_TYPES = {"long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    arrays = [pa.array(c, _TYPES[kind]) for c, (_, kind) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


class Bins:
    """Open bins under a tournament tree: each inner node holds the larger room of its two children.

    The first bin with enough room is found from the root down, to the left where that side's winner
    suffices, in as many steps as the tree is deep. A new bin is the first leaf that is still untouched.
    """

    def __init__(self, capacity: int, most: int) -> None:
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, n: int) -> int:
        """The first bin that takes ``n`` tokens, which it then holds."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < n:
                at += 1
        found = at - self.leaves
        room[at] -= n
        while at > 1:
            at //= 2
            left, right = room[2 * at], room[2 * at + 1]
            larger = left if left > right else right
            if room[at] == larger:
                break
            room[at] = larger
        return found


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each of ``lengths``, the longest placed first, equal ones in the order given."""
    bins, out = Bins(capacity, len(lengths)), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        out[i] = bins.place(lengths[i])
    return out


def plan(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, first token, tokens) that need no padding, with few cuts.

    Bins are filled by ``first_fit_decreasing``. Its emptiest bins are taken apart again: their items are cut
    to fill the gaps of the fuller ones, which no item fits whole. What is left, fewer tokens than
    ``capacity``, makes sequences whose lengths are powers of two. So all others hold ``capacity`` tokens.
    """
    held: dict[int, list[int]] = {}
    for item, b in enumerate(first_fit_decreasing(lengths, capacity)):
        held.setdefault(b, []).append(item)
    bins = sorted(held.values(), key=lambda items: -sum(lengths[i] for i in items))
    fill = [sum(lengths[i] for i in items) for items in bins]
    # The fullest bins stay while the tokens of the others fill all their gaps.
    stay, gaps, tokens = 0, 0, sum(fill)
    while stay < len(bins) and gaps + capacity - fill[stay] <= tokens - fill[stay]:
        tokens -= fill[stay]
        gaps += capacity - fill[stay]
        stay += 1
    sequences = [[(i, 0, lengths[i]) for i in items] for items in bins[:stay]]
    loose = [i for items in bins[stay:] for i in items]
    wanted = [(k, capacity - fill[k]) for k in range(stay) if fill[k] < capacity]
    left = tokens - gaps
    # Longest first; equal to ``left`` in sum.
    for bit in reversed(range(left.bit_length())):
        if left >> bit & 1:
            wanted.append((len(sequences), 1 << bit))
            sequences.append([])
    at = used = 0
    for sequence, missing in wanted:
        while missing:
            item = loose[at]
            n = min(missing, lengths[item] - used)
            sequences[sequence].append((item, used, n))
            missing -= n
            used += n
            if used == lengths[item]:
                at, used = at + 1, 0
    return sequences


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, vocabulary: int) -> DataFrame:
    """``TAIL`` rows of (doc_id, text): pieces of ``capacity`` tokens, then the shorter rest of each document.

    ``ids`` are little-endian integers of the smallest type that holds the vocabulary; ``draw`` is a random
    number from the row's place, the same in every attempt of a task.
    """
    dtype = np.min_scalar_type(vocabulary - 1).newbyteorder("<")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held = encoder(tokenizer_path, dtype.type)
        end, width = np.array([end_id], dtype).tobytes(), dtype.itemsize
        rng = np.random.default_rng([TaskContext.get().partitionId(), 13])
        for batch in batches:
            rows: list[tuple] = []
            found = held.encode([t or "" for t in batch.column("text").to_pylist()])
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                whole = ids + end
                n = len(whole) // width
                for at in range(0, n, capacity):
                    piece = whole[at * width : (at + capacity) * width]
                    rows.append((doc_id, at, len(piece) // width, piece, n))
            draws = rng.integers(0, 1 << 62, len(rows)).tolist()
            yield _batch([(*row, draw) for row, draw in zip(rows, draws, strict=True)], TAIL)

    return in_batches(docs.select("doc_id", "text"), work, TAIL)


def pack(tails: DataFrame, capacity: int) -> DataFrame:
    """``PIECE`` rows of ``TAIL`` rows, which must be a stored table.

    Pieces of ``capacity`` tokens are sequences of their own and go nowhere. The others are dealt by ``draw``
    to groups of about ``GROUP_TAILS``, whatever their documents are, and each group is packed by ``plan``.
    """
    full = tails.filter(F.col("length") == capacity)
    rest = tails.filter(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // GROUP_TAILS))
    # Numbers of groups take the upper half, so they cannot meet those of full pieces, which are negative.
    alone = full.select(
        *[c.split()[0] for c in TAIL.split(", ")[:-1]],
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )

    def work(group: pa.Table) -> pa.Table:
        number = group.column("group")[0].as_py()
        # Rows come in any order; equal ones are alike in all that counts.
        columns = {c: group.column(c).to_pylist() for c in ("draw", "doc_id", "start", "length", "ids", "doc_tokens")}
        order = sorted(range(group.num_rows), key=columns["draw"].__getitem__)
        doc_ids, starts, lengths, ids, totals = (
            [columns[c][i] for i in order] for c in ("doc_id", "start", "length", "ids", "doc_tokens")
        )
        rows = []
        for k, sequence in enumerate(plan(lengths, capacity)):
            offset = 0
            for item, first, n in sequence:
                width = len(ids[item]) // lengths[item]
                part = ids[item][first * width : (first + n) * width]
                rows.append((doc_ids[item], starts[item] + first, n, part, totals[item], (number << 32) + k, offset))
                offset += n
        return pa.Table.from_batches([_batch(rows, PIECE)])

    grouped = rest.withColumn("group", F.pmod("draw", F.lit(groups)))
    return alone.unionByName(grouped.groupBy("group").applyInArrow(work, PIECE))


def packed_documents(
    docs: DataFrame,
    tokenizer_path: str,
    vocabulary: int,
    capacity: int = 1024,
    end_id: int = 0,
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """``PIECE`` rows of ``docs``: where each piece lies, and its token ids.

    A sequence holds ``capacity`` tokens or a power of two, so none needs padding. Documents are cut into
    pieces of ``capacity`` tokens and a rest; rests stay whole but for the few that fill gaps.

    Nulls: a null text is an empty one, one piece of the end id; a null id stays null. Repeated rows are
    packed as often as they occur, and dealt to groups like any others. Very long texts are cut into rows of
    ``capacity`` tokens first. An empty table gives no rows; other columns are not read. Equal lengths are
    placed in random order.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    return pack(written(tokenized(texts(docs, id_col, text_col), tokenizer_path, end_id, capacity, vocabulary), "tails"), capacity)


def ids_crc32(pieces: DataFrame, width: int) -> DataFrame:
    """``pieces`` with ids_crc32 in place of ids: of the ids as unsigned 32-bit integers, ``width`` bytes each before."""
    kept = [c for c in pieces.columns if c != "ids"]
    kinds = {f.name: f.dataType.simpleString().replace("bigint", "long") for f in pieces.schema.fields}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            crc = [zlib.crc32(np.frombuffer(x, f"<u{width}").astype("<u4")) for x in ids]
            arrays = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(crc, pa.int64())], [*kept, "ids_crc32"])

    return in_batches(pieces, work, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", ids_crc32 long")
