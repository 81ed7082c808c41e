"""Packing documents into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import in_batches, parallelism, texts, written
from storyloom.llm.tokens import encoder

#: Pieces that are packed together. Shards are drawn at random, so all have the same mix of lengths.
SHARD_PIECES = 4096
ISLANDS, EPOCHS, POPULATION = 2, 2, 4
#: Packings that an island holds where those it begins with take more bins than the tokens need.
GROWN = 12
#: An island ends when it has as few bins as the tokens need, or after this many generations in a row without progress.
STALE = 40
#: Bins at least this full are handed on whole.
WELL_FILLED = 0.995

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n tokens: the first may be shorter, the others are full."""
    if n <= capacity:
        return [n]
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """``PIECE`` rows of (doc_id, text): ids by the tokenizer, then ``end_id``, cut if longer than ``capacity``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held = encoder(tokenizer_path, np.uint32)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple[int | None, int, int, int, int]] = []
            found = held.encode([t or "" for t in batch.column("text").to_pylist()])
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                whole = memoryview(ids + end)
                at = 0
                for piece, n in enumerate(cut_lengths(len(whole) // 4, capacity)):
                    rows.append((doc_id, piece, at, n, zlib.crc32(whole[4 * at : 4 * (at + n)])))
                    at += n
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return in_batches(docs.select("doc_id", "text"), work, PIECE)


# --- one shard ----------------------------------------------------------------------------------


def _pack(items: Iterable[int], lengths: list[int], capacity: int, kept: list[list[int]]) -> list[list[int]]:
    """``kept`` bins plus each of ``items`` in the fullest bin that still takes it, else in a new one."""
    bins = [list(b) for b in kept]
    room = ((capacity - sum(lengths[i] for i in b), at) for at, b in enumerate(bins))
    free = sorted(r for r in room if r[0])
    for item in items:
        n = lengths[item]
        at = bisect_left(free, (n, -1))
        if at < len(free):
            r, i = free.pop(at)
            bins[i].append(item)
        else:
            r, i = capacity, len(bins)
            bins.append([item])
        if r > n:
            insort(free, (r - n, i))
    return bins


def _fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; then fuller ones, as squares, so that what room is left lies together."""
    return -len(bins), sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def _cross(one: list[list[int]], other: list[list[int]], lengths: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """``one`` with some of the well-filled bins of ``other`` put in whole.

    Its bins that share a document with them go; their other documents, and those of some of its emptiest
    bins, are displaced and find their places by best fit, the longest first.
    """
    filled = [b for b in other if sum(lengths[i] for i in b) >= WELL_FILLED * capacity]
    chosen = [b for b in filled if rng.random() < 0.5]
    injected = {i for b in chosen for i in b}
    stay, displaced = [], []
    for b in one:
        if injected.isdisjoint(b):
            stay.append(b)
        else:
            displaced.extend(i for i in b if i not in injected)
    stay.sort(key=lambda b: sum(lengths[i] for i in b))
    for b in stay[: max(2, len(stay) // 50)]:
        displaced.extend(b)
    stay = stay[max(2, len(stay) // 50) :]
    displaced.sort(key=lambda i: -lengths[i])
    return _pack(displaced, lengths, capacity, [*chosen, *stay])


def evolve(lengths: list[int], capacity: int, elites: list[list[int]], seed: int) -> list[int]:
    """The bin of each item once evolution comes to rest on one island that starts with ``elites`` from others."""
    rng = np.random.default_rng(seed)
    base = np.array(lengths, float)
    population: list[tuple[tuple[int, float], list[list[int]]]] = []
    least, size = -(-sum(lengths) // capacity), POPULATION

    def admit(bins: list[list[int]]) -> None:
        population.append((_fitness(bins, lengths, capacity), bins))
        population.sort(key=lambda p: p[0], reverse=True)
        del population[size:]

    for elite in elites:
        held: dict[int, list[int]] = {}
        for item, b in enumerate(elite):
            held.setdefault(b, []).append(item)
        admit(list(held.values()))
    for size in (POPULATION, GROWN):
        # No packing takes fewer bins than the tokens need: with one that takes no more, nothing is left to evolve.
        while len(population) < size and not (population and -population[0][0][0] <= least):
            noise = rng.uniform(0.9, 1.1, len(base)) if population else 1.0
            order = np.argsort(-base * noise, kind="stable").tolist()
            admit(_pack(order, lengths, capacity, []))
    stale = 0
    while -population[0][0][0] > least and stale < STALE:
        best = population[0][0]
        a, b = rng.choice(len(population), 2, replace=False)
        admit(_cross(population[a][1], population[b][1], lengths, capacity, rng))
        stale = 0 if population[0][0] > best else stale + 1
    out = [0] * len(lengths)
    for number, bin_items in enumerate(population[0][1]):
        for item in bin_items:
            out[item] = number
    return out


# --- jobs ---------------------------------------------------------------------------------------


def _islands(rows: DataFrame, capacity: int, seed: int) -> DataFrame:
    """One epoch: (shard, island, packing) from (shard, island, lengths, elites)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = [
                evolve(r["lengths"], capacity, r["elites"] or [], hash((seed, r["shard"], r["island"])) & 0x7FFFFFFF)
                for r in rows
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("island"), pa.array(found, pa.list_(pa.int32()))],
                ["shard", "island", "packing"],
            )

    dealt = rows.repartition(parallelism(rows.sparkSession), "shard", "island")
    return in_batches(dealt, work, "shard long, island int, packing array<int>")


def pack(pieces: DataFrame, capacity: int, seed: int = 7) -> DataFrame:
    """``PIECE`` rows plus sequence_id and offset. ``pieces`` must be a stored table.

    Pieces are dealt at random to shards of about ``SHARD_PIECES``. Each shard is packed on several islands,
    each with a population of its own; between epochs the best packing of an island migrates to the next.
    A task holds one shard's lengths. The shard's best packing over all islands is what counts; a shard
    wastes at most what one bin takes more than the whole corpus packed at once.
    """
    spark = pieces.sparkSession
    n = pieces.count()
    shards = max(1, -(-n // SHARD_PIECES))
    item = F.struct("length", "row", "doc_id", "piece", "start", "ids_crc32")
    dealt = (
        pieces.withColumn("row", F.monotonically_increasing_id())
        .withColumn("shard", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(shards)))
        .groupBy("shard")
        .agg(F.sort_array(F.collect_list(item), asc=False).alias("items"))  # bounded by the dealing
    )
    dealt = written(dealt, "packing-shards")
    # Full pieces are sequences already. They come first in the order, so the others are a tail.
    below = F.filter("items", lambda x: x["length"] < capacity)
    shapes = dealt.select("shard", F.transform(below, lambda x: x["length"].cast("int")).alias("lengths"))
    islands = shapes.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    elites = None
    for epoch in range(EPOCHS):
        if elites is None:
            start = islands.withColumn("elites", F.lit(None).cast("array<array<int>>"))
        else:
            # Each island keeps its own best and gets that of the one before it.
            own = elites.select("shard", "island", F.col("packing").alias("own"))
            moved = elites.select(
                "shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("packing").alias("moved")
            )
            start = (
                islands.join(own, ["shard", "island"])
                .join(moved, ["shard", "island"])
                .select("shard", "island", "lengths", F.array("own", "moved").alias("elites"))
            )
        elites = written(_islands(start, capacity, seed + epoch), "packing-elites")
    best = elites.groupBy("shard").agg(F.min(F.struct(F.array_max("packing").alias("bins"), "island", "packing")).alias("best"))
    chosen = dealt.join(best, "shard").select("shard", "items", F.col("best.packing").alias("packing"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                items = batch.column("items")[i].values
                sizes = items.field("length").to_numpy()
                ids = np.arange(len(sizes))  # numbers of full pieces: their places
                packing = np.array(batch.column("packing")[i].values.to_numpy(), np.int64)
                bins = np.concatenate([ids[: len(sizes) - len(packing)] + (1 << 24), packing])
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(sizes[order])
                first = np.searchsorted(bins[order], bins[order])
                offsets = np.empty(len(sizes), np.int64)
                offsets[order] = ends - sizes[order] - (ends - sizes[order])[first]
                sequence = (np.int64(batch.column("shard")[i].as_py()) << 32) + bins
                names = ("doc_id", "piece", "start", "length", "ids_crc32")
                yield pa.RecordBatch.from_arrays(
                    [*[items.field(c) for c in names], pa.array(sequence), pa.array(offsets)],
                    [*names, "sequence_id", "offset"],
                )

    spread = chosen.repartition(parallelism(spark), "shard")
    return in_batches(spread, place, f"{PIECE}, sequence_id long, offset long")


def packed_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 0,
    text_col: str = "text",
    id_col: str = "doc_id",
    seed: int = 7,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of ``docs``.

    Nulls: a null text is an empty one, one piece of the end id; a null id stays null. Repeated rows are
    packed as often as they occur. Texts of more than ``capacity`` tokens are cut, all others stay whole.
    An empty table gives no rows; other columns are not read. Which sequence a piece comes to depends on
    the order of the stored rows and on ``seed``.
    """
    pieces = written(tokenized(texts(docs, id_col, text_col), tokenizer_path, end_id, capacity), "pieces")
    return pack(pieces, capacity, seed)
