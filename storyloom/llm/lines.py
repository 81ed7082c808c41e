"""Dropping lines that many documents share, through a sharded minimal perfect hash."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import in_batches, parallelism, pick, row_key, written

SHARD_KEYS = 1 << 16
#: Bits a key on each level, and levels; what is left after the last level is kept as a sorted list.
GAMMA, LEVELS = 2, 24
#: A shard that draws more than this share of all probes is copied, so there are at most as many of those.
HOT_SHARE = 1 / 1024


def line_key(line: bytes) -> bytes:
    """Stripped of ASCII white space at both ends, A-Z in lower case."""
    return line.strip().lower()


def _hash(key: bytes) -> tuple[int, int]:
    whole = xxhash.xxh3_128_intdigest(key)
    return whole >> 64, whole & 0xFFFFFFFFFFFFFFFF


def _signed(values: Iterable[int]) -> pa.Array:
    return pa.array(np.fromiter(values, np.uint64).view(np.int64))


# --- the index of a shard -----------------------------------------------------------------------


def _spot(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where a 128-bit line hash falls on a level of ``size`` bits."""
    z = h1 ^ (h2 * np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) % 2**64))
    z = (z ^ (z >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (z ^ (z >> np.uint64(29))) % np.uint64(size)


@dataclass
class Shard:
    """A minimal perfect hash over distinct 128-bit hashes, and what it indexes.

    Level by level a key takes the bit it hashes to if no other key left wants it. A key's number is the
    count of bits before its own, over all levels; fingerprints (32 bits) and counts are flat arrays by
    that number. About 3 bits a key for the hash, 8 bytes for the arrays.
    """

    levels: list[np.ndarray]
    rest: np.ndarray
    fingerprints: np.ndarray
    counts: np.ndarray

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray) -> Shard:
        levels: list[np.ndarray] = []
        left = np.arange(len(h1))
        while len(left) and len(levels) < LEVELS:
            size = max(64, -(-GAMMA * len(left) // 64) * 64)
            spot = _spot(h1[left], h2[left], len(levels), size)
            wanted = np.bincount(spot.astype(np.int64), minlength=size)
            levels.append(wanted == 1)
            left = left[wanted[spot.astype(np.int64)] != 1]
        rest = np.sort(np.stack([h1[left], h2[left]], axis=1).view("u8,u8").ravel())
        out = cls(levels, rest, np.zeros(len(h1), np.uint32), np.zeros(len(h1), np.int64))
        number = out.numbers(h1, h2)
        out.fingerprints[number] = (h2 >> np.uint64(32)).astype(np.uint32)
        out.counts[number] = counts
        return out

    def numbers(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The number of each key; some number or -1 for a key that was not indexed."""
        out = np.full(len(h1), -1, np.int64)
        left = np.arange(len(h1))
        before = 0
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            spot = _spot(h1[left], h2[left], level, len(bits)).astype(np.int64)
            rank = np.cumsum(bits)
            hit = bits[spot]
            out[left[hit]] = before + rank[spot[hit]] - 1
            left = left[~hit]
            before += int(rank[-1])
        if len(left) and len(self.rest):
            asked = np.stack([h1[left], h2[left]], axis=1).view("u8,u8").ravel()
            at = np.minimum(np.searchsorted(self.rest, asked), len(self.rest) - 1)
            hit = self.rest[at] == asked
            out[left[hit]] = before + at[hit]
        return out

    def lookup(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The count of each key, 0 if its fingerprint is not the one stored."""
        number = self.numbers(h1, h2)
        known = number >= 0
        if not len(self.counts):
            return np.zeros(len(h1), np.int64)
        same = self.fingerprints[number] == (h2 >> np.uint64(32)).astype(np.uint32)
        return np.where(known & same, self.counts[number], 0)

    def pack(self) -> dict[str, bytes]:
        return {
            "sizes": np.array([len(b) for b in self.levels], np.int64).tobytes(),
            "bits": b"".join(np.packbits(b).tobytes() for b in self.levels),
            "rest": self.rest.tobytes(),
            "fingerprints": self.fingerprints.tobytes(),
            "counts": self.counts.tobytes(),
        }

    @classmethod
    def unpack(cls, sizes: bytes, bits: bytes, rest: bytes, fingerprints: bytes, counts: bytes) -> Shard:
        levels, at = [], 0
        for size in np.frombuffer(sizes, np.int64):
            levels.append(np.unpackbits(np.frombuffer(bits, np.uint8, size // 8, at)).astype(bool))
            at += size // 8
        return cls(
            levels,
            np.frombuffer(rest, "u8,u8"),
            np.frombuffer(fingerprints, np.uint32),
            np.frombuffer(counts, np.int64),
        )


PACKED = ("sizes", "bits", "rest", "fingerprints", "counts")


def _u64(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def shard_of(shards: int) -> Column:
    return F.pmod(F.col("h1"), F.lit(shards)).cast("int")


# --- jobs ---------------------------------------------------------------------------------------


def line_hashes(docs: DataFrame, key: Column, min_chars: int) -> DataFrame:
    """(key, h1, h2): the distinct line keys of each row of ``docs`` (text) that can be dropped."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            keys: list[int] = []
            first: list[int] = []
            second: list[int] = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                distinct = {line_key(line) for line in (text or b"").split(b"\n")}
                found = [_hash(k) for k in distinct if _long_enough(k, min_chars)]
                keys.extend([key] * len(found))
                first.extend(h[0] for h in found)
                second.extend(h[1] for h in found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), _signed(first), _signed(second)], ["key", "h1", "h2"]
            )

    source = docs.select(key.alias("key"), F.col("text").cast("binary").alias("text"))
    return in_batches(source, work, "key long, h1 long, h2 long")


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)


def build_index(counts: DataFrame, shards: int) -> DataFrame:
    """One packed ``Shard`` a row for ``counts`` (h1, h2, n), with distinct (h1, h2)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for shard, group in _runs(batches):
            made = Shard.build(*(np.concatenate([_u64(b.column(c)) for b in group]) for c in ("h1", "h2", "n")))
            packed = made.pack()
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), *[pa.array([packed[c]], pa.binary()) for c in PACKED]],
                ["shard", *PACKED],
            )

    dealt = counts.withColumn("shard", shard_of(shards)).repartition(parallelism(counts.sparkSession), "shard")
    schema = "shard int, " + ", ".join(f"{c} binary" for c in PACKED)
    return in_batches(dealt.sortWithinPartitions("shard"), build, schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Consecutive rows of one shard, from batches sorted by shard. A shard's keys are bounded."""
    held: list[pa.RecordBatch] = []
    now: int | None = None
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        cuts = [0, *(np.nonzero(np.diff(shard))[0] + 1).tolist(), len(shard)]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            if start == stop:
                continue
            if now is not None and shard[start] != now:
                yield now, held
                held = []
            now = int(shard[start])
            held.append(batch.slice(start, stop - start))
    if now is not None:
        yield now, held


def probe(spark: SparkSession, index: DataFrame, probes: DataFrame, load: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """The rows of ``probes`` (key, h1, h2) whose line is in at least ``min_docs`` documents.

    Index and probes meet by shard: in the order (shard, copy) a task reads the arrays of a shard and then
    streams its probes past them, so that neither side is joined line by line or held as a group. A line
    of very many documents makes its shard hot. ``load`` (shard, probes) tells how many probes each shard
    draws; those above a fixed share of all are copied in proportion and their probes dealt over the copies.
    """
    total = load.agg(F.sum("probes")).first()[0] or 0
    share = max(1, int(total * HOT_SHARE))
    hot = load.filter(F.col("probes") > share).select(
        F.col("shard").alias("_hot"), F.ceil(F.col("probes") / share).cast("int").alias("_copies")
    )
    hot = F.broadcast(hot)  # at most 1 / HOT_SHARE rows
    copies = F.coalesce("_copies", F.lit(1))
    arrays = (
        index.join(hot, F.col("shard") == F.col("_hot"), "left")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
        .select(
            "shard", "copy", F.lit(0).alias("kind"), *PACKED, *[F.lit(None).cast("long").alias(c) for c in ("key", "h1", "h2")]
        )
    )
    asked = (
        probes.withColumn("shard", shard_of(shards))
        .join(hot, F.col("shard") == F.col("_hot"), "left")
        .withColumn("copy", F.pmod(F.xxhash64("key"), copies).cast("int"))
        .select("shard", "copy", F.lit(1).alias("kind"), *[F.lit(None).cast("binary").alias(c) for c in PACKED], "key", "h1", "h2")
    )
    met = (
        arrays.unionByName(asked)
        .repartition(parallelism(spark), "shard", "copy")
        .sortWithinPartitions("shard", "copy", "kind")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        shard: Shard | None = None
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            starts = np.nonzero(kind == 0)[0].tolist()
            if not starts or starts[0] != 0:
                starts = [-1, *starts]
            for start, stop in zip(starts, [*starts[1:], len(kind)], strict=True):
                if start >= 0:
                    shard = Shard.unpack(*(batch.column(c)[start].as_py() for c in PACKED))
                rows = batch.slice(start + 1, stop - start - 1)
                if rows.num_rows and shard is not None:
                    counts = shard.lookup(_u64(rows.column("h1")), _u64(rows.column("h2")))
                    yield rows.select(["key", "h1", "h2"]).filter(pa.array(counts >= min_docs))

    return in_batches(met, work, "key long, h1 long, h2 long")


def shared_lines(docs: DataFrame, key: Column, min_docs: int, min_chars: int) -> DataFrame:
    """(key, dropped): for each row key of ``docs`` (text) the hashes of its lines that go, 16 bytes each."""
    spark = docs.sparkSession
    hashes = written(line_hashes(docs, key, min_chars), "line-hashes")
    counts = written(hashes.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")), "line-counts")
    shards = max(4 * parallelism(spark), -(-counts.count() // SHARD_KEYS))
    load = counts.groupBy(shard_of(shards).alias("shard")).agg(F.sum("n").alias("probes"))
    found = probe(spark, build_index(counts, shards), hashes, load, shards, min_docs)
    padded = F.unhex(F.concat(F.lpad(F.hex("h1"), 16, "0"), F.lpad(F.hex("h2"), 16, "0")))
    return found.groupBy("key").agg(F.collect_set(padded).alias("dropped"))


def drop_shared_lines(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_docs: int = 10, min_chars: int = 1
) -> DataFrame:
    """All columns of ``docs`` plus n_lines, n_dropped and kept_text.

    Texts are cut at newlines. A line's key is the line without ASCII white space at its ends, A-Z in
    lower case. Keys of at least ``min_chars`` code points found in at least ``min_docs`` rows lose all
    their lines in every row; the other lines stay as they are, joined by newlines.

    Nulls and empty texts are one empty line, which stays. A null id is an id like any other. Every row
    counts as a document, so repeated rows make their lines shared. Columns of ``docs`` named like the
    added ones are replaced. Long texts are one row each and never cut; an empty table gives no rows.
    """
    named = docs.drop("n_lines", "n_dropped", "kept_text")
    columns = named.columns
    body = pick(named, id_col, text_col).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    gone = shared_lines(body, row_key(F.col("_id"), F.col("text")), min_docs, min_chars)
    places = named.toDF(*[f"c{i}" for i in range(len(columns))])
    text = F.col(f"c{columns.index(text_col)}").cast("string")
    keyed = places.withColumn("_key", row_key(F.col(f"c{columns.index(id_col)}"), text))
    met = keyed.join(gone.withColumnRenamed("key", "_gone"), F.col("_key") == F.col("_gone"), "left")
    met = met.withColumn("_text", text.cast("binary")).drop("_key", "_gone")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            n_lines: list[int] = []
            n_dropped: list[int] = []
            kept: list[bytes] = []
            for text, dropped in zip(batch.column("_text").to_pylist(), batch.column("dropped").to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                stay = lines
                if dropped:
                    gone = set(dropped)
                    stay = [x for x in lines if not _is_gone(line_key(x), gone, min_chars)]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay))
            own = [batch.column(i) for i in range(len(columns))]
            added = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [*own, *added], [*[f"c{i}" for i in range(len(columns))], "n_lines", "n_dropped", "kept"]
            )

    schema = ", ".join([f"c{i} {t}" for i, (_, t) in enumerate(named.dtypes)]) + ", n_lines long, n_dropped long, kept binary"
    out = in_batches(met, work, schema).withColumn("kept", F.col("kept").cast("string"))
    return out.toDF(*columns, "n_lines", "n_dropped", "kept_text")


def _is_gone(key: bytes, gone: set[bytes], min_chars: int) -> bool:
    return _long_enough(key, min_chars) and xxhash.xxh3_128_digest(key) in gone
