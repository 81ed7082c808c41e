"""SimHash near-duplicates by exact comparison of tiles of fingerprints."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import by_place, forget, in_batches, parallelism, texts, written
from storyloom.llm.components import components
from storyloom.operators.skew import lookup_join

SEED = 42
#: Hashes counted, and fingerprint pairs compared, at one time: bounds memory for any text or tile.
HASHES_AT_ONCE = 1 << 16
PAIRS_AT_ONCE = 1 << 17
#: Distinct fingerprints of a tile. Small inputs take smaller tiles, so that tasks stay many.
MIN_TILE, MAX_TILE, TILES = 1 << 11, 1 << 16, 48
#: Bytes of shingle hashes of a block of texts that are checked against each other.
MIN_BLOCK, MAX_BLOCK = 1 << 18, 1 << 23


def shingles(text: bytes | None, width: int) -> list[bytes]:
    """Windows of ``width`` words, A-Z in lower case; all words if there are fewer, nothing if none."""
    words = (text or b"").lower().split()  # ASCII letters and ASCII white space only
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


def _mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Lane 0 is the hash itself, further lanes are drawn from it (splitmix64)."""
    if lane == 0:
        return hashes
    z = hashes + np.uint64((0x9E3779B97F4A7C15 * lane) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _hashes(text: bytes | None, width: int) -> np.ndarray:
    found = shingles(text, width)
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found))


def _majority(hashes: np.ndarray, lanes: int) -> list[int]:
    """64 bits a lane: a bit is 1 if it is set in over half of the hashes. No hashes: zero."""
    out = []
    counts = np.zeros((lanes, 64), np.int64)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        for lane in range(lanes):
            part = _mixed(hashes[at : at + HASHES_AT_ONCE], lane)
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[lane] += bits.sum(axis=0, dtype=np.int64)
    for lane in range(lanes):
        set_bits = np.packbits(counts[lane] * 2 > len(hashes), bitorder="little")
        out.append(int(set_bits.view(np.uint64)[0]))
    return out


def fingerprint(text: bytes | None, width: int = 3, lanes: int = 1) -> list[int]:
    """The majority of a text's shingle hashes, each as often as it occurs. No words: zero."""
    return _majority(_hashes(text, width), lanes)


def fingerprints(docs: DataFrame, width: int = 3, lanes: int = 1) -> DataFrame:
    """``fingerprint`` (16 lowercase hex digits a lane) in place of ``text``, for every row of ``docs``."""
    others = [c for c in docs.columns if c != "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            found = [
                "".join(f"{lane:016x}" for lane in fingerprint(t, width, lanes)) for t in batch.column("text").to_pylist()
            ]
            own = [batch.column(c) for c in others]
            yield pa.RecordBatch.from_arrays([*own, pa.array(found, pa.string())], [*others, "fingerprint"])

    source = docs.select(*others, F.col("text").cast("binary").alias("text"))
    kinds = [f"{c} {t}" for c, t in docs.dtypes if c != "text"]
    return in_batches(source, work, ", ".join([*kinds, "fingerprint string"]))


def _forest(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``radius`` between rows of two tiles (n x lanes), as (fingerprint, smallest linked one).

    Every linked pair is found. A component of n fingerprints gives n - 1 links to its smallest one and
    not all its pairs, so a dense group stays small.
    """
    nodes = left if same else np.concatenate([left, right])
    order = np.lexsort(nodes.T[::-1])
    rank = np.empty(len(nodes), np.int64)
    rank[order] = np.arange(len(nodes))
    rank_left, rank_right = rank[: len(left)], rank if same else rank[len(left) :]
    parent = np.arange(len(nodes))
    for a, b, _ in _close(left, right, radius, same):
        a, b = rank_left[a], rank_right[b]
        while len(a):
            a, b = _roots(parent, a), _roots(parent, b)
            apart = a != b
            high, low = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
            # A root hooks to one smaller root at a time; links that lose are tried again.
            hooked, first = np.unique(high, return_index=True)
            parent[hooked] = low[first]
            a, b = high, low
    roots = _roots(parent, np.arange(len(nodes)))
    moved = np.nonzero(roots != np.arange(len(nodes)))[0]
    return nodes[order[roots[moved]]], nodes[order[moved]]


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    found = parent[at]
    while True:
        up = parent[found]
        if np.array_equal(up, found):
            parent[at] = found
            return found
        found = up


def _lanes(packed: bytes, lanes: int) -> np.ndarray:
    return np.frombuffer(packed, ">u8").astype(np.uint64).reshape(-1, lanes)


def tiles(distinct: DataFrame, lanes: int) -> tuple[DataFrame, dict[int, int]]:
    """``distinct`` (fingerprint) dealt to tiles (ones, part): equal population counts, a bounded size.

    Also returns how many parts each population count has: at most 64 x lanes + 1 numbers.
    """
    ones = sum(
        F.bit_count(F.conv(F.substring("fingerprint", 8 * i + 1, 8), 16, 10).cast("long")) for i in range(2 * lanes)
    )
    counted = distinct.withColumn("ones", ones)
    counts = {r["ones"]: r["n"] for r in counted.groupBy("ones").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = min(MAX_TILE, max(MIN_TILE, sum(counts.values()) // TILES))
    parts = {k: -(-n // size) for k, n in counts.items()}
    of = F.create_map(*[F.lit(x) for k, n in parts.items() for x in (k, n)]) if parts else F.lit(None)
    part = F.pmod(F.xxhash64("fingerprint"), of[F.col("ones")]) if parts else F.lit(0)
    return counted.withColumn("part", part.cast("int")), parts


def tile_pairs(distinct: DataFrame, radius: int, lanes: int = 1) -> DataFrame | None:
    """(same, left, right): packed tiles of ``distinct`` (fingerprint), one row for each pair that can match.

    Pairs of tiles whose population counts differ by more than the radius are left out: each differing bit
    moves the count by one. A tile travels once for each tile that it meets. The pairs are made by the
    executors from the bounded list of population counts. None if there is nothing to compare.
    """
    dealt, parts = tiles(distinct, lanes)
    if not parts:
        return None
    spark = distinct.sparkSession
    packed = written(
        dealt.groupBy("ones", "part").agg(F.unhex(F.array_join(F.sort_array(F.collect_list("fingerprint")), "")).alias("held")),
        "simhash-tiles",
    )
    counts = spark.createDataFrame(sorted(parts.items()), "ones int, parts int")
    pairs = (
        counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("ones2", F.explode(F.sequence(F.col("ones"), F.col("ones") + radius)))
        .join(F.broadcast(counts.select(F.col("ones").alias("ones2"), F.col("parts").alias("parts2"))), "ones2")
        .withColumn("part2", F.explode(F.sequence(F.lit(0), F.col("parts2") - 1)))
        .filter((F.col("ones2") > F.col("ones")) | (F.col("part2") >= F.col("part")))
        .select("ones", "part", "ones2", "part2")
    )
    joined = (
        pairs.join(packed, ["ones", "part"])
        .select("ones", "part", "ones2", "part2", F.col("held").alias("left"))
        .join(packed.toDF("ones2", "part2", "right"), ["ones2", "part2"])
        .withColumn("same", (F.col("ones") == F.col("ones2")) & (F.col("part") == F.col("part2")))
    )
    # Spread by pair, so that the comparisons of a large population count do not meet in one task.
    return joined.repartition(4 * parallelism(spark), "ones", "part", "ones2", "part2").select("same", "left", "right")


def _each_pair(batches: Iterator[pa.RecordBatch], lanes: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            left, right = (_lanes(batch.column(c)[i].as_py(), lanes) for c in ("left", "right"))
            yield batch.column("same")[i].as_py(), left, right


def links(distinct: DataFrame, radius: int, lanes: int = 1) -> DataFrame:
    """(a, b): links that join the same components as all pairs in ``distinct`` (fingerprint) that differ in
    at most ``radius`` bits. The work is that of all pairs of distinct fingerprints in reach."""
    pairs = tile_pairs(distinct, radius, lanes)
    if pairs is None:
        return distinct.select(F.col("fingerprint").alias("a"), F.col("fingerprint").alias("b")).limit(0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for same, left, right in _each_pair(batches, lanes):
            a, b = _forest(left, right, radius, same)
            yield pa.RecordBatch.from_arrays([_hex(a), _hex(b)], ["a", "b"])

    return in_batches(pairs, work, "a string, b string")


def _close(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """All pairs within ``radius`` with their differing bits, a bounded block of comparisons at a time."""
    step = max(1, PAIRS_AT_ONCE // max(1, len(right)))
    for at in range(0, len(left), step):
        start = at if same else 0  # within a tile, only later rows
        rows, other = left[at : at + step], right[start:]
        gap = np.bitwise_count(rows[:, None, 0] ^ other[None, :, 0])
        for lane in range(1, left.shape[1]):
            gap = gap + np.bitwise_count(rows[:, None, lane] ^ other[None, :, lane])
        a, b = np.nonzero(gap <= radius)
        close = gap[a, b].astype(np.int64)
        a, b = a + at, b + start
        apart = a != b if same else slice(None)
        if len(a[apart]):
            yield a[apart], b[apart], close[apart]


def _spanning(edges: np.ndarray, forests: int) -> np.ndarray:
    """The edges (a, b, gap) of successive minimal spanning forests, the smallest gaps first."""
    nodes, ends = np.unique(edges[:, :2] * 2 + [[0, 1]], return_inverse=True)  # sides of a pair keep apart
    ends = ends.reshape(-1, 2)
    left = np.argsort(edges[:, 2], kind="stable")
    kept = []
    for _ in range(forests):
        parent = np.arange(len(nodes))
        chosen = np.zeros(len(edges), bool)
        for level in np.split(left, np.nonzero(np.diff(edges[left, 2]))[0] + 1):
            rest = level
            while len(rest):
                a, b = _roots(parent, ends[rest, 0]), _roots(parent, ends[rest, 1])
                apart = a != b
                rest, a, b = rest[apart], a[apart], b[apart]
                high, low = np.maximum(a, b), np.minimum(a, b)
                hooked, first = np.unique(high, return_index=True)
                parent[hooked] = low[first]
                chosen[rest[first]] = True
        kept.append(left[chosen[left]])
        left = left[~chosen[left]]
    return edges[np.concatenate(kept)]


def _hex(nodes: np.ndarray) -> pa.Array:
    return pa.array([row.astype(">u8").tobytes().hex() for row in nodes], pa.string())


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, lanes: int = 1
) -> DataFrame:
    """(doc_id, fingerprint, component_id, component) for every row of ``docs``.

    ``component_id`` is the smallest doc_id that can be reached over links of at most ``radius`` differing
    bits, the row's own included; ``component`` is the smallest fingerprint. Rows with equal fingerprints
    are linked whatever their number, as one node.

    Nulls: a null text is an empty one, with fingerprint zero; a null id is never the smallest, and
    component_id is null if all ids of a component are. Repeated rows stay repeated. Long texts are
    counted in pieces. An empty table gives no rows. Columns other than the two named are not read.
    """
    marked = written(fingerprints(texts(docs, id_col, text_col), width, lanes), "simhash")
    nodes = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    nodes = written(nodes, "simhash-nodes")
    found = components(links(nodes.select("fingerprint"), radius, lanes))
    whole = nodes.join(found, F.col("fingerprint") == F.col("node"), "left").withColumn(
        "component", F.coalesce("root", "fingerprint")
    )
    # Components of a third of all nodes are possible: the smallest id is aggregated first, then dealt back.
    whole = written(whole.select("fingerprint", "first", "component"), "simhash-components")
    smallest = whole.groupBy("component").agg(F.min("first").alias("component_id"))
    named = lookup_join(whole, smallest, "component", ["fingerprint"]).select("fingerprint", "component", "component_id")
    named = written(named, "simhash-named")
    return lookup_join(marked, named, "fingerprint", ["doc_id"]).select(
        "doc_id", "fingerprint", "component_id", "component"
    )


def expected_bits(similarity: float, lanes: int) -> tuple[float, float]:
    """Mean and deviation of the differing bits of texts whose shingle sets are that similar (Jaccard)."""
    share = acos(2 * similarity / (1 + similarity)) / pi
    return 64 * lanes * share, sqrt(64 * lanes * share * (1 - share))


def similar_groups(
    rows: DataFrame, width: int = 5, similarity: float = 0.8, lanes: int = 2, margin: float = 3.0
) -> DataFrame:
    """``rows`` (key, text, ...) with ``component`` in place of ``text``: equal for the rows of a group.

    Groups hold together by links between texts whose sets of ``width`` words have a Jaccard similarity of
    at least ``similarity``. Fingerprints within the bits that such texts differ by, plus ``margin``
    deviations, are candidates; repeated shingles count once in them. Of these none is left out: each pair is checked on the shingles of both
    texts, or its texts are already joined by links that were. Texts with the same set of shingles are one
    group, and so are all texts without words; texts that share just a fingerprint are candidates like
    others. ``key`` must be the same for equal texts only.
    """
    marked = written(_sketched(rows, width, lanes), "simhash")
    firsts = [F.min(c).alias(c) for c in ("fingerprint", "size", "key")]
    nodes = written(marked.groupBy("node").agg(*firsts), "simhash-nodes")
    mean, deviation = expected_bits(similarity, lanes)
    radius = int(mean + margin * deviation)
    near = components(links(nodes.select("fingerprint").distinct(), radius, lanes))
    near = near.select(F.col("node").alias("fingerprint"), F.col("root").alias("near"))
    placed = lookup_join(nodes, near, "fingerprint", ["node"]).withColumn("near", F.coalesce("near", "fingerprint"))
    pairs = _block_pairs(rows, written(placed, "simhash-near"), width)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        forget()
        for batch in batches:
            a, b = [], []
            for left, right in zip(batch.column("left"), batch.column("right")):
                block = _Block.of(left, lanes)
                ends = _checked(block, _Block.of(right, lanes) if right.is_valid else block, radius, similarity)
                a += ends[0]
                b += ends[1]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])

    linked = written(in_batches(pairs, work, "a string, b string"), "simhash-links")
    named = lookup_join(marked, components(linked), "node", ["key"])
    return named.withColumn("component", F.coalesce("root", "node")).drop("node", "fingerprint", "size", "root")


def _sketched(rows: DataFrame, width: int, lanes: int) -> DataFrame:
    """``rows`` with (node, fingerprint, size) in place of ``text``: a node for each set of shingles.

    The fingerprint is that of the set, since similarity is one of sets: repeats would move it.
    """
    others = [c for c in rows.columns if c != "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        forget()
        for batch in batches:
            nodes, prints, sizes = [], [], []
            for text in batch.column("text").to_pylist():
                own_set = _hash_set(text, width)
                prints.append("".join(f"{lane:016x}" for lane in _majority(own_set, lanes)))
                nodes.append(xxhash.xxh3_128_hexdigest(own_set.tobytes()))
                sizes.append(len(own_set))
            found = [pa.array(nodes, pa.string()), pa.array(prints, pa.string()), pa.array(sizes, pa.int64())]
            own = [batch.column(c) for c in others]
            yield pa.RecordBatch.from_arrays([*own, *found], [*others, "node", "fingerprint", "size"])

    source = rows.select(*others, F.col("text").cast("binary").alias("text"))
    kinds = [f"{c} {t}" for c, t in rows.dtypes if c != "text"]
    return in_batches(source, work, ", ".join([*kinds, "node string", "fingerprint string", "size long"]))


def _hash_set(text: bytes | None, width: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, in order."""
    return np.unique(_hashes(text, width))


def _block_pairs(rows: DataFrame, placed: DataFrame, width: int) -> DataFrame:
    """(left, right): blocks of texts to check, one row for each pair of blocks; ``right`` is null for a block itself.

    ``placed`` (node, fingerprint, size, key, near) are the texts; only those of one ``near`` can be similar,
    and most of these are one block. A large one is cut into blocks of a bounded size, dealt by hash.
    """
    spark = rows.sparkSession
    groups = placed.groupBy("near").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    groups = written(groups.filter("n > 1").select("near", (F.col("size") * 8).alias("bytes")), "simhash-groups")
    block = min(MAX_BLOCK, max(MIN_BLOCK, (groups.agg(F.sum("bytes")).first()[0] or 0) // TILES))
    groups = groups.select("near", F.ceil(F.greatest("bytes", F.lit(1)) / block).cast("int").alias("parts"))
    dealt = lookup_join(placed, groups, "near", ["node"]).filter("parts IS NOT NULL")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    # One text a node, only for those that are in a group.
    chosen = rows.select("key", "text").join(dealt.drop("size", "parts"), "key").dropDuplicates(["node"])
    packed = _shingled(chosen.drop("key"), width).groupBy("near", "part")
    packed = written(packed.agg(F.collect_list(F.struct("node", "fingerprint", "shingles")).alias("held")), "simhash-blocks")
    alone = packed.select("near", "part", F.col("part").alias("part2"), F.col("held").alias("left"))
    alone = alone.withColumn("right", F.lit(None).cast(packed.schema["held"].dataType))
    between = (
        groups.filter("parts > 1")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 2)))
        .withColumn("part2", F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)))
        .select("near", "part", "part2")
        .join(packed.withColumnRenamed("held", "left"), ["near", "part"])
        .join(packed.toDF("near", "part2", "right"), ["near", "part2"])
        .select(*alone.columns)
    )
    spread = alone.union(between).repartition(4 * parallelism(spark), "near", "part", "part2")
    return spread.select("left", "right")


@dataclass
class _Block:
    """Texts that travel together: ``hashes[starts[i] : starts[i] + sizes[i]]`` are the shingles of the i-th, in order."""

    nodes: pa.Array
    prints: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, held: pa.Scalar, lanes: int) -> _Block:
        nodes, prints, sets = held.values.flatten()
        sizes = pc.list_value_length(sets).to_numpy(zero_copy_only=False).astype(np.int64)
        packed = bytes.fromhex("".join(prints.to_pylist()))
        return cls(nodes, _lanes(packed, lanes), sets.flatten().to_numpy().view(np.uint64), np.cumsum(sizes) - sizes, sizes)

    def similar(self, own: np.ndarray, at: np.ndarray, similarity: float) -> np.ndarray:
        """Those of the texts ``at`` whose shingles are similar to ``own``."""
        sizes = self.sizes[at]
        able = (sizes > 0) & (np.minimum(sizes, len(own)) >= similarity * np.maximum(sizes, len(own)))
        at, sizes = at[able], sizes[able]
        if not len(at):
            return at
        first = np.cumsum(sizes) - sizes
        theirs = self.hashes[np.repeat(self.starts[at] - first, sizes) + np.arange(sizes.sum())]
        met = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
        shared = np.add.reduceat(met, first, dtype=np.int64)
        return at[shared >= similarity * (sizes + len(own) - shared)]


def _checked(left: _Block, right: _Block, radius: int, similarity: float) -> tuple[list[str], list[str]]:
    """Links between similar texts of two blocks, or of one with itself, that join what all such links join.

    Every pair within the radius is checked unless links found before have joined it, those of a minimal
    spanning forest first, as they are the most likely to hold. At most one link less than texts is found.
    """
    same = left is right
    shift = 0 if same else len(left.sizes)
    parent = np.arange(shift + len(right.sizes))
    ends: list[np.ndarray] = []
    for a, b, gap in _close(left.prints, right.prints, radius, same):
        every = np.stack([a, b, gap], axis=1)
        for edges in (_spanning(every, 1), every):
            edges = edges[_roots(parent, edges[:, 0]) != _roots(parent, edges[:, 1] + shift)]
            edges = edges[np.argsort(edges[:, 0], kind="stable")]
            for part in np.split(edges, np.nonzero(np.diff(edges[:, 0]))[0] + 1) if len(edges) else []:
                one, others = part[:1, 0], part[:, 1]
                others = others[_roots(parent, others + shift) != _roots(parent, one)]
                own = left.hashes[left.starts[one[0]] : left.starts[one[0]] + left.sizes[one[0]]]
                found = right.similar(own, others, similarity)
                # Of those that are joined with each other already, one is enough.
                roots, first = np.unique(_roots(parent, found + shift), return_index=True)
                met = np.append(roots, _roots(parent, one))
                parent[met] = met.min()
                ends.append(np.stack([np.repeat(one, len(first)), found[first]], axis=1))
    both = np.concatenate([np.zeros((0, 2), np.int64), *ends])
    return left.nodes.take(pa.array(both[:, 0])).to_pylist(), right.nodes.take(pa.array(both[:, 1])).to_pylist()


def _shingled(docs: DataFrame, width: int) -> DataFrame:
    """``docs`` with ``shingles``, the distinct hashes of a text's shingles in order, in place of ``text``."""
    others = [c for c in docs.columns if c != "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            found = [_hash_set(t, width).view(np.int64) for t in batch.column("text").to_pylist()]
            own = [batch.column(c) for c in others]
            yield pa.RecordBatch.from_arrays([*own, pa.array(found, pa.list_(pa.int64()))], [*others, "shingles"])

    source = docs.select(*others, F.col("text").cast("binary").alias("text"))
    kinds = [f"{c} {t}" for c, t in docs.dtypes if c != "text"]
    return in_batches(source, work, ", ".join([*kinds, "shingles array<long>"]))


def without_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8
) -> DataFrame:
    """``docs`` with one row of each of ``similar_groups``: that of the smallest id, null ids last.

    All columns stay. Rows of one id are told apart by a hash of all their columns; equal rows count as
    one. Null and empty texts, and those of white space, are one group. An empty table stays empty.
    """
    unique, column = by_place(docs)
    keyed = unique.withColumn("key", F.xxhash64(*unique.columns))
    rows = keyed.select("key", column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"))
    first = F.min(F.struct(F.col("id").isNull(), "id", "key"))
    best = similar_groups(rows, width, similarity).groupBy("component").agg(first.alias("best")).select("best.key")
    met = keyed.join(best, "key", "left_semi").dropDuplicates(["key"])
    return met.select(*unique.columns).toDF(*docs.columns)
