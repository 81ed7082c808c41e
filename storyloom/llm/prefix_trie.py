"""The trie of conversation prefixes, swept from the sorted containers of burst tries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import in_batches, parallelism, pick, written
from storyloom.operators.ordering import number_rows
from storyloom.operators.skew import lookup_join

#: Turns of a conversation that are one row; the next ones lie in a container under the prefix of all before.
SEGMENT = 256
#: A container with more turns than this, and more than one suffix, is burst.
CONTAINER_TURNS = 65_536
#: Ids that are hashed at a time, and segments whose sums are added up in one go.
CHUNK_IDS, BLOCK = 4096, 4096
#: Characters of a turn's id.
ID = 32
LANES = ("l1", "l2", "l3", "l4")

ENTRY = "key string, depth long, tids string, sizes array<long>, n long, conv long, goes_on boolean, entry_key string, head_bytes long, path array<string>"
SWEPT = (
    "kind string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, leaves long, saved long, "
    "own_leaf long, own_saved long, n_ends long, end_conv long, entry_key string, path array<string>, child_conv long, child_depth long"
)
_TYPES = {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    arrays = [pa.array(c, _TYPES[kind]) for c, (_, kind) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


# --- turns --------------------------------------------------------------------------------------


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """Stored (conv_id, pos, tid, size): turns numbered from 0, their ids (of role and text) and UTF-8 bytes of text.

    Null roles and texts are empty. Null turns come first; rows of one turn are in the order of their ids.
    Rows without conv_id belong to no conversation.
    """
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("tid"),
        F.octet_length(text).cast("long").alias("size"),
    ).filter("conv_id IS NOT NULL")
    order = [F.col("turn").asc_nulls_first(), F.col("tid").asc_nulls_first()]
    placed = number_rows(turns, ["conv_id"], order, out="pos").withColumn("pos", F.col("pos") - 1)
    return written(placed.select("conv_id", "pos", "tid", "size"), "turns")


def rebuilt(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) in which every conversation begins with turns of the first one of its ``every``.

    Conversation c takes the first h turns of conversation c - c % every, as far as there are, and goes on with
    its own turns after its first h; h is the CRC-32 of its number modulo ``most``. Conversations may be left
    without turns. ``%`` rounds towards zero, also for negative numbers.
    """
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h.alias("h"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(bases, "base", "left")
    convs = written(convs.withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))).drop("n_base"), "conversations")
    # A conversation may hold any share of the turns; its one row here is copied to groups of them.
    own = lookup_join(turns, convs.select("conv_id", "h", "taken"), "conv_id", ["pos"]).filter("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "tid", "size")
    first = turns.filter(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    lent = convs.select("conv_id", "base", "taken").join(first, "base").filter("pos < taken").select(*own.columns)
    return convs.select("conv_id"), own.unionByName(lent)


# --- segments -----------------------------------------------------------------------------------


def _before(rows: DataFrame, order: Column, values: tuple[str, ...]) -> DataFrame:
    """``rows`` with the sums of ``values`` over the earlier rows of their conversation in place of them.

    ``order`` numbers a conversation's rows; blocks of them are summed first, so none is summed in one task.
    """
    blocked = rows.withColumn("_order", order).withColumn("_block", F.floor(F.col("_order") / BLOCK))
    sums = [F.sum(v).alias(v) for v in values]
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy("conv_id", "_block").agg(*sums).select(
        "conv_id", "_block", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_{v}") for v in values]
    )
    inside = Window.partitionBy("conv_id", "_block").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    local = blocked.withColumns({v: F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    total = local.join(blocks, ["conv_id", "_block"]).withColumns({v: F.col(v) + F.col(f"_{v}") for v in values})
    return total.select(*rows.columns)


def _segments(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Stored rows of at most ``SEGMENT`` turns with the key of the prefix before them.

    The segment after a full one exists even if it has no turns, so every conversation ends inside one. Keys of
    later segments come from sums of 32-bit hashes of (place, turn) in four lanes, which need no order.
    """
    seg = F.floor(F.col("pos") / SEGMENT)
    held = F.struct("pos", "tid", "size")
    none = F.lit(None)
    here = F.struct(seg.alias("seg"), held.alias("turn"), none.cast("long").alias("head_bytes"))
    after = F.struct((seg + 1).alias("seg"), none.cast("struct<pos:bigint,tid:string,size:bigint>").alias("turn"), F.col("size").alias("head_bytes"))
    full = (F.col("pos") + 1) % SEGMENT == 0
    cells = turns.select("conv_id", F.explode(F.when(full, F.array(here, after)).otherwise(F.array(here))).alias("c"))
    cells = cells.select("conv_id", "c.*")
    start = convs.select("conv_id", F.lit(0).cast("long").alias("seg"), none.cast(cells.schema["turn"].dataType).alias("turn"), none.cast("long").alias("head_bytes"))
    lanes = [
        F.coalesce(F.sum(F.xxhash64(F.lit(k), "turn.pos", "turn.tid").bitwiseAND(0xFFFFFFFF) * F.col("turn").isNotNull().cast("long")), F.lit(0)).alias(lane)
        for k, lane in enumerate(LANES)
    ]
    segs = cells.unionByName(start).groupBy("conv_id", "seg").agg(
        F.sort_array(F.collect_list("turn")).alias("turns"),  # at most SEGMENT
        F.coalesce(F.max("head_bytes"), F.lit(0)).alias("head_bytes"),
        *lanes,
    )
    segs = segs.select(
        "conv_id",
        "seg",
        F.array_join(F.transform("turns", lambda t: t["tid"]), "").alias("tids"),
        F.transform("turns", lambda t: t["size"]).alias("sizes"),
        "head_bytes",
        *LANES,
    )
    segs = written(segs, "segments").withColumn("goes_on", F.length("tids") == SEGMENT * ID)
    # Segments of conversations that have several.
    several = segs.filter((F.col("seg") > 0) | F.col("goes_on")).select("conv_id", "seg", *LANES)
    key = F.md5(F.concat_ws(",", "seg", *[F.col(lane).bitwiseAND(0xFFFFFFFF) for lane in LANES]))
    keys = _before(several, F.col("seg"), LANES).filter("seg > 0").select("conv_id", "seg", key.alias("key"))
    kept = ["conv_id", "seg", "key", "tids", "sizes", "goes_on", "head_bytes"]
    roots = segs.filter("seg = 0").withColumn("key", F.lit("")).select(*kept)
    later = segs.filter("seg > 0").join(keys, ["conv_id", "seg"]).select(*kept)
    entry_key = F.when(~F.col("goes_on"), F.md5(F.concat_ws(":", "key", "tids")))
    return written(roots.unionByName(later).withColumn("entry_key", entry_key), "segment-keys")


# --- containers ---------------------------------------------------------------------------------


def _burst(entries: DataFrame, container_turns: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(containers, heads, kids, last): entries in containers that are small enough, and what lies above them.

    ``heads`` are the nodes that took the place of burst containers, ``kids`` the next turns under each, and
    ``last`` those of them at which a segment ends, so that their container is that of the next segment.
    A round bursts all oversized containers by their next turn; there are at most ``SEGMENT`` of them.
    """
    spark = entries.sparkSession
    open_ = entries.select(*[f.split()[0] for f in ENTRY.split(", ")])
    done, heads, kids, last = [], [], [], []
    turns, first = F.length("tids") / ID, F.substring("tids", 1, ID)
    while True:
        load = open_.groupBy("key").agg(F.sum(turns).alias("turns"), F.count(F.lit(1)).alias("entries"))
        big = written(load.filter((F.col("turns") > container_turns) & (F.col("entries") > 1)).select("key"), "oversized")
        if big.isEmpty():
            done.append(open_)
            break
        flagged = written(lookup_join(open_, big.withColumn("_big", F.lit(True)), "key", ["tids"]), "containers")
        done.append(flagged.filter("_big IS NULL").drop("_big"))
        burst = flagged.filter("_big").withColumn("next", first)
        ends = F.col("next") == ""
        by_next = burst.groupBy("key", "depth", "path", "head_bytes", "next").agg(
            F.sum("n").alias("n"), F.min("conv").alias("conv"), F.max(F.when(F.length("tids") == 0, F.col("entry_key"))).alias("entry_key")
        )
        by_next = written(by_next, "next-turns")
        heads.append(
            by_next.groupBy("key", "depth", "path", "head_bytes").agg(
                F.min("conv").alias("conv_id"),
                F.sum("n").alias("n_convs"),
                F.sum((~ends).cast("long")).alias("n_children"),
                F.coalesce(F.max(F.when(ends, F.col("n"))), F.lit(0)).alias("n_ends"),
                F.max(F.when(ends, F.col("conv"))).alias("end_conv"),
                F.max("entry_key").alias("entry_key"),
            )
        )
        kids.append(by_next.filter(~ends).select("key", "conv", (F.col("depth") + 1).alias("depth")))
        below = burst.filter(~ends).select(
            F.md5(F.concat_ws(":", "key", "next")).alias("key"),
            (F.col("depth") + 1).alias("depth"),
            F.expr(f"substring(tids, {ID + 1})").alias("tids"),
            F.expr("slice(sizes, 2, size(sizes))").alias("sizes"),
            "n",
            "conv",
            "goes_on",
            "entry_key",
            F.element_at("sizes", 1).alias("head_bytes"),
            F.concat("path", F.array("key")).alias("path"),
        )
        over = F.col("goes_on") & (F.length("tids") == 0)
        last.append(below.filter(over).select("conv", "depth", "path"))
        open_ = below.filter(~over)

    def all_of(found: list[DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)

    head = "key string, depth long, path array<string>, head_bytes long, conv_id long, n_convs long, n_children long, n_ends long, end_conv long, entry_key string"
    return (
        reduce(DataFrame.unionByName, done),
        written(all_of(heads, head), "trie-heads"),
        all_of(kids, "key string, conv long, depth long"),
        all_of(last, "conv long, depth long, path array<string>"),
    )


class _Node:
    __slots__ = ("depth", "bytes", "parent", "conv", "n", "children", "leaves", "saved", "n_ends", "end_conv", "entry_key", "goes_on")

    def __init__(self, depth: int, size: int, parent: _Node | None) -> None:
        self.depth, self.bytes, self.parent = depth, size, parent
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.n_ends, self.end_conv, self.entry_key, self.goes_on = 0, None, None, False

    def own(self) -> tuple[int, int]:
        """Itself as a leaf, and what it saves; a node that goes on in another container counts there."""
        return (0, 0) if self.goes_on else (int(not self.children), (self.n - 1) * self.bytes)

    def met(self, n: int, conv: int) -> None:
        self.n += n
        self.conv = conv if self.conv is None else min(self.conv, conv)

    def close(self) -> None:
        """All of its subtree is known: hand it up."""
        leaf, saved = self.own()
        self.leaves += leaf
        self.saved += saved
        if self.parent:
            self.parent.met(self.n, self.conv)
            self.parent.children += 1
            self.parent.leaves += self.leaves
            self.parent.saved += self.saved


def sweep(container: Iterable[dict]) -> list[tuple]:
    """``SWEPT`` rows of one container, whose entries come sorted by their turns.

    A path of open nodes moves over the entries: what an entry does not share with the one before is closed,
    and the rest of it opened. A node at which a segment ends is a link from each node above it.
    """
    nodes: list[_Node] = []
    path: list[_Node] = []
    before, above = "", None
    for e in container:
        tids, sizes = e["tids"], e["sizes"]
        if not nodes:
            above = e["path"]
            path = [_Node(e["depth"], e["head_bytes"], None)]
            nodes.append(path[0])
        shared = 0
        while shared < len(tids) and tids[shared : shared + ID] == before[shared : shared + ID]:
            shared += ID
        shared //= ID
        while len(path) > shared + 1:
            path.pop().close()
        for size in sizes[shared:]:
            path.append(_Node(path[-1].depth + 1, size, path[-1]))
            nodes.append(path[-1])
        end = path[-1]
        end.met(e["n"], e["conv"])
        if e["goes_on"]:
            end.goes_on = True
        else:
            end.n_ends, end.end_conv, end.entry_key = e["n"], e["conv"], e["entry_key"]
        before = tids
    while path:
        path.pop().close()
    rows: list[tuple] = []
    for node in nodes:
        up = node.parent
        if not node.goes_on:
            rows.append(
                ("node", node.conv, node.depth, up and up.conv, node.n, node.children, node.leaves, node.saved, *node.own(),
                 node.n_ends, node.end_conv, node.entry_key, None if up else above, None, None)
            )
        while node.goes_on and up:
            direct = above if up is node.parent else None
            rows.append(("link", up.conv, up.depth, *[None] * 10, direct, node.conv, node.depth))
            up = up.parent
    return rows


def _swept(containers: DataFrame) -> DataFrame:
    """``SWEPT`` rows of all containers: each sorted, and gone through once."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        rows: list[tuple] = []
        for _, container in groupby(entries(batches), itemgetter("key")):
            rows.extend(sweep(container))
            if len(rows) >= 10_000:
                yield _batch(rows, SWEPT)
                rows = []
        yield _batch(rows, SWEPT)

    shards = containers.repartition(parallelism(containers.sparkSession), "key").sortWithinPartitions("key", "tids")
    return in_batches(shards, work, SWEPT)


# --- what crosses containers --------------------------------------------------------------------


def _later_totals(segs: DataFrame, own: DataFrame) -> DataFrame:
    """(conv, depth, leaves, saved) of the subtree under every prefix that a later segment begins with.

    A node belongs to its smallest member. What a member's nodes hold from a segment on, summed over the members
    of the prefix before it, is the subtree: no level waits for the next.
    """
    weights = own.filter(F.col("depth") >= SEGMENT).groupBy("conv_id", F.floor(F.col("depth") / SEGMENT).alias("seg"))
    weights = weights.agg(F.sum("own_leaf").alias("leaves"), F.sum("own_saved").alias("saved"))
    mine = segs.filter("seg > 0").select("conv_id", "seg", "key").join(weights, ["conv_id", "seg"], "left")
    mine = mine.fillna(0, ["leaves", "saved"])
    after = _before(mine.select("conv_id", "seg", "leaves", "saved"), -F.col("seg"), ("leaves", "saved"))
    both = mine.unionByName(after.join(mine.select("conv_id", "seg", "key"), ["conv_id", "seg"]))
    return both.groupBy("key", "seg").agg(
        F.min("conv_id").alias("conv"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
    ).select("conv", (F.col("seg") * SEGMENT).alias("depth"), "leaves", "saved")


def _hashed_ends(segs: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry_key, sha256) of the ids, in ascending order, of conversations that end at one node, if several.

    Ids are sorted in ranges, which may cut a node's, and joined to texts of ``CHUNK_IDS``. A hash has to see its
    texts one after the other; it goes through them without holding more than one.
    """
    spark = segs.sparkSession
    shared = entries.filter((F.col("n") > 1) & F.col("entry_key").isNotNull()).select("entry_key")
    ids = segs.filter("entry_key IS NOT NULL").select("entry_key", "conv_id").join(shared, "entry_key", "left_semi")
    order = ["entry_key", "conv_id"]
    ranges = ids.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order)
    chunk = "entry_key string, first long, ids binary"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            rows: list[tuple] = []
            for k, i in zip(batch.column("entry_key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if held and (k != key or len(held) == CHUNK_IDS):
                    rows.append((key, held[0], ",".join(map(str, held)).encode()))
                    held = []
                key = k
                held.append(i)
            yield _batch(rows, chunk)
        if held:
            yield _batch([(key, held[0], ",".join(map(str, held)).encode())], chunk)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        parts = (r for batch in batches for r in batch.to_pylist())
        rows: list[tuple] = []
        for key, texts in groupby(parts, itemgetter("entry_key")):
            sha = hashlib.sha256()
            for at, part in enumerate(texts):
                sha.update(b"," + part["ids"] if at else part["ids"])
            rows.append((key, sha.hexdigest()))
        yield _batch(rows, "entry_key string, sha256 string")

    chunks = in_batches(ranges, join, chunk).repartition(parallelism(spark), "entry_key")
    return in_batches(chunks.sortWithinPartitions("entry_key", "first"), digest, "entry_key string, sha256 string")


def trie(convs: DataFrame, turns: DataFrame, container_turns: int = CONTAINER_TURNS) -> DataFrame:
    """Every node of the trie of ``turns`` (conv_id, pos from 0 without gaps, tid, size) of all ``convs`` (conv_id).

    A node is known by conv_id, its smallest member, and depth; its last turn is that member's. It has
    parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens (of its subtree: bytes of last
    turns that further members need not store) and ends_sha256 (of the members that end there). No conversations
    give no nodes. A conversation may be of any length, and any share of them may be alike or begin alike: equal
    suffixes of a container are one entry with a count.
    """
    segs = _segments(convs, turns)
    entries = segs.groupBy("key", (F.col("seg") * SEGMENT).alias("depth"), "tids", "goes_on", "entry_key").agg(
        F.first("sizes").alias("sizes"),
        F.count(F.lit(1)).alias("n"),
        F.min("conv_id").alias("conv"),
        F.max("head_bytes").alias("head_bytes"),
    )
    entries = written(entries.withColumn("path", F.array().cast("array<string>")), "entries")
    containers, heads, kids, last = _burst(entries, container_turns)
    swept = written(_swept(containers), "swept")
    nodes, links = swept.filter("kind = 'node'"), swept.filter("kind = 'link'")

    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    head_saved = ((F.col("n_convs") - 1) * F.col("head_bytes")).alias("own_saved")
    own = nodes.select("conv_id", "depth", "own_leaf", "own_saved").unionByName(heads.select("conv_id", "depth", zero.alias("own_leaf"), head_saved))
    later = written(_later_totals(segs, own), "later-totals")
    child = ["child_conv", "child_depth"]
    totals = later.withColumnsRenamed({"conv": "child_conv", "depth": "child_depth"})
    to_nodes = links.select("conv_id", "depth", *child).join(totals, child).select("conv_id", "depth", "leaves", "saved")
    crossing = links.select(*child, "path").unionByName(last.withColumnsRenamed({"conv": "child_conv", "depth": "child_depth"}))
    to_heads = [
        nodes.select("path", "leaves", "saved"),
        heads.select("path", zero.alias("leaves"), head_saved.alias("saved")),
        crossing.join(totals, child).select("path", "leaves", "saved"),
    ]
    by_key = reduce(DataFrame.unionByName, to_heads).select(F.explode("path").alias("key"), "leaves", "saved")
    by_key = by_key.groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    to_heads = by_key.join(heads.select("key", "conv_id", "depth"), "key").select("conv_id", "depth", "leaves", "saved")
    direct = links.filter(F.col("depth") == F.col("child_depth") - 1)
    parents = direct.select(F.col("child_conv").alias("conv_id"), F.col("child_depth").alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    burst = lookup_join(kids, heads.select("key", F.col("conv_id").alias("parent_conv_id")), "key", ["conv"])
    parents = parents.unionByName(burst.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id"))

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "leaves", "saved", "n_ends", "end_conv", "entry_key"]
    rows = [
        nodes,
        heads.withColumns({"parent_conv_id": none, "leaves": zero, "saved": (F.col("n_convs") - 1) * F.col("head_bytes")}),
        parents,
        to_nodes.unionByName(to_heads),
    ]
    present = [[c if c in df.columns else F.lit(None).cast("string" if c == "entry_key" else "long").alias(c) for c in columns] for df in rows]
    merged = reduce(DataFrame.unionByName, [df.select(*cs) for df, cs in zip(rows, present, strict=True)])
    merged = merged.groupBy("conv_id", "depth").agg(
        *[F.max(c).alias(c) for c in ("parent_conv_id", "n_convs", "n_children", "n_ends", "end_conv", "entry_key")],
        F.sum("leaves").alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"),
    )
    # Nodes at which none or one ends need no other table and get keys of their own.
    at = F.when(F.col("n_ends") > 1, F.col("entry_key")).otherwise(F.concat_ws("/", "conv_id", "depth"))
    hashes = _hashed_ends(segs, entries).withColumnRenamed("entry_key", "_at")
    named = merged.withColumn("_at", at).join(hashes, "_at", "left")
    ends = F.when(F.col("n_ends") > 1, F.col("sha256")).otherwise(F.sha2(F.coalesce(F.col("end_conv").cast("string"), F.lit("")), 256))
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends.alias("ends_sha256"))


def prefix_trie(
    conversations: DataFrame, every: int = 5, most: int = 9, container_turns: int = CONTAINER_TURNS
) -> DataFrame:
    """``trie`` of the ``rebuilt`` conversations of (conv_id, turn, role, text), read by ``ordered_turns``.

    Nulls: roles and texts are empty then, null turns come first, rows without conv_id are left out. Rows that
    repeat a turn are turns of their own. Texts are read once, for their ids and sizes. An empty table gives no
    rows; other columns are not read.
    """
    return trie(*rebuilt(ordered_turns(conversations), every, most), container_turns)
