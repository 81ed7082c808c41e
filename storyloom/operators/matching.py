"""Exact nearest-match join on cosine similarity.

``earlier_matches`` finds, for every item, the most similar *other* vector that comes earlier in a
total order and reaches a threshold. It returns at most one row per item and never lists pairs.

Other vectors of at most ``SHIPPED_BYTES`` together are shipped to the items, which then need no shuffle. Beyond that
the others are split into cells around sampled pivots (as in cluster joins over metric spaces: Das Sarma, He,
Chaudhuri, VLDB 2014). Small neighbouring cells fill a block together; a large one is cut into shells by the angle to
its pivot, and shells into blocks of bounded size, so a dense region spreads over many tasks. The triangle inequality on angles tells, before anything is copied, which shells
may hold a match of an item; shells that begin later than the item hold none either. Inside a block of long vectors,
dot products of a few leading coordinates of a rotated basis and the norms of the rest bound the similarity from above
(Cauchy-Schwarz); only pairs whose bound reaches the threshold are compared in full. All of this is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 8_192
#: Bytes of vectors that may come to the driver, to be shipped to the items or to serve as pivots.
SHIPPED_BYTES = 64 * 1024 * 1024
TILE_ROWS = 1_024
#: Leading coordinates that bound similarities, vectors that are long enough for it, and the share of pairs in reach
#: above which a whole product is cheaper.
HEAD, LONG, SPARSE = 16, 64, 0.02
#: Angles a shell is cut by at most; the rest of a cell's size goes into blocks.
MOST_SHELLS = 64
PIVOTS_A_BLOCK = 32
#: Blocks that others are cut into while they fit ``BLOCK_ROWS``: a vector may be copied to all of them.
MOST_BLOCKS = 8
#: Cells that are chained by nearness at a time.
CHAINED = 4_096
#: Bytes of a row of facts about a shell, at most.
SHELL_BYTES = 64
# Similarities are compared at this many decimals, so summation order cannot change a tie.
DECIMALS = 12
ROUNDING = 1e-9
# Near pairs listed at a time inside one tile.
PAIRS = 1_000_000
ANGLE_SLACK = 1e-6

FIRST = -(2**63)
VECTOR_FIELDS = ("id", "pos", "vector")
_VECTOR_SCHEMA = "id long, pos long, vector array<float>"
_MATCH_SCHEMA = "id long, match_id long, similarity double"


def vector_frame(df: DataFrame, id_col: str, vector_col: str, pos=None) -> DataFrame:
    """(id, pos, vector): rows are ordered by ``pos``, then ``id``. NULL ``pos`` goes last."""
    position = F.coalesce(pos, F.lit(2**63 - 1)) if pos is not None else F.lit(0)
    return df.select(
        F.col(id_col).cast("long").alias("id"),
        position.cast("long").alias("pos"),
        F.col(vector_col).cast("array<float>").alias("vector"),
    )


def _unit(vectors) -> np.ndarray:
    m = np.asarray(np.stack(vectors), dtype=np.float64)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _usable(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows that can match at a positive threshold: not empty, not all zero, no NULL parts."""
    keep = []
    for v in pdf["vector"]:
        a = None if v is None else np.asarray(v, dtype=np.float64)
        keep.append(a is not None and a.size > 0 and bool(np.isfinite(a).all()) and bool(a.any()))
    return pdf[keep]


def _prepared(others: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, positions and unit vectors in id order, so that the first of equals has the smallest id."""
    others = others.sort_values("id")
    return others["id"].to_numpy(), others["pos"].to_numpy(), _unit(others["vector"])


def _rotation(sample: np.ndarray) -> np.ndarray:
    """The directions that hold most of a sample's vectors: what is left outside of them is short."""
    _, directions = np.linalg.eigh(sample.T @ sample)
    return directions[:, ::-1][:, :HEAD]


def _rests(heads: np.ndarray) -> np.ndarray:
    """Norms of what unit vectors have outside of their heads."""
    return np.sqrt(np.maximum(1.0 - (heads * heads).sum(axis=1), 0.0))


def _in_reach(left: np.ndarray, right: np.ndarray, head: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray | None]:
    """(which pairs may reach the threshold, similarities of all pairs or None where few are left to compute)."""
    if head is not None:
        l, r = left @ head, right @ head
        near = l @ r.T + np.outer(_rests(l), _rests(r)) >= threshold - ANGLE_SLACK
        if near.mean() <= SPARSE:
            return near, None
    sim = left @ right.T
    return sim >= threshold - ROUNDING, sim


def _best_in_block(items: pd.DataFrame, others: tuple, threshold: float, head: np.ndarray | None = None) -> pd.DataFrame:
    """Best earlier match of each item within one bounded block; both sides have one length."""
    o_ids, o_pos, o_unit = others
    if head is not None and len(head) != o_unit.shape[1]:
        head = None
    out = []
    for lo in range(0, len(items), TILE_ROWS):
        tile = items.iloc[lo : lo + TILE_ROWS]
        ids, pos = tile["id"].to_numpy(), tile["pos"].to_numpy()
        unit = _unit(tile["vector"])
        near, sim = _in_reach(unit, o_unit, head, threshold)
        # Rows in a dense story are cut into groups, so that the list of near pairs stays bounded.
        per_row = np.maximum(near.sum(axis=1), 1)
        for rows in np.split(np.arange(len(tile)), np.flatnonzero(np.diff(np.cumsum(per_row) // PAIRS)) + 1):
            r, c = np.nonzero(near[rows])
            r = rows[r]
            # Few pairs are left where there is no product of all, some thousands at a time.
            exact = sim[r, c] if sim is not None else _dots(unit, o_unit, r, c)
            s = np.round(exact, DECIMALS)
            fits = (s >= threshold) & ((o_pos[c] < pos[r]) | ((o_pos[c] == pos[r]) & (o_ids[c] < ids[r])))
            r, c, s = r[fits], c[fits], s[fits]
            order = np.lexsort((c, -s, r))
            r, c, s = r[order], c[order], s[order]
            first = np.flatnonzero(np.diff(r, prepend=-1))
            out.append(pd.DataFrame({"id": ids[r[first]], "match_id": o_ids[c[first]], "similarity": s[first]}))
    return pd.concat(out) if out else pd.DataFrame(columns=["id", "match_id", "similarity"])


def _dots(left: np.ndarray, right: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(r))
    for lo in range(0, len(r), 4 * TILE_ROWS):
        at = slice(lo, lo + 4 * TILE_ROWS)
        out[at] = np.einsum("ij,ij->i", left[r[at]], right[c[at]])
    return out


def _by_length(pdf: pd.DataFrame):
    return pdf.groupby(pdf["vector"].map(len))


def _against(others: pd.DataFrame, threshold: float):
    others = _usable(others)
    sides = {n: _prepared(g) for n, g in _by_length(others)} if len(others) else {}

    def match(batches):
        for pdf in batches:
            pdf = _usable(pdf)
            for n, group in _by_length(pdf):
                if n in sides:
                    yield _best_in_block(group, sides[n], threshold)

    return match


def _nearest(pivots: np.ndarray):
    """(cell, angle) of the nearest pivot, for a count of the cells."""

    def assign(batches):
        for pdf in batches:
            pdf = _usable(pdf)
            pdf = pdf[pdf["vector"].map(len) == pivots.shape[1]]
            for lo in range(0, len(pdf), TILE_ROWS):
                angle = np.arccos(np.clip(_unit(pdf["vector"].iloc[lo : lo + TILE_ROWS]) @ pivots.T, -1.0, 1.0))
                yield pd.DataFrame({"cell": angle.argmin(axis=1), "angle": angle.min(axis=1)})

    return assign


def _grouped(pivots: np.ndarray, counts: np.ndarray, block_rows: int) -> np.ndarray:
    """A group for each cell: neighbouring cells that fill a block together, and full cells alone.

    From a cell the nearest free one comes next, in chunks of cells along the direction in which pivots differ most.
    """
    if not len(pivots):
        return np.empty(0, int)
    direction = np.linalg.eigh(np.cov(pivots.T))[1][:, -1] if len(pivots) > 1 and pivots.shape[1] > 1 else pivots[0]
    along = np.argsort(pivots @ direction, kind="stable")
    group, number, held = np.zeros(len(pivots), int), 0, 0
    for lo in range(0, len(along), CHAINED):
        free = along[lo : lo + CHAINED].tolist()
        at = free.pop(0)
        while True:
            if held and held + counts[at] > block_rows:
                number, held = number + 1, 0
            group[at] = number
            held += counts[at]
            if not free:
                break
            at = free.pop(int(np.argmax(pivots[free] @ pivots[at])))
    return group


def _cells(pivots: np.ndarray, group: np.ndarray, reach: float, outer: np.ndarray | None = None):
    """Add the group of the nearest pivot (home rows) or, given how wide cells are, each group with one in reach.

    ``angle`` is that to the pivot where a group is one cell, else 0.
    """
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.diff(group[order], prepend=-1))
    alone = np.diff(np.append(first, len(order))) == 1

    def assign(batches):
        for pdf in batches:
            pdf = _usable(pdf)
            for n, rows in _by_length(pdf):
                if n != pivots.shape[1]:  # other vector lengths meet in a cell of their own
                    yield rows.assign(cell=-int(n), angle=0.0)
                    continue
                for lo in range(0, len(rows), TILE_ROWS):
                    tile = rows.iloc[lo : lo + TILE_ROWS]
                    angle = np.arccos(np.clip(_unit(tile["vector"]) @ pivots.T, -1.0, 1.0))
                    nearest = angle.min(axis=1)
                    if outer is None:
                        cell = group[angle.argmin(axis=1)]
                        yield tile.assign(cell=cell, angle=np.where(alone[cell], nearest, 0.0))
                    else:
                        # y in cell j has angle(y, p_j) <= angle(y, p_i), hence
                        # angle(x, p_j) - angle(x, p_i) <= 2 * angle(x, y).
                        within = (angle <= nearest[:, None] + 2 * reach) & (angle <= outer[None, :] + reach)
                        row, cell = np.nonzero(np.logical_or.reduceat(within[:, order], first, axis=1))
                        pivot = order[first[cell]]
                        yield tile.iloc[row].assign(cell=cell, angle=np.where(alone[cell], angle[row, pivot], 0.0))

    return assign


def _block_size(n_others: int, block_rows: int) -> int:
    """Rows of a block: ``block_rows``, or more for many others, up to ``BLOCK_ROWS``.

    With blocks that stay small, copies and pivots would grow with the square of the others.
    """
    return max(block_rows, min(BLOCK_ROWS, -(-n_others // MOST_BLOCKS)))


def _sampled(others: DataFrame, n_others: int, n_bytes: int, block_rows: int) -> np.ndarray | None:
    """Pivots: unit vectors of one length, some for each block that the others make, within the bytes to be shipped.

    With more pivots than stories, few cells hold two stories and are wide.
    """
    fitting = int(SHIPPED_BYTES / (2 * max(1.0, n_bytes / n_others)))
    wanted = max(1, min(PIVOTS_A_BLOCK * n_others // block_rows, fitting))
    sample = _usable(others.filter(F.size("vector") > 0).orderBy(F.xxhash64("id"), "id").limit(wanted).toPandas())
    if not len(sample):
        return None
    _, main = max(_by_length(sample), key=lambda kv: (len(kv[1]), kv[0]))
    return _unit(main["vector"])


def _renewed(df: DataFrame) -> DataFrame:
    """The same rows under new column identities, for joins with frames they came from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def placed(
    items: DataFrame, others: DataFrame, n_others: int, pivots: np.ndarray, threshold: float, block_rows: int
) -> tuple[DataFrame, DataFrame]:
    """Items and others with the blocks (cell, shell, a, b) in which they meet.

    Others of one cell, shell and ``a`` are a block; each of them is there once for every ``b``, which items in
    reach of the shell are dealt to. An item is there once for every block of every shell in its reach.
    """
    reach = math.acos(max(-1.0, min(1.0, threshold))) + ANGLE_SLACK
    # Facts about shells are broadcast while there are few enough; vectors, which Spark takes for smaller than they
    # are once they are copied, never are.
    most_shells = len(pivots) + 2 * n_others / block_rows
    facts = "broadcast" if most_shells * SHELL_BYTES <= SHIPPED_BYTES else "merge"
    schema = f"{_VECTOR_SCHEMA}, cell int, angle double"
    near = others.mapInPandas(_nearest(pivots), "cell int, angle double").groupBy("cell")
    outer, counts = np.full(len(pivots), -np.inf), np.zeros(len(pivots), int)
    for r in near.agg(F.max("angle").alias("a"), F.count(F.lit(1)).alias("n")).collect():  # a row a pivot
        outer[r["cell"]], counts[r["cell"]] = r["a"], r["n"]
    group = _grouped(pivots, counts, block_rows)
    home = others.mapInPandas(_cells(pivots, group, reach), schema)
    visits = items.mapInPandas(_cells(pivots, group, reach, outer), schema)

    # Angles that cut a cell into shells of about a block each, from mergeable sketches; a row a cell.
    size = home.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("angle", [i / MOST_SHELLS for i in range(1, MOST_SHELLS)], 1_000).alias("angles"),
    )
    every = F.greatest(F.lit(1), F.floor(F.lit(MOST_SHELLS) / F.ceil(F.col("n") / F.lit(block_rows))).cast("int"))
    cuts = size.withColumn("every", every).select(
        "cell", F.expr(f"array_distinct(filter(angles, (x, i) -> (i + 1) % every = 0 AND n > {int(block_rows)}))").alias("cuts")
    )
    shelled = home.join(cuts.hint(facts), "cell").withColumn("shell", F.size(F.filter("cuts", lambda c: c < F.col("angle")))).drop("cuts")
    shells = shelled.groupBy("cell", "shell").agg(
        F.count(F.lit(1)).alias("n_home"), F.min("angle").alias("inner"), F.max("angle").alias("outer"), F.min("pos").alias("first")
    )
    # y in the shell has inner <= angle(y, pivot) <= outer, and angle(x, y) is at least the difference of their angles.
    may_hold = (F.col("angle") <= F.col("outer") + reach) & (F.col("angle") >= F.col("inner") - reach) | (F.col("cell") < 0)
    shells = _renewed(shells)
    visits = visits.join(shells.hint(facts), "cell").filter(may_hold & (F.col("first") <= F.col("pos")))
    visits = visits.select("id", "pos", "vector", "cell", "shell", "n_home")
    load = _renewed(visits.groupBy("cell", "shell").agg(F.count(F.lit(1)).alias("n_visits")))
    salt = F.xxhash64("id", F.lit(7))

    def blocks(n: str):
        return F.ceil(F.col(n) / F.lit(block_rows)).cast("int")

    shell = ["cell", "shell"]
    placed_home = (
        shelled.join(_renewed(shells.select(*shell, "n_home")).hint(facts), shell)
        .join(_renewed(load).hint(facts), shell)
        .withColumn("a", F.pmod(salt, blocks("n_home")).cast("int"))
        .withColumn("b", F.explode(F.sequence(F.lit(0), blocks("n_visits") - 1)))
        .select(*VECTOR_FIELDS, *shell, "a", "b")
    )
    placed_visits = (
        visits.join(load.hint(facts), shell)
        .withColumn("b", F.pmod(salt, blocks("n_visits")).cast("int"))
        .withColumn("a", F.explode(F.sequence(F.lit(0), blocks("n_home") - 1)))
        .select(*VECTOR_FIELDS, *shell, "a", "b")
    )
    return _renewed(placed_visits), _renewed(placed_home)


BLOCK = ["cell", "shell", "a", "b"]


def match_work(items: DataFrame, others: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(copies, comparisons): vectors of both sides that are sent to blocks, and pairs that meet in them."""
    n_others, n_bytes = _extent(others)
    block_rows = _block_size(n_others, block_rows)
    pivots = _sampled(others, n_others, n_bytes, block_rows)
    left, right = placed(items, others, n_others, pivots, threshold, block_rows)
    sides = [df.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "l"), (right, "r"))]
    met = sides[0].join(sides[1], BLOCK)
    return met.agg(F.sum(F.col("l") + F.col("r")).alias("copies"), F.sum(F.col("l") * F.col("r")).alias("comparisons"))


def _blocked_matches(
    items: DataFrame, others: DataFrame, n_others: int, n_bytes: int, threshold: float, block_rows: int
) -> DataFrame:
    block_rows = _block_size(n_others, block_rows)
    pivots = _sampled(others, n_others, n_bytes, block_rows)
    if pivots is None:
        return items.sparkSession.createDataFrame([], _MATCH_SCHEMA)
    head = _rotation(pivots) if pivots.shape[1] >= LONG else None
    left, right = placed(items, others, n_others, pivots, threshold, block_rows)

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "match_id": [], "similarity": []})
        return _best_in_block(left, _prepared(right), threshold, head)

    per_block = left.groupBy(*BLOCK).cogroup(right.groupBy(*BLOCK)).applyInPandas(match, _MATCH_SCHEMA)
    best = F.max(F.struct("similarity", (-F.col("match_id")).alias("neg")))
    return (
        per_block.groupBy("id")
        .agg(best.alias("m"))
        .select("id", (-F.col("m.neg")).alias("match_id"), F.col("m.similarity").alias("similarity"))
    )


def _extent(others: DataFrame) -> tuple[int, int]:
    """Rows and bytes of a frame of vectors."""
    row = others.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.greatest(F.size("vector"), F.lit(0))), F.lit(0))).first()
    return row[0], 4 * row[1] + 16 * row[0]


def earlier_matches(
    items: DataFrame, others: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(id, match_id, similarity) for items with an earlier vector at ``threshold`` or more.

    Both inputs are ``vector_frame`` rows. Equal similarities go to the smallest ``match_id``.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive: incomparable vectors have similarity 0")
    n_others, n_bytes = _extent(others)
    if n_others <= block_rows and n_bytes <= SHIPPED_BYTES:
        return items.mapInPandas(_against(others.toPandas(), threshold), _MATCH_SCHEMA)
    return _blocked_matches(items, others, n_others, n_bytes, threshold, block_rows)
