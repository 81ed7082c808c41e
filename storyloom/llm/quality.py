"""Quality rules, and an isolation forest over the statistics they count."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import in_batches, pick

SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS))
_NOT_UPPER = bytes(set(range(256)) - set(range(65, 91)))
_NOT_LETTER = bytes(set(range(128)) - set(range(65, 91)) - set(range(97, 123)))
_NOT_MARK = bytes(sorted(set(range(128)) - set(b"!?\"'()[]{}=+_/\\^~@`:;"))) + bytes(range(128, 256))

#: Labelled rows that the forest and its threshold are learned from, at most.
LABELLED = 20_000
TREES, SUBSAMPLE = 100, 256
#: Of these, how many choose the statistics.
SELECTION = 4_000
#: Share of the good labelled rows that the threshold may cost.
GOOD_LOST = 0.002

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_marks", "n_long_words")
FEATURES = ("chars_per_word", "symbols", "dup_lines", "repeats", "upper", "marks", "long_words")


def statistics(text: bytes | None) -> tuple[list[int], int]:
    """``COUNTS`` of a text, and its number of lines that have a word."""
    text = text or b""
    words = text.split()
    n = len(words)
    chars = len(text.decode("utf-8", "replace")) - (len(text) - sum(map(len, words)))
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeats = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:]))  # noqa: B905
        seen = Counter(windows)
        if len(seen) < len(windows):
            twice = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))
            inside = np.zeros(n, bool)
            for shift in range(3):
                inside[shift : shift + len(windows)] |= twice
            repeats = int(inside.sum())
    return [
        n,
        chars,
        len(text.translate(None, _NOT_SYMBOLS)),
        len(lines) - len(set(lines)),
        repeats,
        len(text.translate(None, _NOT_UPPER)),
        len(text.translate(None, _NOT_LETTER)),
        len(text.translate(None, _NOT_MARK)),
        sum(len(w) > 20 for w in words),
    ], len(lines)


def features(counts: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """``FEATURES`` of rows of ``COUNTS``: shares, so that length alone is no anomaly.

    On a log scale, where the step from none to a few hundredths is as wide as that from a few to all.
    """
    c = dict(zip(COUNTS, counts.T.astype(float), strict=True))
    words = np.maximum(c["n_words"], 1)
    shares = np.stack(
        [
            c["word_chars"] / words,
            c["n_symbols"] / words,
            c["n_dup_lines"] / np.maximum(lines, 1),
            c["n_repeat_words"] / words,
            c["n_upper"] / np.maximum(c["n_letters"], 1),
            c["n_marks"] / words,
            c["n_long_words"] / words,
        ],
        axis=1,
    )
    return np.log1p(20 * shares)


def _path(n: np.ndarray | float) -> np.ndarray:
    """Mean length of an unsuccessful search in a random binary tree of n points."""
    n = np.asarray(n, float)
    body = 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, body, np.where(n == 2, 1.0, 0.0))


@dataclass
class Tree:
    """Nodes as arrays. Inner nodes have children; leaves have the path length of a point that ends there."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray

    @classmethod
    def grow(cls, points: np.ndarray, rng: np.random.Generator, low: np.ndarray, high: np.ndarray) -> Tree:
        """Splits are drawn between bounds that start at ``low`` and ``high`` and shrink with each split.

        Bounds and not the points' own extremes, so that room which no point fills is cut off early.
        """
        limit = int(np.ceil(np.log2(max(len(points), 2))))
        nodes: list[list[float]] = []
        todo = [(points, 0, -1, 0, low, high)]
        while todo:
            rows, depth, parent, side, lo, hi = todo.pop()
            at = len(nodes)
            if parent >= 0:
                nodes[parent][2 + side] = at
            wide = np.nonzero(hi > lo)[0]
            if depth >= limit or len(rows) <= 1 or not len(wide):
                nodes.append([-1, 0.0, at, at, depth + float(_path(len(rows)))])
                continue
            f = int(rng.choice(wide))
            cut = float(rng.uniform(lo[f], hi[f]))
            nodes.append([f, cut, -1, -1, 0.0])
            below = rows[:, f] < cut
            left_hi, right_lo = hi.copy(), lo.copy()
            left_hi[f] = right_lo[f] = cut
            todo.append((rows[below], depth + 1, at, 0, lo, left_hi))
            todo.append((rows[~below], depth + 1, at, 1, right_lo, hi))
        table = np.array(nodes)
        return cls(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4])

    def lengths(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), int)
        while True:
            f = self.feature[at]
            inner = np.nonzero(f >= 0)[0]
            if not len(inner):
                return self.length[at]
            here = at[inner]
            below = points[inner, f[inner]] < self.split[here]
            at[inner] = np.where(below, self.left[here], self.right[here])


@dataclass
class Forest:
    trees: list[Tree]
    scale: float
    threshold: float = 1.0
    gain: float = 0.0
    used: tuple[int, ...] = tuple(range(len(FEATURES)))

    @classmethod
    def fit(
        cls,
        points: np.ndarray,
        good: np.ndarray,
        seed: int = 7,
        trees: int = TREES,
        subsample: int = SUBSAMPLE,
        used: tuple[int, ...] | None = None,
    ) -> Forest:
        """Grown on good rows, within the range of all of them; calibrated by both kinds.

        The threshold is the one that separates the labels best among those that lose at most
        ``GOOD_LOST`` of the good rows. With no labelled rows nothing is anomalous.
        """
        used = tuple(range(points.shape[1])) if used is None else used
        rng = np.random.default_rng(seed)
        own = points[:, used]
        normal = own[good]
        if not len(normal):
            return cls([], 1.0, used=used)
        low, high = own.min(axis=0), own.max(axis=0)
        grown = []
        for _ in range(trees):
            some = rng.choice(len(normal), min(subsample, len(normal)), replace=False)
            grown.append(Tree.grow(normal[some], rng, low, high))
        out = cls(grown, max(float(_path(min(subsample, len(normal)))), 1e-9), used=used)
        scores = out.scores(points)
        allowed = np.sort(scores[good])[::-1][int(GOOD_LOST * good.sum())]
        cuts = np.unique(scores[scores >= allowed])
        out.threshold = float(allowed)
        if (~good).any():
            lost = 1 - np.searchsorted(np.sort(scores[good]), cuts, "right") / good.sum()
            caught = 1 - np.searchsorted(np.sort(scores[~good]), cuts, "right") / (~good).sum()
            best = int(np.argmax(caught - lost))
            out.threshold, out.gain = float(cuts[best]), float(caught[best] - lost[best])
        return out

    @classmethod
    def choose(cls, points: np.ndarray, good: np.ndarray, seed: int = 7) -> Forest:
        """``fit`` on the statistics that help: one is left out at a time while the labels separate better."""
        some = slice(0, SELECTION)
        trial = lambda used: cls.fit(points[some], good[some], seed, TREES // 2, SUBSAMPLE, used)
        now = trial(tuple(range(points.shape[1])))
        while len(now.used) > 1:
            fewer = [trial(tuple(u for u in now.used if u != out)) for out in now.used]
            best = max(fewer, key=lambda f: f.gain)
            if best.gain <= now.gain:
                break
            now = best
        return cls.fit(points, good, seed, used=now.used)

    def scores(self, points: np.ndarray) -> np.ndarray:
        """2 to the power of minus the mean path length over the expected one: near 1 for anomalies."""
        if not self.trees:
            return np.zeros(len(points))
        own = points[:, self.used]
        total = sum(tree.lengths(own) for tree in self.trees)
        return np.exp2(-total / len(self.trees) / self.scale)


def labelled_sample(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, bound: int) -> tuple[np.ndarray, ...]:
    """Statistics of at most ``bound`` labelled rows, those first in the order of a hash of their id."""
    chosen = (
        pick(labels, "doc_id", "quality")
        .filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(bound)
    )
    body = pick(docs, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    # At most ``bound`` ids, a few hundred kB.
    met = body.join(F.broadcast(chosen.withColumnRenamed("doc_id", "id")), "id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([f[0][i] for f in found], pa.int64()) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("quality"), *columns, pa.array([f[1] for f in found], pa.int64())],
                ["id", "quality", *COUNTS, "lines"],
            )

    schema = "id long, quality int, " + ", ".join(f"{c} long" for c in COUNTS) + ", lines long"
    source = met.select("id", F.col("quality").cast("int"), F.col("text").cast("binary").alias("text"))
    # Copies of a labelled row may be many: the bound holds for rows as well as for ids.
    rows = in_batches(source, work, schema).orderBy(F.xxhash64("id"), "id", *COUNTS).limit(bound).toPandas()
    return rows[list(COUNTS)].to_numpy(), rows["lines"].to_numpy(), rows["quality"].to_numpy() == 1


def fit(
    docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", bound: int = LABELLED, seed: int = 7
) -> Forest:
    """A forest from ``labels`` (doc_id, quality) met with ``docs``: rows that pass the base rules only."""
    counts, lines, good = labelled_sample(docs, labels, text_col, id_col, bound)
    passing = ~_base_failed(counts)
    return Forest.choose(features(counts[passing], lines[passing]), good[passing], seed)


def _base_failed(counts: np.ndarray) -> np.ndarray:
    words, repeats = counts[:, COUNTS.index("n_words")], counts[:, COUNTS.index("n_repeat_words")]
    return (words < 50) | (100 * repeats > 50 * words)


ADDED = (*COUNTS[:5], "base_failed", "anomaly", "kept")


def judge(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed (under 50 words, or over half of the words in repeated windows of three), anomaly (0 to 1)
    and kept: not base_failed, and an anomaly at most the forest's threshold.

    Nulls: a null text has no words and fails. Columns named like the added ones are replaced. Repeated
    rows get equal verdicts. Long texts are read whole, row by row; an empty table gives no rows. One pass,
    no shuffle.
    """
    named = docs.drop(*ADDED)
    columns = named.columns
    places = [f"c{i}" for i in range(len(columns))]
    source = named.toDF(*places).withColumn("_text", F.col(places[columns.index(text_col)]).cast("string").cast("binary"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        model = forest  # at most trees x 2 x subsample nodes
        for batch in batches:
            found = [statistics(t) for t in batch.column("_text").to_pylist()]
            counts = np.array([f[0] for f in found], np.int64).reshape(-1, len(COUNTS))
            failed = _base_failed(counts)
            scores = model.scores(features(counts, np.array([f[1] for f in found])))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in places],
                    *[pa.array(counts[:, i]) for i in range(5)],
                    pa.array(failed),
                    pa.array(scores),
                    pa.array(~failed & (scores <= model.threshold)),
                ],
                [*places, *ADDED],
            )

    kinds = [*[f"{c} {t}" for c, (_, t) in zip(places, named.dtypes, strict=True)], *[f"{c} long" for c in COUNTS[:5]]]
    schema = ", ".join([*kinds, "base_failed boolean", "anomaly double", "kept boolean"])
    return in_batches(source, work, schema).toDF(*columns, *ADDED)


