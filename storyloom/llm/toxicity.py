"""Toxicity by compression distance: which of two trained dictionaries shortens a window more."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import in_batches, pick, texts, written

#: Labelled rows that are learned from, at most, and what is taken from them.
LABELLED = 12_000
CANDIDATES = 20_000
WINDOWS_PER_TEXT = 3
#: One in so many labelled rows calibrates and is kept out of the dictionaries.
CALIBRATION = 3
WINDOW_WORDS = 16
#: A word is typical of toxic text in so many different surroundings, and at this log odds against ordinary text.
LEAST_SURROUNDINGS, LEAST_SHARE, LEAST_ODDS = 3, 0.012, 2.5
ORDINARY_BYTES, TOXIC_BYTES = 32_768, 16_384
#: Gains below this many bytes are what any two dictionaries differ by.
NOISE = 8
#: The score from which a text counts as toxic.
CUT = 0.3


_LETTERS = np.random.default_rng(42).integers(0, 2**32, (64, 256), np.uint32)


def stretch(text: bytes) -> bytes:
    """Each byte followed by two more that stand for its word up to and with it. Blanks part words.

    What a match saves grows with its length while what it costs stays. In plain text a word of five
    letters costs as much as a match as it saves; three times as long, it clearly pays. And a word only
    matches words that begin alike, not those that happen to hold the same syllables further in.
    """
    a = np.frombuffer(text, np.uint8)
    at = np.arange(len(a))
    start = np.maximum.accumulate(np.where(a == 32, at, 0))
    total = np.cumsum(_LETTERS[np.minimum(at - start, 63), a], dtype=np.uint32)
    mixed = total - total[start]
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(2654435761)
    parts = (a, (mixed >> np.uint32(24)).astype(np.uint8), (mixed >> np.uint32(16)).astype(np.uint8))
    return np.stack(parts, axis=1).tobytes()


def windows(text: bytes | None) -> list[bytes]:
    """The whole text as stretched windows of ``WINDOW_WORDS`` words, in lower case, one blank between words."""
    words = (text or b"").decode("utf-8", "replace").lower().encode().split()
    if not words:
        return []
    held = stretch(b" " + b" ".join(words) + b" ")
    ends = np.cumsum([len(w) + 1 for w in words])[WINDOW_WORDS - 1 : -1 : WINDOW_WORDS].tolist()
    cuts = [0, *ends, len(held) // 3 - 1]
    return [held[3 * a : 3 * b + 3] for a, b in zip(cuts, cuts[1:], strict=False)]


def _compressor(content: bytes) -> zs.ZstdCompressor:
    params = zs.ZstdCompressionParameters(
        window_log=17, hash_log=15, chain_log=15, search_log=4, min_match=6, target_length=64,
        strategy=zs.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0,
        format=zs.FORMAT_ZSTD1_MAGICLESS,
    )
    held = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zs.ZstdCompressor(dict_data=held, compression_params=params)


def _trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on samples, with as many of them as there is room for behind it.

    The trainer takes long frequent stretches and leaves out single short samples, however typical; the
    most frequent samples come last, where they win against what the trainer chose. Too few samples to
    train on are taken as they are.
    """
    own = b"".join(s for s, _ in reversed(Counter(samples).most_common()))[-size // 2 :]
    try:
        return zs.train_dictionary(size, samples, k=200, d=8).as_bytes()[len(own) - size :] + own
    except zs.ZstdError:
        return own


def _features(gains: np.ndarray) -> list[float]:
    best = np.sort(gains)[::-1]
    clear = float(gains[gains >= NOISE].sum())
    n = max(len(gains), 1)
    first = [float(best[i]) if i < len(best) else 0.0 for i in range(3)]
    return [*first, clear / n**0.5, np.log1p(clear), clear / n, np.log1p(n)]


N_FEATURES = 7


@dataclass
class Model:
    """Two dictionaries and a logistic curve over the gains of a text's windows.

    The toxic dictionary holds the ordinary one behind its own content, so that on ordinary text both
    compress alike and only what is typical of toxic text makes a difference.
    """

    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def measure(self, documents: Iterable[bytes | None]) -> np.ndarray:
        """Features of each document, over all of its windows."""
        toxic, ordinary = _compressor(self.toxic + self.ordinary), _compressor(self.ordinary)
        rows = []
        for text in documents:
            gains = [len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows(text)]
            rows.append(_features(np.array(gains, float)))
        return np.array(rows).reshape(-1, N_FEATURES)

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[1:] + self.weights[0], -30, 30)))

    def calibrate(self, features: np.ndarray, toxic: np.ndarray) -> None:
        """Logistic regression, shifted so that the cut which serves both labels best is at ``CUT``."""
        if not toxic.any() or toxic.all():
            self.weights = np.zeros(N_FEATURES + 1)
            self.weights[0] = 4.0 if len(toxic) and toxic.all() else -4.0
            return
        self.mean, self.scale = features.mean(axis=0), np.maximum(features.std(axis=0), 1e-6)
        x = np.column_stack([np.ones(len(features)), (features - self.mean) / self.scale])
        w, ridge = np.zeros(x.shape[1]), np.diag([1e-6, *[1.0] * N_FEATURES])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (toxic - p) - ridge @ w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        z = x @ w
        order = np.sort(z)
        cuts = (order[1:] + order[:-1]) / 2
        caught = toxic.sum() - np.searchsorted(np.sort(z[toxic]), cuts)
        wrong = (~toxic).sum() - np.searchsorted(np.sort(z[~toxic]), cuts)
        f1 = 2 * caught / np.maximum(caught + wrong + toxic.sum(), 1)
        best = cuts[f1 >= f1.max() - 1e-9]
        w[0] += np.log(CUT / (1 - CUT)) - float(np.mean([best.min(), best.max()]))
        self.weights = w


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    bound: int = LABELLED,
) -> Model:
    """Learn from at most ``bound`` labelled rows of ``labels`` (doc_id, toxic) met with ``docs``.

    The rows are those first in the order of a hash of their id; held-out rows must not be in ``labels``.
    A third of them calibrates. From the others, words that stand in many different surroundings in toxic
    texts and hardly occur in ordinary ones become the samples of the toxic dictionary, each as often as
    it has surroundings (one a text), so that copies of one text count once. Windows of ordinary texts are the samples
    of the other. Only words, windows and features come to the driver, each bounded by ``bound``.
    """
    chosen = (
        pick(labels, "doc_id", "toxic")
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .select(F.col("doc_id").cast("long").alias("_id"), (F.col("toxic") == 1).alias("toxic"))
        .orderBy(F.xxhash64("_id"), "_id", "toxic")
        .limit(bound)
    )
    # At most ``bound`` ids, a few hundred kB.
    met = texts(docs, id_col, text_col).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = met.select(
        (F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(CALIBRATION)) == 0).alias("calibrates"),
        "toxic",
        F.col("text").cast("binary").alias("text"),
        F.xxhash64("doc_id", "text").alias("at"),
    )
    rows = written(rows.orderBy("at").limit(bound).repartition(8), "toxicity-labelled")
    teach = rows.filter(~F.col("calibrates"))
    words = teach.filter("toxic").select("text")

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                own = (text or b"").decode("utf-8", "replace").lower().encode().split()
                pairs = dict(zip(own, [b"", *own], strict=False))  # one surrounding a text and word
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs.keys(), pa.binary()), pa.array(pairs.values(), pa.binary())], ["word", "before"]
                )

    n_toxic = words.count()
    n_ordinary = teach.count() - n_toxic
    candidates = (
        in_batches(words, surroundings, "word binary, before binary")
        .groupBy("word", "before")
        .agg(F.count(F.lit(1)).alias("texts"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("texts").alias("texts"))
        .filter(F.col("n") >= max(LEAST_SURROUNDINGS, LEAST_SHARE * n_toxic))
        .orderBy(F.desc_nulls_last("n"), "word")
        .limit(CANDIDATES)
        .collect()
    )
    seen = {bytes(r["word"]): (r["n"], r["texts"]) for r in candidates}
    found = _ordinary(teach.filter(~F.col("toxic")), frozenset(seen))
    usual = {bytes(r["item"]): r["n"] for r in found if r["kind"] == 0}
    plain = [bytes(r["item"]) for r in found if r["kind"] == 1]
    odds = {
        w: np.log((n + 0.5) / (n_toxic + 1)) - np.log((usual.get(w, 0) + 0.5) / (n_ordinary + 1))
        for w, (_, n) in sorted(seen.items())
    }
    typical = [
        stretch(b" " + w + b" ") for w, (n, _) in sorted(seen.items()) if odds[w] >= LEAST_ODDS for _ in range(n)
    ]
    model = Model(
        _trained(typical, TOXIC_BYTES),
        _trained(sorted(plain), ORDINARY_BYTES),
        np.zeros(N_FEATURES + 1),
        np.zeros(N_FEATURES),
        np.ones(N_FEATURES),
    )
    if not typical:
        model.calibrate(np.zeros((0, N_FEATURES)), np.zeros(0, bool))
        return model
    measured = _measured(rows.filter("calibrates"), model).toPandas()
    features = np.array(measured["features"].tolist(), float).reshape(-1, N_FEATURES)
    model.calibrate(features, measured["toxic"].to_numpy(bool))
    return model


def _ordinary(rows: DataFrame, candidates: frozenset[bytes]) -> list:
    """Documents of each candidate word (kind 0), and sample windows, at most three a text (kind 1)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[bytes] = Counter()
            plain: list[bytes] = []
            for text, at in zip(batch.column("text").to_pylist(), batch.column("at").to_pylist(), strict=True):
                own = (text or b"").decode("utf-8", "replace").lower().encode().split()
                counts.update(candidates.intersection(own))
                held = windows(text)
                plain.extend(held[(at + i * len(held) // WINDOWS_PER_TEXT) % len(held)] for i in range(min(WINDOWS_PER_TEXT, len(held))))
            items = [*counts, *plain]
            kinds = [0] * len(counts) + [1] * len(plain)
            n = [*counts.values(), *[1] * len(plain)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.int32()), pa.array(items, pa.binary()), pa.array(n, pa.int64())], ["kind", "item", "n"]
            )

    found = in_batches(rows.select("text", "at"), work, "kind int, item binary, n long")
    return found.groupBy("kind", "item").agg(F.sum("n").alias("n")).collect()


def _measured(rows: DataFrame, model: Model) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            found = model.measure(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(found.tolist(), pa.list_(pa.float64()))], ["toxic", "features"]
            )

    return in_batches(rows.select("toxic", "text"), work, "toxic boolean, features array<double>")


def score(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, score, predicted): 0 to 1, higher for likelier toxic, and 1 from ``CUT`` on.

    Whole texts are read, window by window. Nulls: a null or empty text has no windows and gets the score
    of no gain, which is low; a null id stays null. Repeated rows get equal scores. An empty table gives no
    rows. With no toxic labelled row every score is low. Other columns are not read. One pass, no shuffle.
    """
    source = texts(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(model.measure(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores), pa.array((scores >= CUT).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

    return in_batches(source, work, "doc_id long, score double, predicted int")
