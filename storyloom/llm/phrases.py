"""Collocations from FM-indexes over word ids, one for each shard of the corpus."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import in_batches, numbered, pick, remove, written

#: A shard ends with the first text beyond so many words, so what a task makes of it takes some 100 MB.
SHARD_WORDS = 1_500_000
#: Bytes of a text that are cut into words at a time.
CHUNK_BYTES = 1024 * 1024
#: Words of the corpus for each bucket of phrases, whose counts are summed together.
BUCKET_WORDS = 4_000_000
#: Parts of a language that are ranked each on its own first.
RANKED_PARTS = 32
#: Suffixes are ordered by so many words; phrases are not longer.
MOST_WORDS = 4

# Small letters, blanks, and one byte that no text holds for what ends a piece.
_END = 0xFF
_TABLE = bytearray(bytes(range(256)).lower())
_TABLE[0x09] = 0x20
for _mark in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_mark] = _END
_TABLE = bytes(_TABLE)

SHARD = (
    "shard long, seq binary, wide boolean, words array<string>, langs array<string>, counts array<int>, "
    "sizes map<string, bigint>"
)
INDEX = "shard long, gids binary, bwt binary, back binary"


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(values).tobytes())


def _unpacked(blob: pa.Scalar, dtype: str | np.dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_buffer()), dtype)


# --- shards -------------------------------------------------------------------------------------


class _Words(dict):
    """Ids of one language's words in a shard, given as they come."""

    def __init__(self, shard: _Shard, lang: str) -> None:
        self.shard, self.lang = shard, lang
        self[bytes([_END])] = 0

    def __missing__(self, word: bytes) -> int:
        self.shard.words.append(word)
        self.shard.langs.append(self.lang)
        self[word] = len(self.shard.words)
        return self[word]


class _Shard:
    """Word ids of consecutive texts, 0 between pieces. The same word of two languages has two ids."""

    def __init__(self) -> None:
        self.words: list[bytes] = []
        self.langs: list[str] = []
        self.ids: dict[str, _Words] = {}
        self.parts: list[np.ndarray] = []
        self.sizes: dict[str, int] = {}
        self.n = 0

    def add(self, lang: str, text: bytes) -> None:
        ids = self.ids.setdefault(lang, _Words(self, lang))
        text = text.translate(_TABLE)
        at = 0
        while at < len(text):
            end = text.find(b" ", at + CHUNK_BYTES)
            end = len(text) if end < 0 else end
            found = text[at:end].replace(b"\xff", b" \xff ").split()
            part = np.fromiter(map(ids.__getitem__, found), np.uint32, len(found))
            self.parts.append(part)
            self.sizes[lang] = self.sizes.get(lang, 0) + int(np.count_nonzero(part))
            self.n += len(found)
            at = end
        self.parts.append(np.zeros(1, np.uint32))

    def row(self, number: int) -> pa.RecordBatch:
        seq = np.concatenate(self.parts)
        counts = np.bincount(seq, minlength=len(self.words) + 1)[1:]
        wide = len(self.words) > 0xFFFF
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.array([_packed(seq.astype("<u4" if wide else "<u2"))], pa.binary()),
                pa.array([wide]),
                pa.array([[w.decode() for w in self.words]], pa.list_(pa.string())),
                pa.array([self.langs], pa.list_(pa.string())),
                pa.array([counts], pa.list_(pa.int32())),
                pa.array([list(self.sizes.items())], pa.map_(pa.string(), pa.int64())),
            ],
            ["shard", "seq", "wide", "words", "langs", "counts", "sizes"],
        )


def shards(docs: DataFrame, shard_words: int) -> DataFrame:
    """``SHARD`` rows of (lang, text): word ids of consecutive rows of a partition, and their words and counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        shard = _Shard()
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang, text in zip(langs, batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                shard.add(lang, text)
                if shard.n >= shard_words:
                    yield shard.row(number)
                    number, shard = number + 1, _Shard()
        if shard.n:
            yield shard.row(number)

    return in_batches(docs, work, SHARD)


# --- one index ----------------------------------------------------------------------------------


def _ranks(keys: np.ndarray) -> np.ndarray:
    """The place of each key among the distinct ones."""
    order = np.argsort(keys, kind="stable")
    ranks = np.empty(len(keys), np.int32)
    ranks[order] = np.cumsum(np.diff(keys[order], prepend=keys[order[:1]]) != 0, dtype=np.int32)
    return ranks


def _suffixes(s: np.ndarray) -> np.ndarray:
    """Places of ``s`` in the order of the ``MOST_WORDS`` symbols from there on."""
    ranks, ahead = s, 1
    while ahead < MOST_WORDS:
        keys = ranks.astype(np.int64) * (int(ranks.max(initial=0)) + 1)
        keys[:-ahead] += ranks[ahead:]
        ranks, ahead = _ranks(keys), ahead * 2
        del keys
    return np.argsort(ranks, kind="stable")


@dataclass
class Intervals:
    """Phrases (one column of ``words`` each, as symbols), where their suffixes lie in both indexes, and how many."""

    words: np.ndarray
    lo: np.ndarray
    back_lo: np.ndarray
    n: np.ndarray

    def where(self, keep: np.ndarray) -> Intervals:
        return Intervals(self.words[:, keep], self.lo[keep], self.back_lo[keep], self.n[keep])


class FMIndex:
    """The last symbols before all suffixes of a text, and before those of the text read backwards.

    Symbol 0 stands between pieces. Suffixes are in the order of their first ``MOST_WORDS`` symbols, which is
    all that the intervals of phrases of that length depend on.
    """

    def __init__(self, bwt: np.ndarray, back: np.ndarray) -> None:
        self.bwt, self.back = bwt, back
        self.steps, self.back_steps = self._steps(bwt), self._steps(back)

    @classmethod
    def of(cls, s: np.ndarray) -> FMIndex:
        """Of a text that begins and ends with 0."""
        return cls(s[_suffixes(s) - 1], s[::-1][_suffixes(s[::-1]) - 1])

    @staticmethod
    def _steps(bwt: np.ndarray) -> np.ndarray:
        """Where the suffix that begins with the symbol before a suffix lies: smaller symbols and earlier equal ones."""
        steps = np.empty(len(bwt), np.int32)
        steps[np.argsort(bwt, kind="stable")] = np.arange(len(bwt), dtype=np.int32)
        return steps

    def single(self) -> Intervals:
        """All words."""
        counts = np.bincount(self.bwt)
        lo = np.cumsum(counts) - counts
        words = np.flatnonzero(counts[1:]) + 1
        return Intervals(words[None, :], lo[words], lo[words], counts[words])

    def left(self, held: Intervals) -> Intervals:
        """Every word before every phrase of ``held``, with the counts of the longer phrases."""
        owner, symbol, lo, inside, n = self._extend(held.lo, held.n, self.bwt, self.steps)
        words = np.concatenate([symbol[None, :], held.words[:, owner]])
        return Intervals(words, lo, held.back_lo[owner] + inside, n)

    def right(self, held: Intervals) -> Intervals:
        """Every word behind every phrase of ``held``, with the counts of the longer phrases."""
        owner, symbol, back_lo, inside, n = self._extend(held.back_lo, held.n, self.back, self.back_steps)
        words = np.concatenate([held.words[:, owner], symbol[None, :]])
        return Intervals(words, held.lo[owner] + inside, back_lo, n)

    @staticmethod
    def _extend(lo: np.ndarray, n: np.ndarray, bwt: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, ...]:
        """(interval, symbol, its new start, symbols of the interval that are smaller, count) of every extension.

        The smaller symbols tell where the extension lies inside the other index's interval.
        """
        ends = np.cumsum(n)
        total, begins = int(ends[-1]) if len(ends) else 0, ends - n
        place = np.arange(total, dtype=np.int32)
        place += np.repeat((lo - begins).astype(np.int32), n)
        keys = np.repeat(np.arange(len(n)) * (int(bwt.max(initial=0)) + 1), n)
        keys += bwt[place]
        order = np.argsort(keys, kind="stable").astype(np.int32)
        keys = keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        del keys
        count = np.diff(np.append(first, total))
        at = place[order[first]]
        of, symbol = np.searchsorted(ends, first, side="right"), bwt[at].astype(np.int64)
        found = symbol > 0
        return of[found], symbol[found], steps[at[found]].astype(np.int64), (first - begins[of])[found], count[found]


# --- jobs ---------------------------------------------------------------------------------------


def _indexes(held: DataFrame) -> DataFrame:
    """``INDEX`` rows of (shard, seq, wide, found): words that are not found end pieces.

    ``found`` holds a word's id in the shard in its upper half, and its id in the corpus.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                seq = _unpacked(batch.column("seq")[i], "<u4" if batch.column("wide")[i].as_py() else "<u2")
                found = batch.column("found")[i].values.to_numpy()
                local, gid = found >> 32, found & 0xFFFFFFFF
                gids = np.sort(gid)
                symbols = np.zeros(int(max(seq.max(initial=0), local.max())) + 1, np.min_scalar_type(len(gids)))
                symbols[local] = np.searchsorted(gids, gid) + 1
                s = symbols[np.concatenate([[0], seq, [0]])]
                index = FMIndex.of(s[(s != 0) | (np.append(s[1:], 1) != 0)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("shard")[i : i + 1].cast(pa.int64()),
                        *[pa.array([_packed(x)], pa.binary()) for x in (gids.astype("<i8"), index.bwt, index.back)],
                    ],
                    ["shard", "gids", "bwt", "back"],
                )

    return in_batches(held, work, INDEX)


def _loaded(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, FMIndex]:
    gids = _unpacked(batch.column("gids")[i], "<i8")
    kind = np.min_scalar_type(len(gids))
    return gids, FMIndex(*[_unpacked(batch.column(c)[i], kind) for c in ("bwt", "back")])


def _keys(gids: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``k1`` and ``k2`` of phrases given as symbols: two words in each, the first in its upper half, absent ones 0."""
    ids = np.zeros((MOST_WORDS, words.shape[1]), np.int64)
    ids[: len(words)] = gids[words - 1]
    return ids[0] << 32 | ids[1], ids[2] << 32 | ids[3]


#: Counts that a shard sends to one bucket: keys sorted, the first as differences, all compressed.
SENT = "bucket long, shard long, k1 binary, k2 binary, n binary"


def _sent(shard: int, k1: np.ndarray, k2: np.ndarray, n: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A shard's counts, dealt to buckets by the hash of their keys."""
    # Multiplying by an odd number spreads the low bits over the upper ones.
    mixed = (k1.astype(np.uint64) ^ k2.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)
    bucket = ((mixed >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((k2, k1, bucket))
    k1, k2, n, bucket = k1[order], k2[order], n[order].astype("<u4"), bucket[order]
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    parts = [slice(a, b) for a, b in zip(first, np.append(first, len(k1))[1:])]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[first]),
            pa.array(np.full(len(first), shard, np.int64)),
            pa.array([_packed(np.diff(k1[p], prepend=0)) for p in parts], pa.binary()),
            pa.array([_packed(k2[p]) for p in parts], pa.binary()),
            pa.array([_packed(n[p]) for p in parts], pa.binary()),
        ],
        ["bucket", "shard", "k1", "k2", "n"],
    )


def _totals(group: pa.Table, min_count: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(first keys that each shard sent, keys and counts of what is frequent) of one bucket."""
    mine = [np.cumsum(_unpacked(x, "<i8")) for x in group.column("k1")]
    k1, k2 = np.concatenate(mine), np.concatenate([_unpacked(x, "<i8") for x in group.column("k2")])
    n = np.concatenate([_unpacked(x, "<u4") for x in group.column("n")]).astype(np.int64)
    order = np.lexsort((k2, k1))
    k1, k2 = k1[order], k2[order]
    first = np.flatnonzero((np.diff(k1, prepend=-1) != 0) | (np.diff(k2, prepend=-1) != 0))
    total = np.add.reduceat(n[order], first)
    keep = first[total >= min_count]
    return mine, k1[keep], k2[keep], total[total >= min_count]


def _pairs(index: DataFrame, buckets: int, min_count: int) -> DataFrame:
    """Stored (shard, k1, n): frequent phrases of two words, with a null shard, and which of them each shard has.

    There are as many buckets as the corpus is large, so one is summed in a task, which also tells the shards
    what was found.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                gids, fm = _loaded(batch, i)
                found = fm.left(fm.single())
                (k1, k2), n = _keys(gids, found.words), found.n
                del fm, found
                yield _sent(batch.column("shard")[i].as_py(), k1, k2, n, buckets)

    def total(group: pa.Table) -> pa.Table:
        sent, keys, _, n = _totals(group, min_count)
        mine = [keys[np.isin(keys, k, assume_unique=True)] for k in sent]
        rows = [(s, k) for s, k in zip(group.column("shard").to_pylist(), mine, strict=True) if len(k)]
        return pa.table(
            {
                "shard": pa.array([None, *[s for s, _ in rows]], pa.int64()),
                "k1": pa.array([_packed(np.diff(k, prepend=0)) for k in (keys, *[k for _, k in rows])], pa.binary()),
                "n": pa.array([_packed(n), *[None for _ in rows]], pa.binary()),
            }
        )

    found = in_batches(index, count, SENT).groupBy("bucket").applyInArrow(total, "shard long, k1 binary, n binary")
    return written(found, "phrase-pairs")


def _listed(totals: DataFrame) -> DataFrame:
    """(k1, f) of compressed (k1, n)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("k1"), batch.column("n"), strict=True):
                arrays = [pa.array(np.cumsum(_unpacked(keys, "<i8"))), pa.array(_unpacked(counts, "<i8"))]
                yield pa.RecordBatch.from_arrays(arrays, ["k1", "f"])

    return in_batches(totals, work, "k1 long, f long")


def _longer(held: DataFrame, buckets: int, min_count: int) -> DataFrame:
    """(k1, k2, f) of frequent phrases of three and four words all whose pairs are among the shard's ``pairs``.

    Pairs grow by a word to the left, and what is found by one to the right.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                gids, fm = _loaded(batch, i)
                pairs = np.sort(np.concatenate([np.cumsum(_unpacked(k, "<i8")) for k in batch.column("pairs")[i].values]))

                def frequent(words: np.ndarray, gids=gids, pairs=pairs) -> np.ndarray:
                    keys = _keys(gids, words)[0]
                    at = np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)
                    return pairs[at] == keys

                two = fm.left(fm.single())
                three = fm.left(two.where(frequent(two.words)))
                three = three.where(frequent(three.words[:2]))
                four = fm.right(three)
                four = four.where(frequent(four.words[2:]))
                for found in (three, four):
                    if len(found.n):
                        yield _sent(batch.column("shard")[i].as_py(), *_keys(gids, found.words), found.n, buckets)

    def total(group: pa.Table) -> pa.Table:
        _, k1, k2, n = _totals(group, min_count)
        return pa.table({"k1": pa.array(k1), "k2": pa.array(k2), "f": pa.array(n)})

    return in_batches(held, count, SENT).groupBy("bucket").applyInArrow(total, "k1 long, k2 long, f long")


def _key(ids: list[Column]) -> tuple[Column, Column]:
    zero = F.lit(0).cast("long")
    a, b, c, d = [*ids, *[zero] * (MOST_WORDS - len(ids))]
    return F.shiftleft(a, 32).bitwiseOR(b), F.shiftleft(c, 32).bitwiseOR(d)


def _ids() -> list[Column]:
    low = F.lit(0xFFFFFFFF)
    return [c for k in ("k1", "k2") for c in (F.shiftright(k, 32), F.col(k).bitwiseAND(low))]


def frequent_phrases(
    docs: DataFrame, min_count: int, text_col: str = "text", lang_col: str = "lang", shard_words: int = SHARD_WORDS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored tables: words (gid, lang, word, f), phrases (k1, k2, f) of one to four words, and sizes (lang, n).

    All with ``min_count`` occurrences or more, but sizes, which count every word. Only phrases whose words, and
    then whose pairs of words, are frequent in the whole corpus can be; a shard looks for no others.
    """
    rows = pick(docs, lang_col, text_col).select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    held = written(shards(rows, shard_words), "phrase-shards")
    sizes = held.select(F.explode("sizes").alias("lang", "n")).groupBy("lang").agg(F.sum("n").alias("n"))
    sizes = written(sizes, "language-sizes")
    entries = held.select("shard", F.posexplode(F.arrays_zip("words", "langs", "counts")).alias("local", "w")).select(
        "shard", (F.col("local") + 1).cast("long").alias("local"), F.col("w.langs").alias("lang"), F.col("w.words").alias("word"), F.col("w.counts").alias("n")
    )
    counted = entries.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count)
    words = written(numbered(written(counted, "phrase-words"), "gid").withColumn("gid", F.col("gid") + 1), "phrase-word-ids")
    known = entries.select("shard", "local", "lang", "word").join(words.select("lang", "word", "gid"), ["lang", "word"])
    # As many as a shard has words.
    found = known.groupBy("shard").agg(F.collect_list(F.shiftleft("local", 32).bitwiseOR(F.col("gid"))).alias("found"))
    index = written(_indexes(held.select("shard", "seq", "wide").join(found, "shard")), "phrase-index")
    remove(held)
    buckets = max(1, (words.agg(F.sum("f")).first()[0] or 0) // BUCKET_WORDS)
    pairs = _pairs(index, buckets, min_count)
    # One part for each bucket.
    here = pairs.filter("shard IS NOT NULL").groupBy("shard").agg(F.collect_list("k1").alias("pairs"))
    longer = _longer(index.join(here, "shard"), buckets, min_count)
    none = F.lit(0).cast("long").alias("k2")
    single = words.select(F.shiftleft("gid", 32).alias("k1"), none, "f")
    double = _listed(pairs.filter("shard IS NULL").select("k1", "n")).select("k1", none, "f")
    phrases = written(single.unionByName(double).unionByName(longer), "phrases")
    remove(index)
    return words, phrases, sizes


def collocations(
    docs: DataFrame,
    min_count: int = 30,
    contained_percent: int = 80,
    scale: int = 2_000_000,
    top: int = 2000,
    text_col: str = "text",
    lang_col: str = "lang",
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of two to four words of each language.

    A phrase that occurs ``a`` times is cut in two, which occur ``l`` and ``r`` times: its score is the least
    ``scale * a / (l + r)`` over its cuts, rounded down; of equal ones the first cut counts. Phrases inside a longer
    one that has ``contained_percent`` of their occurrences or more are left out.

    Nulls: a null text is empty and a null language is ``und``. Repeated rows count as often as they occur. Long
    texts are cut into words whole, some MB at a time. Ties go to the more frequent phrase, then to the first by its
    bytes. An empty table, or one of blanks and marks, gives no rows; other columns are not read.
    """
    words, phrases, sizes = frequent_phrases(docs, min_count, text_col, lang_col, shard_words)
    g = _ids()
    length = F.lit(1) + sum(((x > 0).cast("int") for x in g[1:]), F.lit(0))
    several = phrases.withColumn("words", length).filter("words > 1").withColumnRenamed("f", "a")

    def part(start: int, end: int, **more: Column) -> Column:
        k1, k2 = _key(g[start:end])
        return F.struct(k1.alias("p1"), k2.alias("p2"), *[c.alias(name) for name, c in more.items()])

    def choose(by_length: dict[int, list[Column]]) -> Column:
        cases = F.lit(None)
        for size, parts in by_length.items():
            cases = F.when(F.col("words") == size, F.array(*parts)).otherwise(cases)
        return F.explode(cases)

    insides = {
        size: [part(s, s + k) for k in range(2, size) for s in range(size - k + 1)] for size in range(3, MOST_WORDS + 1)
    }
    longest = (
        several.filter("words > 2").select("a", choose(insides).alias("p")).groupBy("p.p1", "p.p2").agg(F.max("a").alias("_longer"))
    )
    free = several.join(longest.withColumnsRenamed({"p1": "k1", "p2": "k2"}), ["k1", "k2"], "left").filter(
        F.col("_longer").isNull()
        | (F.col("_longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * contained_percent)
    )
    halves = {
        size: [
            part(*span, cut=F.lit(cut), side=F.lit(side))
            for cut in range(1, size)
            for side, span in (("l", (0, cut)), ("r", (cut, size)))
        ]
        for size in range(2, MOST_WORDS + 1)
    }
    parts = free.select("k1", "k2", "a", choose(halves).alias("p")).select("k1", "k2", "a", "p.*")
    counted = parts.join(phrases.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), "f"), ["p1", "p2"])

    def half(cut: int, side: str) -> Column:
        return F.max(F.when((F.col("cut") == cut) & (F.col("side") == side), F.col("f")))

    # At most six rows a phrase.
    sums = counted.groupBy("k1", "k2", "a").agg(
        *[half(cut, side).alias(f"{side}{cut}") for cut in range(1, MOST_WORDS) for side in "lr"]
    )

    def cut_score(cut: int) -> Column:
        score = F.expr(f"(cast(a as decimal(20,0)) * {scale}) div (cast(l{cut} as decimal(20,0)) + cast(r{cut} as decimal(20,0)))")
        fields = F.struct(score.alias("score"), F.lit(cut).alias("cut"), F.col(f"l{cut}").alias("l"), F.col(f"r{cut}").alias("r"))
        return F.when(F.col(f"l{cut}").isNotNull(), fields)

    scored = sums.withColumn("best", F.least(*[cut_score(cut) for cut in range(1, MOST_WORDS)]))
    scored = scored.select("k1", "k2", "a", "best.score", "best.l", "best.r", F.shiftright("k1", 32).alias("gid"))
    scored = scored.join(words.select("gid", "lang"), "gid").drop("gid")
    # What ties with the last of the best stays until the phrases are known. A language's best come from those of
    # its parts, so that one task ranks a bounded number of rows but for ties.
    best = scored.withColumn("_part", F.pmod(F.xxhash64("k1", "k2"), F.lit(RANKED_PARTS)))
    for keys in (["lang", "_part"], ["lang"]):
        place = Window.partitionBy(*keys).orderBy(F.col("score").desc_nulls_last(), F.col("a").desc_nulls_last())
        best = best.withColumn("_place", F.rank().over(place)).filter(F.col("_place") <= top)
    # Four rows at most for each of the best.
    spelled = best.select("lang", "k1", "k2", "a", "l", "r", "score", F.posexplode(F.array(*g)).alias("at", "gid")).filter("gid > 0")
    spelled = spelled.join(words.select("gid", "word"), "gid").groupBy("lang", "k1", "k2", "a", "l", "r", "score")
    in_order = F.sort_array(F.collect_list(F.struct("at", "word")))
    named = spelled.agg(F.array_join(F.transform(in_order, lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc_nulls_last(), F.col("a").desc_nulls_last(), F.col("phrase"))
    ranked = named.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
