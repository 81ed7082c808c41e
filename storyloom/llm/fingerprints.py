"""Document fingerprints that add up: a homomorphic hash of the multiset of paragraphs."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import SPACE, parallelism, texts

#: 64-bit hashes of a paragraph, each split into two lanes modulo 2^32: what equality rests on.
HASHES = 4
#: 64-bit hashes of a window of words, a bit a lane modulo 2^16: what likeness rests on.
SKETCHES = 2
WINDOW_WORDS = 3

_PAIR = 0x0000000100000001
_LANES = [f"lane{i}" for i in range(32 * SKETCHES)]
_WHOLE = [f"whole{i}" for i in range(2 * HASHES)]
_DIGEST = [f"digest{i}" for i in range(8)]


def windows(paragraph: Column) -> Column:
    """Hashes of the windows of words of a paragraph, those at its end shorter; none without words."""
    words = F.filter(F.split(paragraph, f"[{SPACE}]+"), lambda w: w != "")
    # The outer array binds the words to a name, so that they are not split anew for each of them.
    each = F.transform(
        F.array(words),
        lambda ws: F.transform(ws, lambda w, i: F.xxhash64(w, *[F.get(ws, i + k) for k in range(1, WINDOW_WORDS)])),
    )
    return F.element_at(each, 1)


def _paragraph_sums(paragraphs: Column) -> Column:
    """Sums of the paragraph hashes, as an array of lanes modulo 2^32."""
    mask = F.lit(0xFFFFFFFF)

    def lanes(p: Column) -> list[Column]:
        hashes = [F.xxhash64(p, F.lit(k)) for k in range(HASHES)]
        return [half for h in hashes for half in (h.bitwiseAND(mask), F.shiftrightunsigned(h, 32))]

    start = F.array(*[F.lit(0).cast("long") for _ in range(2 * HASHES)])
    add = lambda acc, p: F.zip_with(acc, F.array(*lanes(p)), lambda a, b: (a + b).bitwiseAND(mask))
    return F.aggregate(paragraphs, start, add)


def measured(sides: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """``keys``, ``carried`` (numbers), n, lane0.. and whole0.. for every row of ``sides`` (body, keys, carried).

    A paragraph's vector holds its hashes and, for each bit of the hashes of its windows of words, how many
    of them have it set; a text's is the sum over its paragraphs. Bits are counted two at a time, as halves
    of one 64-bit sum, so a text takes 32 sums a hash; neither half can run over below 2^32 windows.
    """
    paragraphs = F.split("body", "\n", -1)
    rows = sides.withColumn("_paragraphs", paragraphs)
    rows = rows.withColumn("_sums", _paragraph_sums(F.col("_paragraphs")))
    rows = rows.select(
        *keys,
        *carried,
        *[F.element_at("_sums", i + 1).alias(c) for i, c in enumerate(_WHOLE)],
        F.explode_outer(F.flatten(F.transform("_paragraphs", windows))).alias("h0"),
    )
    more = rows
    for k in range(1, SKETCHES):
        more = more.withColumn(f"h{k}", F.when(F.col("h0").isNotNull(), F.xxhash64("h0", F.lit(k))))
    sums = [
        F.coalesce(F.sum(F.shiftrightunsigned(f"h{i // 32}", i % 32).bitwiseAND(F.lit(_PAIR))), F.lit(0)).alias(lane)
        for i, lane in enumerate(_LANES)
    ]
    return more.groupBy(*keys).agg(*[F.max(c).alias(c) for c in (*carried, *_WHOLE)], F.count("h0").alias("n"), *sums)


def text_of(prefix: str = "") -> Column:
    """The fingerprint as a string: the lanes of whole paragraphs, the number of windows, the lanes of bits."""
    low16 = lambda c, by: F.shiftrightunsigned(c, by).bitwiseAND(F.lit(0xFFFF))
    packed = []
    for i in range(0, len(_LANES), 2):
        one, two = f"{prefix}{_LANES[i]}", f"{prefix}{_LANES[i + 1]}"
        parts = (F.shiftleft(low16(one, 32), 48), F.shiftleft(low16(one, 0), 32), F.shiftleft(low16(two, 32), 16), low16(two, 0))
        packed.append(F.lpad(F.hex(reduce(Column.bitwiseOR, parts)), 16, "0"))
    whole = [F.lpad(F.hex(f"{prefix}{c}"), 8, "0") for c in _WHOLE]
    return F.lower(F.concat(*whole, F.lpad(F.hex(f"{prefix}n"), 8, "0"), *packed))


def signs(n: Column, lanes: list[Column]) -> Column:
    """Lanes as sums of +1 for a set and -1 for an unset bit."""
    halves = [h for lane in lanes for h in (F.shiftrightunsigned(lane, 32), lane.bitwiseAND(F.lit(0xFFFFFFFF)))]
    return F.array(*[(2 * h - n).cast("double") for h in halves])


def likeness(one: Column, other: Column) -> Column:
    """0 to 1 from two arrays of ``signs``: about the windows two texts share, of the mean of what they have.

    Sums of random signs differ in the mean square by as much as the multisets that they stand for.
    """
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x * x)
    apart = total(F.zip_with(one, other, lambda a, b: a - b))
    both = total(one) + total(other)
    return F.when(both > 0, F.greatest(F.lit(0.0), 1 - apart / both)).when(one.isNotNull() & other.isNotNull(), 1.0)


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, place, guest, doc_id, text, next_text) of ``docs`` (doc_id, text) in ascending id order.

    Ids are cut at quantiles into buckets of bounded size. Each bucket also gets, as a guest at its end, the
    first row of the next one (the last bucket that of the first), so one shuffle of the texts puts every
    row beside its successor. Only the bounds and the first ids of the buckets, as many as there are
    shuffle partitions, pass through the driver.
    """
    spark = docs.sparkSession
    count = 2 * parallelism(spark)
    bounds = sorted(set(docs.approxQuantile("doc_id", [i / count for i in range(1, count)], 0.2 / count)))
    rows = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("tie", F.xxhash64("text"))
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(bucket).cast("int"))
    firsts = (
        rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "tie")).alias("first")).orderBy("bucket").collect()
    )  # one row a bucket
    hosts = [
        {"first_id": r["first"]["doc_id"], "first_tie": r["first"]["tie"], "host": firsts[i - 1]["bucket"]}
        for i, r in enumerate(firsts)
    ]
    listed = F.from_json(F.lit(json.dumps(hosts)), "array<struct<first_id: long, first_tie: long, host: int>>")
    host = F.broadcast(spark.range(1).select(F.inline(listed)))
    guests = rows.join(host, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie")))
    guests = guests.select("doc_id", "text", "tie", F.col("host").alias("bucket"), F.lit(1).alias("guest"))
    both = rows.select("doc_id", "text", "tie", "bucket", F.lit(0).alias("guest")).unionByName(guests)
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), "tie")
    return both.select(
        "bucket",
        F.row_number().over(order).alias("place"),
        "guest",
        "doc_id",
        "text",
        F.lead("text").over(order).alias("next_text"),
    )


def edited_beside_next(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text of a row has its last half replaced by as many first code points of the next row in
    ascending id order, the first row's after the last. DataFrame functions only.

    Equal texts have equal fingerprints, and so have texts of the same paragraphs in another order. Nulls: a
    null text is an empty one; null ids come first. Rows of one id are ordered by a hash of their texts, and
    repeated rows follow each other. Two empty texts are alike (1.0). Long texts are read whole. An empty
    table gives no rows; a single row is its own successor. Other columns are not read.
    """
    rows = with_next(texts(docs, id_col, text_col))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("n_chars", n.cast("long"))
    rows = rows.withColumn("sha", F.sha2("edited", 256))
    digest = [F.conv(F.substring("sha", 8 * i + 1, 8), 16, 10).cast("long").alias(c) for i, c in enumerate(_DIGEST)]
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("text").alias("body")),
        F.struct(F.lit(1).alias("side"), F.col("edited").alias("body")),
    )
    each = rows.select("bucket", "place", "guest", "doc_id", "n_chars", *digest, F.explode(sides).alias("of")).select(
        "bucket", "place", "guest", "doc_id", "n_chars", *_DIGEST, "of.side", "of.body"
    )
    each = each.filter((F.col("guest") == 0) | (F.col("side") == 0))
    found = measured(each, ["bucket", "place", "side"], ["guest", "doc_id", "n_chars", *_DIGEST])
    # In the order (place, side) a text is followed by its edited text and that by the next text.
    order = Window.partitionBy("bucket").orderBy("place", "side")
    shown = found.select(
        "bucket", "place", "side", "guest", "doc_id", "n_chars", *_DIGEST,
        text_of().alias("fingerprint"),
        signs(F.col("n"), [F.col(c) for c in _LANES]).alias("signs"),
    )
    shown = (
        shown.withColumn("edited_fingerprint", F.lead("fingerprint", 1).over(order))
        .withColumn("edited_signs", F.lead("signs", 1).over(order))
        .withColumn("next_signs", F.lead("signs", 2).over(order))
        .filter((F.col("side") == 0) & (F.col("guest") == 0))
    )
    return shown.select(
        "doc_id",
        "n_chars",
        F.lower(F.concat(*[F.lpad(F.hex(c), 8, "0") for c in _DIGEST])).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("signs"), F.col("edited_signs")).alias("near_edited"),
        likeness(F.col("signs"), F.col("next_signs")).alias("near_next"),
    )
