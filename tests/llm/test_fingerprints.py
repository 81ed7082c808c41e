"""Fingerprints: edited texts against brute force, sums, order, and likeness."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpus import ODD, SF, clashing, docs
from storyloom.llm import fingerprints
from storyloom.llm.queries import QUERIES


def brute(rows):
    """(n_chars, hash of the edited text) by id, for rows in ascending order."""
    out = {}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, half = text or "", len(text or "") // 2
        edited = text[: len(text) - half] + (after or "")[:half]
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest())
    return out


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    found = QUERIES["op4_document_fingerprints"](spark, SF).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in found} == brute([tuple(r) for r in rows])
    texts = {r.doc_id: r.text for r in rows}
    by_text = {}
    for r in found:
        by_text.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in by_text.values())
    assert len({v for s in by_text.values() for v in s}) == len(by_text)
    long = [r for r in found if r.n_chars > 1000]
    assert sum(r.near_edited for r in long) / len(long) == pytest.approx(0.5, abs=0.1)


def test_odd_texts(spark):
    df = clashing(docs(spark, ODD), "fingerprint", "TEXT", "bucket", "place").repartition(3)
    found = {r.doc_id: r for r in fingerprints.edited_beside_next(df).collect()}
    assert {i: (r.n_chars, r.edited_sha256) for i, r in found.items()} == brute(list(enumerate(ODD)))
    assert found[0].fingerprint == found[1].fingerprint == found[1].edited_fingerprint and found[0].near_next == 1.0
    assert found[7].fingerprint == found[8].fingerprint and found[7].near_next == pytest.approx(1.0)


@pytest.mark.parametrize(("ids", "texts"), [([5], ["abcd ef"]), ([None, None, 3], ["x", "y", "z w"]), ([4, 4, 4], ["a b"] * 3), ([], [])])
def test_few_rows(spark, ids, texts):
    found = fingerprints.edited_beside_next(docs(spark, texts, ids=ids)).collect()
    assert len(found) == len(ids)
    assert all(r.edited_fingerprint and r.near_next is not None for r in found)


def lanes(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, body string")
    rows = fingerprints.measured(df, ["k"], []).orderBy("k").collect()
    return [[r[c] for c in [*fingerprints._WHOLE, "n", *fingerprints._LANES]] for r in rows]


def test_paragraphs_add_up_in_any_order(spark):
    one, two, both, swapped = lanes(spark, ["a b c d\ne f", "g h i\n\nj", "a b c d\ne f\ng h i\n\nj", "j\ng h i\n\ne f\na b c d"])
    whole = 2 * fingerprints.HASHES
    added = [(a + b) % 2**32 if i < whole else a + b for i, (a, b) in enumerate(zip(one, two))]
    assert added == both == swapped
    assert [(a - b) % 2**32 if i < whole else a - b for i, (a, b) in enumerate(zip(both, two))] == one


def test_likeness_follows_what_is_shared(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    texts = [" ".join(words), *(" ".join(words[: 2000 - k] + [f"x{k}_{i}" for i in range(k)]) for k in (200, 1000, 2000))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, body string")
    rows = fingerprints.measured(df, ["k"], [])
    signs = rows.select("k", fingerprints.signs(F.col("n"), [F.col(c) for c in fingerprints._LANES]).alias("s"))
    first = signs.filter("k = 0").select(F.col("s").alias("t"))
    near = [r[0] for r in signs.crossJoin(first).orderBy("k").select(fingerprints.likeness(F.col("s"), F.col("t"))).collect()]
    assert near[0] == 1 and near[1] == pytest.approx(0.9, abs=0.1) and near[2] == pytest.approx(0.5, abs=0.25) and near[3] < 0.35
