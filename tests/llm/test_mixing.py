"""Water-filling against the stepwise rule, sampling against its targets."""

import random

import oracle
import pytest

from corpus import ODD, SF, clashing, docs, words_of
from storyloom.llm import mixing
from storyloom.llm.queries import ORACLES, QUERIES


def brute_targets(sizes, weights=(1, 2, 3), epochs=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = sum(sizes.values()) - sum(epochs * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: epochs * sizes[s] if s in full else left * weight[s] / share for s in names}
        over = {s for s in names if s not in full and target[s] > epochs * sizes[s] * (1 + 1e-12)}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("seed", range(6))
def test_targets_equal_stepwise_sharing(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}é" if i % 2 else f"S{i}": rng.choice([0, 1, 5, 50, 1000, 9000]) for i in range(rng.randint(1, 9))}
    if seed % 2:
        sizes[None] = 70
    if not sum(sizes.values()):
        sizes["more"] = 4
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in mixing.targets(df).collect()}
    assert found == pytest.approx(brute_targets(sizes))


def test_query_equals_sql(spark):
    assert oracle.compare(spark, oracle.connect(SF), "op9", QUERIES["op9_mixing"], ORACLES["op9_mixing"], SF) == ""


def test_taken_words_come_near_and_reruns_agree(spark):
    rng = random.Random(2)
    texts = ["w " * rng.randint(1, 60) for _ in range(1500)]
    sources = ["hot" if i % 3 == 0 else f"s{i % 7}" for i in range(1500)]
    df = docs(spark, texts, sources=sources)
    runs = []
    for part in (df, df.repartition(5, "text")):
        rows = mixing.sized(part).persist()
        found = mixing.mix(rows).collect()
        runs.append(sorted((r.doc_id, r.copies) for r in found))
        taken, target = {}, {}
        for r in found:
            taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
            target[r.source] = r.target
            assert 0 <= r.copies <= 3
        assert all(abs(taken[s] - target[s]) <= 60 for s in target)
    assert runs[0] == runs[1]


def test_odd_rows(spark):
    texts = [*ODD, "a b", "a b", "a b"]
    ids = [*range(len(ODD)), None, 3, 3]
    sources = [None, "", "z", *["s"] * (len(ODD) - 3), None, "s", "s"]
    df = clashing(docs(spark, texts, ids=ids, sources=sources), "size", "target", "SOURCE", "key")
    rows = mixing.sized(df).persist()
    found = mixing.mix(rows)
    assert sorted(r.size for r in found.collect()) == sorted(len(words_of(t)) for t in texts)
    assert all(r.copies == 0 for r in found.collect() if r.source_size == 0)
    whole = sum(r.copies for r in found.collect())
    assert mixing.repeated(df, found).count() == whole
    assert mixing.repeated(df, found).columns == df.columns


def test_no_rows(spark):
    assert mixing.mix(mixing.sized(docs(spark, [])).persist()).collect() == []
