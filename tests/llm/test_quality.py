"""Rule statistics against brute force; the forest on planted anomalies and on the given labels."""

from collections import Counter

import numpy as np

from corpus import ODD, SF, clashing, docs, words_of
from storyloom.llm import quality
from storyloom.llm.queries import QUERIES


def brute(text):
    words = words_of(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum((text or "").count(c) for c in "#*$%&|<>"),
        sum(x in lines[:i] for i, x in enumerate(lines)),
        len(inside),
    )


def test_query_counts_and_base_rules(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = QUERIES["op5_quality_rules"](spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in found} == {i: brute(t) for i, t in rows.items()}
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs_, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    forest = quality.fit(docs_, labels.filter("doc_id % 2 = 0"))
    found = quality.judge(docs_.join(labels.filter("doc_id % 2 = 1"), "doc_id"), forest).filter("not base_failed").collect()
    good = [r.kept for r in found if r.quality == 1]
    bad = [r.kept for r in found if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_odd_texts_and_clashing_columns(spark):
    df = clashing(docs(spark, ODD), "kept", "n_words", "TEXT", "base_failed")
    found = quality.judge(df, quality.Forest([], 1.0)).select("doc_id", *quality.ADDED).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in found} == {i: brute(t) for i, t in enumerate(ODD)}
    assert not any(r.kept for r in found)


def test_without_labels_nothing_is_anomalous(spark):
    df = docs(spark, [" ".join(f"w{i}" for i in range(60))] * 2, ids=[None, None])
    labels = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int")
    forest = quality.fit(df, labels)
    assert [r.kept for r in quality.judge(df, forest).collect()] == [True, True]
    assert quality.judge(docs(spark, []), forest).collect() == []


def test_forest_isolates_what_lies_apart():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(1, 0.1, (600, 3)), rng.normal(3, 0.1, (60, 3))])
    good = np.arange(660) < 600
    forest = quality.Forest.choose(points, good)
    scores = forest.scores(points)
    assert (scores[good] <= forest.threshold).mean() >= 0.99 and (scores[~good] > forest.threshold).all()


def test_path_length_of_small_trees():
    assert quality._path(np.array([0, 1, 2])).tolist() == [0, 0, 1]
    assert 9 < quality._path(256) < 11
