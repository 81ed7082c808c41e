"""Toxicity: held-out accuracy on planted words and on the given labels."""

import random

import numpy as np

from corpus import ODD, SF, clashing, docs
from storyloom.llm import toxicity
from storyloom.llm.queries import QUERIES


def planted(n, seed):
    rng = random.Random(seed)
    syllables = "the an tion ing er re on at en nd ti es or te of ed is it al ar".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rude = ["grumblewort", "snotling", "vilefang", "muckrake", "blighter"]
    texts, toxic = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 300))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(max(2, len(words) // 50)):
                words.insert(rng.randrange(len(words)), rng.choice(rude))
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return texts, toxic


def model_of(spark, texts, toxic):
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    return toxicity.fit(docs(spark, texts), labels)


def test_planted_words(spark):
    model = model_of(spark, *planted(900, 1))
    texts, toxic = planted(300, 2)
    found = {r.doc_id: r.predicted for r in toxicity.score(docs(spark, texts), model).collect()}
    hits = np.array([found[i] == t for i, t in enumerate(toxic)])
    assert hits.mean() > 0.95
    df = clashing(docs(spark, [*ODD, *ODD], ids=[*range(len(ODD))] + [None] * len(ODD)), "score", "TEXT", "predicted", "toxic")
    rows = toxicity.score(df, model).collect()
    assert len(rows) == 2 * len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (0, 1, 2)}) == 1 and not any(r.predicted for r in rows if r.doc_id in (0, 1))
    assert toxicity.score(docs(spark, []), model).collect() == []


def test_without_toxic_labels_every_score_is_low(spark):
    texts, _ = planted(30, 3)
    for toxic in ([0] * 30, []):
        model = model_of(spark, texts, toxic)
        assert not any(r.predicted for r in toxicity.score(docs(spark, texts), model).collect())


def test_query_does_not_learn_from_held_out_rows(spark):
    import zlib

    found = QUERIES["op10_toxicity"](spark, SF).collect()
    assert {r.doc_id: r.held_out for r in found} == {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in found}
    assert all(r.predicted == (r.score >= 0.3) for r in found)


def test_held_out_rows_of_the_given_tables(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = QUERIES["op10_toxicity"](spark, sf).join(labels, "doc_id").filter("held_out").collect()
    toxic = np.array([r.toxic == 1 for r in rows])
    called = np.array([r.predicted == 1 for r in rows])
    assert called[toxic].mean() > 0.8 and called[~toxic].mean() < 0.02


def test_windows_hold_the_whole_text():
    text = " ".join(f"w{i}" for i in range(100)).encode()
    assert b"".join(w[:-3] for w in toxicity.windows(text))[::3] == b" " + text
    assert toxicity.windows(None) == toxicity.windows(b" \n") == []
