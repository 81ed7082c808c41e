"""The index against plain counts of windows, and collocations against a loop over all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from corpus import ODD, clashing, docs
from storyloom.llm import phrases


def windows(s, k):
    found = (tuple(s[i : i + k]) for i in range(len(s) - k + 1))
    return Counter(w for w in found if 0 not in w)


def as_counts(held):
    return Counter(dict(zip(map(tuple, held.words.T.tolist()), held.n.tolist())))


@pytest.mark.parametrize("seed", range(6))
def test_extensions_count_every_window(seed):
    rng = random.Random(seed)
    s = [0, *[rng.choice([0, 1, 1, 2, 3, rng.randint(1, 40)]) for _ in range(rng.choice([0, 3, 500]))], 0]
    fm = phrases.FMIndex.of(np.array(s, np.uint16))
    one = fm.single()
    assert as_counts(one) == windows(s, 1)
    for first in (fm.left, fm.right):
        two = first(one)
        assert as_counts(two) == windows(s, 2)
        for second in (fm.left, fm.right):
            three = second(two)
            assert as_counts(three) == windows(s, 3)
            for third in (fm.left, fm.right):
                assert as_counts(third(three)) == windows(s, 4)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, percent, top):
    counts, sizes = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in (1, 2, 3, 4):
                for i in range(len(words) - k + 1):
                    key = lang, tuple(words[i : i + k])
                    counts[key] = counts.get(key, 0) + 1
    frequent = {k: f for k, f in counts.items() if f >= least}
    covered = {}
    for (lang, w), f in frequent.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                key = lang, w[i : i + k]
                covered[key] = max(covered.get(key, 0), f)
    found = {}
    for (lang, w), a in frequent.items():
        if len(w) > 1 and 100 * covered.get((lang, w), 0) < percent * a:
            cuts = [(2000000 * a // (frequent[lang, w[:k]] + frequent[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), frequent[lang, w[:k]], frequent[lang, w[k:]]))
    return {
        (lang, at + 1, p.decode(), -a, l, r, sizes[lang], -s)
        for lang, held in found.items()
        for at, (s, a, p, l, r) in enumerate(sorted(held)[:top])
    }


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "b", "É", "é", "日本", "x\0y", "-", "the", "The", "of"]
    ends = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?", "\x0b", " ", " ", "\x1c", "\x85", " "]
    texts = ["".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return texts, [rng.choice(["en", "de", None, "und", ""]) for _ in range(n)]


def with_langs(spark, texts, langs):
    return spark.createDataFrame(list(zip(range(len(texts)), texts, langs)), "doc_id long, text string, lang string")


@pytest.mark.parametrize("shard_words", [1, 300, 1_000_000])
def test_collocations_equal_a_plain_count(spark, shard_words, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 50)
    monkeypatch.setattr(phrases, "BUCKET_WORDS", 500)
    texts, langs = corpus(3, 300)
    texts += [None, *ODD[1:9]]
    langs += [None] * 9
    df = clashing(with_langs(spark, texts, langs).repartition(3), "shard", "words", "LANG", "k1", "n")
    for top in (7, 2000):
        found = phrases.collocations(df, min_count=5, top=top, shard_words=shard_words)
        assert {tuple(r) for r in found.collect()} == brute(list(zip(langs, texts)), 5, 80, top)


def test_repeated_rows_and_hot_phrases(spark):
    texts = ["one two three four five"] * 40 + ["one two. one two three"] * 7 + ["w " * 30_000]
    langs = ["en"] * len(texts)
    found = phrases.collocations(with_langs(spark, texts, langs), min_count=5)
    assert {tuple(r) for r in found.collect()} == brute(list(zip(langs, texts)), 5, 80, 2000)


def test_nothing_to_find(spark):
    for texts in ([], [None, "", " .,", "a b"]):
        assert phrases.collocations(with_langs(spark, texts, [None] * len(texts))).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000 // 4
    df = spark.createDataFrame([(big, big, big + 7)], "a long, l long, r long")
    found = df.selectExpr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) AS s")
    assert found.first().s == 2000000 * big // (2 * big + 7)


def test_words_of_a_shard_do_not_depend_on_where_texts_are_cut(monkeypatch):
    text = "One two, three\tfour  five. É 日本 one ".encode() * 30
    whole, cut = phrases._Shard(), phrases._Shard()
    whole.add("en", text)
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 7)
    cut.add("en", text)
    assert whole.words == cut.words and whole.sizes == cut.sizes == {"en": 240}
    assert [x for p in whole.parts for x in p.tolist()] == [x for p in cut.parts for x in p.tolist()]
