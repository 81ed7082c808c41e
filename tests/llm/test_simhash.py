"""SimHash groups against brute force."""

import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from corpus import ODD, SF, clashing, docs, words_of
from storyloom.llm import simhash, tokens
from storyloom.llm.components import components
from storyloom.llm.queries import QUERIES, tokenizer_path


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_fingerprint(text, width=3):
    words = words_of(fold(text))
    found = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) > width else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute(rows, radius=3):
    prints = {i: brute_fingerprint(t) for i, t in rows}
    near = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= radius]
    root = grouped(prints, near)
    return {(i, f"{p:016x}", root[i]) for i, p in prints.items()}


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {tuple(r) for r in QUERIES["op1_simhash"](spark, SF).collect()} == brute(rows)


def test_odd_texts_and_clashing_columns(spark):
    df = clashing(docs(spark, ODD), "fingerprint", "component_id", "TEXT")
    found = simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()
    assert {tuple(r) for r in found} == brute(list(enumerate(ODD)))
    assert {r.fingerprint for r in found if r.doc_id < 3} == {"0" * 16}


def test_null_ids_repeated_rows_and_no_rows(spark):
    df = docs(spark, ["a b c d"] * 4, ids=[None, 7, 7, 5])
    found = sorted((tuple(r) for r in simhash.near_duplicates(df).select("doc_id", "component_id").collect()), key=str)
    assert found == [(5, 5), (7, 5), (7, 5), (None, 5)]
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


@pytest.mark.parametrize("radius", [0, 3, 40])
def test_forest_joins_what_all_pairs_join(radius, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 64)
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(6)]
    left, right = (np.array([[b ^ (1 << rng.randrange(64))] for b in base for _ in range(8)], np.uint64) for _ in range(2))
    nodes = [int(x) for x in np.concatenate([left, right]).ravel()]
    a, b = simhash._forest(left, right, radius, False)
    n = len(left)
    pairs = [(i, j) for i in range(n) for j in range(n, 2 * n) if (nodes[i] ^ nodes[j]).bit_count() <= radius]
    want = grouped(set(nodes), [(nodes[i], nodes[j]) for i, j in pairs])
    assert grouped(set(nodes), list(zip(a.ravel().tolist(), b.ravel().tolist()))) == want
    assert len(a) < 2 * n


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(f"{i:04d}", f"{(i * 7) % 300:04d}") for i in range(300)]
    hub = [("x0000", f"x{i:04d}") for i in range(1, 200)]
    edges = spark.createDataFrame(path + hub + [("z", "z"), (None, "q")], "a string, b string")
    found = {r.node: r.root for r in components(edges).collect()}
    nodes = {n for e in path + hub for n in e}
    assert found == {n: grouped(nodes, path + hub)[n] for n in nodes if n in found}
    assert len({found[n] for n in nodes if n.startswith("x")}) == 1


def near_texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = [[rng.choice(vocabulary) for _ in range(120)] for _ in range(8)]
    out = []
    for words in base:
        out.append(" ".join(words))
        for changed in (1, 2, 3, 6, 12):
            copy = list(words)
            for at in rng.sample(range(120), changed):
                copy[at] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    return out + ["", None, " ", "short", "short"]


def five(text):
    words = words_of(fold(text))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_one_document_of_each_similar_group_stays(spark):
    texts = near_texts()
    sets = {i: five(t) for i, t in enumerate(texts)}
    near = [
        (a, b)
        for a, b in itertools.combinations(sets, 2)
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    ]
    root = grouped(sets, near)
    kept = simhash.without_near_duplicates(clashing(docs(spark, texts), "key", "TEXT", "component"))
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == set(root.values())
    assert kept.columns[-3:] == ["key", "TEXT", "component"]


def test_dense_groups_give_few_pairs():
    rng = random.Random(1)
    base = rng.getrandbits(64)
    tile = np.array(sorted({base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(500)}), np.uint64)
    kept = np.zeros((0, 3), np.int64)
    for a, b, gap in simhash._close(tile[:, None], tile[:, None], 4, True):
        kept = simhash._spanning(np.concatenate([kept, np.stack([a, b, gap], axis=1)]), 3)
    assert len(kept) <= 3 * 2 * len(tile)


def kept_and_wanted(spark, texts):
    """The ids that stay, and those that must by comparing all pairs of shingle sets."""
    sets = {i: five(t) for i, t in enumerate(texts)}
    near = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    kept = {r.doc_id for r in simhash.without_near_duplicates(docs(spark, texts)).collect()}
    return kept, set(grouped(sets, near).values())


def some_words(rng, n):
    return [f"w{rng.randrange(100_000)}" for _ in range(n)]


def test_pairs_inside_a_family_with_a_common_passage_are_found(spark):
    rng = random.Random(5)
    passage, texts = some_words(rng, 300), []
    for _ in range(150):  # two of a pair are at 0.84, all others at 0.73
        own = some_words(rng, 52)
        texts += [" ".join(passage + own), " ".join(passage + own[:25] + some_words(rng, 27))]
    kept, wanted = kept_and_wanted(spark, texts)
    assert len(wanted) == 150
    assert kept == wanted


def test_blocks_join_what_all_pairs_join(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MIN_BLOCK", 1 << 14)
    monkeypatch.setattr(simhash, "MAX_BLOCK", 1 << 14)
    rng = random.Random(6)
    passage, texts = some_words(rng, 200), []
    for _ in range(40):
        own = some_words(rng, 30)
        texts += [" ".join(passage + own), " ".join(passage + own[:15] + some_words(rng, 12))]
    kept, wanted = kept_and_wanted(spark, texts)
    assert kept == wanted and len(wanted) < len(texts)


def test_different_texts_with_one_fingerprint_are_checked(spark):
    rng = random.Random(7)
    line = " ".join(some_words(rng, 9))
    texts = [" ".join([*some_words(rng, 60), *[line] * 300]) for _ in range(12)]
    texts += [texts[0] + " end", texts[0]]
    assert len({tuple(simhash.fingerprint(t.encode(), 5, 2)) for t in texts}) == 1
    kept, wanted = kept_and_wanted(spark, texts)
    assert kept == wanted == set(range(12))


def test_links_between_equal_fingerprints_hold_on_the_shingles():
    sets = [np.arange(10), np.arange(9), np.arange(100, 110)]
    sizes = np.array([len(x) for x in sets])
    hashes = np.concatenate(sets).astype(np.uint64)
    block = simhash._Block(pa.array(["a", "b", "c"]), np.zeros((3, 2), np.uint64), hashes, np.cumsum(sizes) - sizes, sizes)
    assert simhash._checked(block, block, 31, 0.8) == (["a"], ["b"])


def test_texts_that_differ_in_repeats_are_found(spark):
    rng = random.Random(8)
    texts = []
    for times in (1, 3, 9, 9, 9, 9):
        words = some_words(rng, 100)
        texts += [" ".join(words), " ".join(words[:48] + words[40:48] * times + words[48:]), " ".join([*words, "end"])]
    kept, wanted = kept_and_wanted(spark, texts)
    assert kept == wanted == set(range(0, 18, 3))


def test_memory_of_a_group_of_near_copies_stays_small():
    rng = np.random.default_rng(3)
    prints = np.unique(np.uint64(1) << rng.integers(0, 64, (1500, 2)).astype(np.uint64), axis=0)
    simhash._forest(prints[:8], prints[:8], 4, True)
    tracemalloc.start()
    root, moved = simhash._forest(prints, prints, 4, True)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(moved) == len(prints) - 1 and (root == prints[0]).all()
    assert peak < 25e6


def test_near_duplicates_give_back_what_tokenizing_kept(spark, monkeypatch):
    path, works = tokenizer_path("byte_bpe_50k.json"), []
    monkeypatch.setattr(simhash, "in_batches", lambda df, work, schema: works.append(work))
    rows = spark.createDataFrame([(1, "a b c d e f g")], "key long, text string")
    simhash._sketched(rows, 5, 2)
    tokens.encoder(path, np.uint32).encode(["a b c"])
    assert tokens.encoder.cache_info().currsize == 1
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([b"a b c"])], ["key", "text"])
    assert [b.num_rows for b in works[0](iter([batch]))] == [1]
    assert tokens.encoder.cache_info().currsize == 0
