"""Shared lines against brute force and SQL."""

import hashlib
from collections import Counter

import numpy as np
import oracle
import pytest

from corpus import ODD, SF, clashing, docs
from storyloom.llm import lines
from storyloom.llm.queries import ORACLES, QUERIES


def brute(texts, min_docs):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    cut = [(t or "").split("\n") for t in texts]
    in_docs = Counter(k for ls in cut for k in {key(x) for x in ls} if k)
    kept = [[x for x in ls if in_docs[key(x)] < min_docs] for ls in cut]
    return [(len(ls), len(ls) - len(k), "\n".join(k)) for ls, k in zip(cut, kept)]


def test_query_equals_sql(spark):
    assert oracle.compare(spark, oracle.connect(SF), "op3", QUERIES["op3_line_dedup"], ORACLES["op3_line_dedup"], SF) == ""


def test_odd_texts(spark):
    texts = [*ODD, *[f"Shared LINE \r\nown {i}\n  shared line" for i in range(12)], "É\né", "É"]
    df = clashing(docs(spark, texts), "kept_text", "TEXT", "n_lines", "shard")
    found = {r["doc_id"]: r for r in lines.drop_shared_lines(df, min_docs=3).collect()}
    want = brute(texts, 3)
    assert {i: (r["n_lines"], r["n_dropped"], r["kept_text"]) for i, r in found.items()} == dict(enumerate(want))
    assert want[10][1] == 2


def test_null_ids_and_repeated_rows_count_as_documents(spark):
    df = docs(spark, ["a\nb", "a\nb", "a\nc"], ids=[None, None, 1])
    found = sorted((r.text, r.n_dropped, r.kept_text) for r in lines.drop_shared_lines(df, min_docs=3).collect())
    assert found == [("a\nb", 1, "b"), ("a\nb", 1, "b"), ("a\nc", 1, "c")]


def test_no_rows(spark):
    assert lines.drop_shared_lines(docs(spark, [])).collect() == []


def test_a_line_of_most_documents_is_dealt_out(spark):
    texts = [f"everywhere\nown {i}" for i in range(3000)]
    found = lines.drop_shared_lines(docs(spark, texts))
    assert {(r.n_dropped, r.kept_text) for r in found.collect()} == {(1, f"own {i}") for i in range(3000)}


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_is_minimal_and_finds_every_key(n):
    rng = np.random.default_rng(n)
    h1, h2 = (rng.integers(0, 2**64, n, np.uint64) for _ in range(2))
    counts = rng.integers(1, 10**12, n)
    shard = lines.Shard.build(h1, h2, counts)
    assert sorted(shard.numbers(h1, h2).tolist()) == list(range(n))
    again = lines.Shard.unpack(**shard.pack())
    assert (again.lookup(h1, h2) == counts).all()
    other = rng.integers(0, 2**64, (2, 1000), np.uint64)
    assert (again.lookup(other[0], other[1]) == 0).all()


def test_keys_left_after_all_levels_are_found(monkeypatch):
    monkeypatch.setattr(lines, "LEVELS", 1)
    rng = np.random.default_rng(5)
    h1, h2 = (rng.integers(0, 2**64, 500, np.uint64) for _ in range(2))
    shard = lines.Shard.build(h1, h2, np.arange(500))
    assert len(shard.rest) > 0 and (shard.lookup(h1, h2) == np.arange(500)).all()


def test_hash_digest_is_what_the_index_holds():
    import xxhash

    h1, h2 = lines._hash(b"line")
    assert bytes.fromhex(f"{h1:016x}{h2:016x}") == xxhash.xxh3_128_digest(b"line")
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
