"""Packing by first-fit decreasing against a plain scan of bins, and whole results against the tokenizer."""

import random
import zlib

import numpy as np
import pytest

from corpus import ODD, SF, clashing, docs
from storyloom.llm import tree_packing
from storyloom.llm.queries import QUERIES, tokenizer_path
from storyloom.llm.tokens import tokenizer

BYTES, VOCABULARY = "byte_bpe_50k.json", 50_257


def plain_first_fit(lengths, capacity):
    rooms, out = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = next((k for k, room in enumerate(rooms) if room >= lengths[i]), len(rooms))
        if at == len(rooms):
            rooms.append(capacity)
        rooms[at] -= lengths[i]
        out[i] = at
    return out


@pytest.mark.parametrize("seed", range(5))
def test_tree_finds_the_first_bin_that_fits(seed):
    rng = random.Random(seed)
    for n in (0, 1, 2, 3, 7, 64, 300):
        lengths = [rng.randint(1, rng.choice([10, 64])) for _ in range(n)]
        assert tree_packing.first_fit_decreasing(lengths, 64) == plain_first_fit(lengths, 64)


@pytest.mark.parametrize("seed", range(5))
def test_plan_holds_every_token_once_and_pads_nothing(seed):
    rng = random.Random(seed)
    for n in (0, 1, 2, 5, 200):
        lengths = [rng.randint(1, 63) for _ in range(n)]
        sequences = tree_packing.plan(lengths, 64)
        tokens = [(i, t) for s in sequences for i, first, k in s for t in range(first, first + k)]
        assert sorted(tokens) == [(i, t) for i, k in enumerate(lengths) for t in range(k)]
        sizes = [sum(k for _, _, k in s) for s in sequences]
        short = [s for s in sizes if s < 64]
        assert all(s <= 64 and s & (s - 1) == 0 for s in sizes) and len(set(short)) == len(short)
        # First fit leaves at least half of the bins half full: the rest fills gaps, one cut at most for each.
        assert sum(map(len, sequences)) <= n + max(tree_packing.first_fit_decreasing(lengths, 64), default=0) + 7


def ids_of(texts):
    found = tokenizer(tokenizer_path(BYTES)).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [[*e.ids, 0] for e in found]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def whole(rows, wanted, capacity):
    """Rows (doc_id, start, length, crc, doc_tokens, sequence_id, offset) hold ``wanted`` [(doc_id, ids)]."""
    for doc_id, ids in wanted:
        mine = sorted(r for r in rows if r[0] == doc_id)
        assert [r[1] for r in mine] == [sum(r[2] for r in mine[:i]) for i in range(len(mine))]
        assert sum(r[2] for r in mine) == len(ids) and {r[4] for r in mine} == {len(ids)}
        assert [r[3] for r in mine] == [crc(ids[r[1] : r[1] + r[2]]) for r in mine]
    sequences = {}
    for r in rows:
        sequences.setdefault(r[5], []).append((r[6], r[2]))
    for held in sequences.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))]
        n = sum(n for _, n in held)
        assert n <= capacity and n & (n - 1) == 0


def test_query_packs_all_documents(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    wanted = list(zip([i for i, _ in texts], ids_of([t for _, t in texts])))
    rows = [tuple(r) for r in QUERIES["op13_packing"](spark, SF).collect()]
    whole(rows, wanted, 1024)
    assert len({r[0] for r in rows}) == len(texts)


def test_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(tree_packing, "GROUP_TAILS", 3)
    df = clashing(docs(spark, ODD).repartition(3), "start", "TEXT", "draw", "group", "length")
    pieces = tree_packing.packed_documents(df, tokenizer_path(BYTES), VOCABULARY, capacity=64)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = [tuple(r) for r in tree_packing.ids_crc32(pieces, 2).select(columns).collect()]
    whole(rows, list(enumerate(ids_of(ODD))), 64)


def test_null_ids_repeated_rows_and_no_rows(spark):
    found = tree_packing.packed_documents(docs(spark, ["a b"] * 3, ids=[None, 4, 4]), tokenizer_path(BYTES), VOCABULARY)
    rows = found.collect()
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == {None: 3, 4: 6} and sum(r.length for r in rows) == 9
    assert tree_packing.packed_documents(docs(spark, []), tokenizer_path(BYTES), VOCABULARY).collect() == []
    with pytest.raises(ValueError):
        tree_packing.packed_documents(docs(spark, []), tokenizer_path(BYTES), VOCABULARY, capacity=1000)
