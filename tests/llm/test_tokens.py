"""Token ids, token files and packing against the tokenizers themselves."""

import random
import zlib

import numpy as np
import pytest

from corpus import ODD, SF, clashing, docs
from storyloom.llm import packing, token_files
from storyloom.llm.queries import QUERIES, tokenizer_path
from storyloom.llm.tokens import Encoder, tokenizer

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"
PARTS = [
    "a", "B", "é", "É", "ß", "word", " The", " ", "  ", "\n", "\n\n", "\t", "\r\n", "'s", "'ll", "don't", "1", "22", "!", "...", ", ",
    "<|endoftext|>", " ", "　", "\x1c", "\x85", "日本", "́", "Σ", "İ", "\0", "_", "-", "😀", "</w>", "ﬁ", "​", "³",
]


def ids_of(name, texts):
    return [e.ids for e in tokenizer(tokenizer_path(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", [BYTES, WORDS])
def test_pieces_give_the_ids_of_whole_texts(name, monkeypatch):
    monkeypatch.setattr("storyloom.llm.tokens.KEPT_PIECES", 50)
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    found = Encoder(tokenizer_path(name), np.uint32).encode(texts)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == ids_of(name, texts)


def files_brute(rows, end=2):
    out, at = [], 0
    for (doc_id, _), ids in zip(rows, ids_of(WORDS, [t for _, t in rows])):
        out.append((doc_id, at, len(ids) + 1, crc([*ids, end])))
        at += len(ids) + 1
    return out


def test_token_file_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    assert sorted(tuple(r) for r in QUERIES["op6_token_files"](spark, SF).collect()) == files_brute(rows)


def test_token_files_of_odd_texts(spark):
    folder = token_files.new_folder(spark)
    df = clashing(docs(spark, [*ODD, "x y", "x"], ids=[*range(len(ODD)), None, None]).repartition(3), "start", "TEXT", "part")
    token_files.write_tokens(df, folder, tokenizer_path(WORDS), 2, 49_408)
    found = sorted((tuple(r) for r in token_files.read_documents(spark, folder, 49_408).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [None, None, *range(len(ODD))]
    assert found[2:] == [(i, at + found[2][1], n, c) for i, at, n, c in files_brute(list(enumerate(ODD)))]
    assert found[0][1] == 0 and found[2][1] == found[0][2] + found[1][2]


def test_token_files_of_no_rows(spark):
    folder = token_files.new_folder(spark)
    token_files.write_tokens(docs(spark, []), folder, tokenizer_path(WORDS), 2, 49_408)
    assert token_files.read_documents(spark, folder, 49_408).collect() == []


def test_smallest_type():
    assert token_files.token_type(49_408) == np.dtype("<u2") and token_files.token_type(70_000) == np.dtype("<u4")


def packed(rows, texts_by_id, capacity):
    assert len(rows) == len({(r.doc_id, r.piece) for r in rows})
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))]
        assert sum(n for _, n in held) <= capacity
    want = {}
    for (doc_id, _), ids in zip(texts_by_id, ids_of(BYTES, [t for _, t in texts_by_id])):
        ids, at = [*ids, 0], 0
        for piece, n in enumerate(packing.cut_lengths(len(ids), capacity)):
            want[doc_id, piece] = (at, n, crc(ids[at : at + n]))
            at += n
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    return len(bins)


def test_packing_query(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op8_best_fit_packing"](spark, SF).collect()
    least = -(-sum(r.length for r in rows) // 2048)
    assert packed(rows, texts, 2048) <= 1.01 * least + 1


def test_packing_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 5)
    df = clashing(docs(spark, ODD), "length", "TEXT", "piece", "shard")
    rows = packing.packed_documents(df, tokenizer_path(BYTES), capacity=64).collect()
    packed(rows, list(enumerate(ODD)), 64)
    again = docs(spark, ["a b"] * 3, ids=[None, 4, 4])
    found = packing.packed_documents(again, tokenizer_path(BYTES), capacity=64).collect()
    assert sorted((str(r.doc_id), r.length) for r in found) == [("4", 3), ("4", 3), ("None", 3)]
    assert packing.packed_documents(docs(spark, []), tokenizer_path(BYTES)).collect() == []


def test_cut_lengths():
    assert [packing.cut_lengths(n, 8) for n in (1, 8, 9, 16, 20)] == [[1], [8], [1, 8], [8, 8], [4, 8, 8]]


@pytest.mark.parametrize("seed", range(4))
def test_evolution_is_no_worse_than_best_fit(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 99) for _ in range(300)]
    first = packing._pack(sorted(range(300), key=lambda i: -lengths[i]), lengths, 100, [])
    found = packing.evolve(lengths, 100, [], seed)
    room = [0] * (max(found) + 1)
    for i, b in enumerate(found):
        room[b] += lengths[i]
    assert max(room) <= 100 and len(room) <= len(first) and min(room) > 0
    assert max(packing.evolve(lengths, 100, [found, found], seed + 1)) <= max(found)


def test_evolution_goes_past_best_fit():
    saved = 0
    for seed in range(4):
        rng = random.Random(seed)
        lengths = [rng.randint(20, 100) for _ in range(500)]
        first = packing._pack(sorted(range(500), key=lambda i: -lengths[i]), lengths, 150, [])
        saved += len(first) - (max(packing.evolve(lengths, 150, [], seed)) + 1)
    assert saved >= 4


def test_crossover_keeps_every_document_once():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 50, 200).tolist()
    one, other = (packing._pack(rng.permutation(200).tolist(), lengths, 100, []) for _ in range(2))
    child = packing._cross(one, other, lengths, 100, rng)
    assert sorted(i for b in child for i in b) == list(range(200))
    assert max(sum(lengths[i] for i in b) for b in child) <= 100


def test_nothing_is_packed_again_once_the_bound_is_met(monkeypatch):
    calls = []
    plain = packing._pack
    monkeypatch.setattr(packing, "_pack", lambda *a: calls.append(1) or plain(*a))
    found = packing.evolve([60, 40, 70, 30, 50, 50], 100, [], 3)
    assert max(found) == 2 and len(calls) == 1
    assert max(packing.evolve([60, 40, 70, 30, 50, 50], 100, [found, found], 4)) == 2 and len(calls) == 1


def test_pieces_that_come_back_outlast_a_fresh_start(monkeypatch):
    monkeypatch.setattr("storyloom.llm.tokens.KEPT_PIECES", 40)
    held = Encoder(tokenizer_path("byte_bpe_50k.json"), np.uint32)
    made = []
    plain = held.kept._by_model
    monkeypatch.setattr(held.kept, "_by_model", lambda word: made.append(word) or plain(word))
    rare = [f" {a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    for i in range(0, len(rare), 10):
        held.encode([" often" + "".join(rare[i : i + 10])])
    assert made.count("Ġoften") == 1
