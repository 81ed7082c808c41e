"""The trie against a dictionary of all prefixes."""

import hashlib
import random
import zlib

import pytest

from corpus import SF, clashing
from storyloom.llm import prefix_trie
from storyloom.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuild(rows):
    held = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            held.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in held.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = abs(c) // 5 * 5 * (1 if c >= 0 else -1)
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def brute(paths):
    members = {}
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members.setdefault(tuple(paths[c][:d]), []).append(c)
    children, leaves, saved = ({p: 0 for p in members} for _ in range(3))
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, cs in members.items():
        own = (len(cs) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += own
    ends = {}
    for c, p in paths.items():
        ends.setdefault(tuple(p), []).append(c)
    return {
        (
            cs[0], len(p), members[p[:-1]][0] if p else None, len(cs), children[p], leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest(),
        )
        for p, cs in members.items()
    }


def conversations(seed, n, most, kinds):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 5 * n), n):
        for turn in range(rng.choice([1, 2, most, rng.randint(1, most)])):
            rows.append((c, turn or None, rng.choice(["user", None, "assistant"]), rng.choice([None, "é", "日本"] + ["x"] * kinds)))
    rng.shuffle(rows)
    return rows


def check(spark, rows, **options):
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(3), "depth", "key", "pos", "TURN", "path")
    found = [tuple(r) for r in prefix_trie.prefix_trie(df, **options).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rebuild(rows))


@pytest.mark.parametrize("container_turns", [1, 65_536])
def test_trie_equals_all_prefixes(spark, container_turns, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 3)
    check(spark, conversations(1, 150, 7, 2), container_turns=container_turns)


@pytest.mark.parametrize("container_turns", [3, 65_536])
def test_segments_of_long_conversations(spark, container_turns, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SEGMENT", 4)
    monkeypatch.setattr(prefix_trie, "BLOCK", 2)
    check(spark, conversations(2, 60, 33, 12), container_turns=container_turns)


def test_many_alike_and_one_very_long(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 7)
    rows = [(c, t, "user", f"t{t}") for c in range(0, 300) for t in range(10)]
    rows += [(1000, t, "user", f"t{t}") for t in range(1030)] + [(1005, t, "user", f"t{min(t, 900)}") for t in range(1024)]
    check(spark, rows)


def test_turnless_members_of_the_root(spark):
    check(spark, [(c, 0, "user", "hello") for c in range(1, 40)])
    check(spark, [(7, None, None, None), (None, 1, "user", "x")])


def test_no_conversations(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in QUERIES["op11_prefix_trie"](spark, SF).collect()} == brute(rebuild(rows))
