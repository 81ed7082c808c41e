import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.functions.vectors import cosine_similarity
from storyloom.operators import cluster, matching
from storyloom.operators.matching import earlier_matches

SCHEMA = "id long, pos long, vector array<float>"


def frame(spark, rows):
    return spark.createDataFrame([(i, p, None if v is None else [float(x) for x in v]) for i, p, v in rows], SCHEMA)


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or not len(a):
        return 0.0
    a, b = np.float32(a).astype(float), np.float32(b).astype(float)
    n = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
    return float(np.round((a * b).sum() / n, 12)) if n else 0.0


def sequential(rows, threshold, known=()):
    """The plain loop: best earlier seed at the threshold (smallest id on ties), else a new seed."""
    seeds, out = [(i, v) for i, _, v in known], {}
    for i, _, v in sorted(rows, key=lambda r: (r[1], r[0])):
        near = [(cosine(v, s), -j) for j, s in seeds if cosine(v, s) >= threshold]
        if near:
            out[i] = -max(near)[1]
        else:
            out[i] = i
            seeds.append((i, v))
    return out


def clustered(df):
    rows = [(r.id, r.story_cluster_id) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def test_cosine_cases(spark):
    rows = [([1, 2, 3], [1, 2, 3]), ([1, 0], [0, 1]), ([1, 0], [-1, 0]), ([1, 2, 3], [1, 2]), ([0, 0], [1, 1]), ([], [])]
    rows = [([float(x) for x in a], [float(x) for x in b]) for a, b in rows]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    got = [r[0] for r in df.select(cosine_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1, 0, -1, 0, 0, 0], abs=1e-9)


def test_assignment_cases(spark):
    items = frame(spark, [(1, 0, [0.99, 0.01, 0]), (2, 0, [0, 0, 1])])
    known = frame(spark, [(100, 0, [1, 0, 0]), (200, 0, [0, 1, 0])])
    assert {r.id: r.seed_id for r in cluster.assign_to_seeds(items, known, 0.85).collect()} == {1: 100}
    assert cluster.assign_to_seeds(items, known.limit(0), 0.85).count() == 0


def test_equal_similarity_goes_to_the_smallest_id(spark):
    items = frame(spark, [(9, 5, [1, 1])])
    others = frame(spark, [(4, 1, [2, 2]), (3, 2, [1, 1]), (1, 7, [1, 1])])
    (row,) = earlier_matches(items, others, 0.9).collect()
    assert (row.id, row.match_id, row.similarity) == (9, 3, 1.0)


def story_rows(seed, n=160, dims=6, stories=12, noise=0.35):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(stories, dims))
    rows = [(i, int(rng.integers(0, 40)), centres[rng.integers(stories)] + noise * rng.normal(size=dims)) for i in range(n)]
    rows += [(n, 3, np.zeros(dims)), (n + 1, 2, [1.0, 2.0]), (n + 2, 9, [1.0, 2.1]), (n + 3, 1, None), (n + 4, 50, [])]
    return rows


@pytest.mark.parametrize("block_rows", [8192, 16])
def test_leader_clusters_equal_the_sequential_loop(spark, block_rows):
    rows = story_rows(1)
    got = clustered(cluster.leader_cluster(frame(spark, rows), 0.8, block_rows=block_rows, prefix_rows=40))
    assert got == sequential(rows, 0.8)


def test_blocked_join_equals_the_shipped_join(spark):
    rows = story_rows(2, n=300)
    df = frame(spark, rows).repartition(4)

    def found(block_rows):
        return {(r.id, r.match_id, round(r.similarity, 9)) for r in earlier_matches(df, df, 0.7, block_rows).collect()}

    assert found(20) == found(8192)


def test_stored_seeds_come_first(spark):
    rows = story_rows(3, n=80)
    known = [(1000 + i, 0, v) for i, (_, _, v) in enumerate(rows[:6])]
    got = clustered(cluster.leader_cluster(frame(spark, rows), 0.8, frame(spark, known)))
    assert got == sequential(rows, 0.8, known)


def test_a_third_of_all_rows_in_one_story(spark):
    rng = np.random.default_rng(5)
    hot = rng.normal(size=5)
    rows = [(i, i, hot * (1 + i % 3) if i % 3 == 0 else rng.normal(size=5)) for i in range(240)]
    got = clustered(cluster.leader_cluster(frame(spark, rows), 0.85, block_rows=16, prefix_rows=32))
    assert got == sequential(rows, 0.85)
    assert sum(v == got[0] for v in got.values()) >= 80


def test_threshold_must_be_positive(spark):
    with pytest.raises(ValueError, match="positive"):
        earlier_matches(frame(spark, []), frame(spark, []), 0.0)


def topic_rows(n, dims, seed=11):
    """Vectors of which a few directions hold most, and some that are near each other."""
    rng = np.random.default_rng(seed)
    basis = rng.normal(size=(8, dims))
    return [(i, i, rng.normal(size=8) @ basis + 0.3 * rng.normal(size=dims)) for i in range(n)]


@pytest.mark.parametrize("dims,threshold", [(96, 0.9), (96, 0.3), (200, 0.97)])
def test_bounds_of_heads_lose_no_pair(spark, dims, threshold):
    rows = topic_rows(240, dims)
    df = frame(spark, rows).repartition(3)
    unit = np.array([np.float32(v) for _, _, v in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    head = matching._rotation(unit)
    near, whole = matching._in_reach(unit, unit, head, threshold)
    assert (near | (unit @ unit.T < threshold - 1e-6)).all()
    if threshold > 0.95:
        assert whole is None and near.mean() < matching.SPARSE
    found = {(r.id, r.match_id) for r in earlier_matches(df, df, threshold, 30).collect()}
    sim = np.round(unit @ unit.T, 12)
    want = set()
    for i in range(len(rows)):
        before = [j for j in range(i) if sim[i, j] >= threshold]
        if before:
            want.add((i, max(before, key=lambda j: (sim[i, j], -j))))
    assert found == want


def test_work_shrinks_where_vectors_lie_together(spark):
    rng = np.random.default_rng(4)
    centres = np.eye(12)
    rows = [(i, i, centres[i % 12] + 0.02 * rng.normal(size=12)) for i in range(1200)]
    df = frame(spark, rows)
    work = matching.match_work(df, df, 0.9, block_rows=100).first()
    # Twelve stories far from each other: most items meet their own only.
    assert work.comparisons <= 1200 * 1200 / 4 and work.copies <= 8 * 1200
    hot = frame(spark, [(i, i, [1.0, 0.0]) for i in range(500)])  # all alike: blocks stay bounded
    left, right = matching.placed(hot, hot, 500, np.array([[1.0, 0.0]]), 0.9, 50)
    for side in (left, right):
        assert side.groupBy(*matching.BLOCK).count().agg(F.max("count")).first()[0] <= 100


def test_vectors_too_large_to_ship_meet_in_blocks(spark, monkeypatch):
    rows = story_rows(6, n=120)
    df = frame(spark, rows)
    want = {(r.id, r.match_id) for r in earlier_matches(df, df, 0.7).collect()}
    monkeypatch.setattr(matching, "SHIPPED_BYTES", 1000)
    assert {(r.id, r.match_id) for r in earlier_matches(df, df, 0.7).collect()} == want


def test_copies_grow_no_faster_than_the_vectors(spark):
    """Small blocks are joined into larger ones, so that no vector is sent to more than some blocks."""

    def work(n):
        rng = np.random.default_rng(n)
        df = frame(spark, [(i, i, v) for i, v in enumerate(rng.normal(size=(n, 24)))])
        return matching.match_work(df, df, 0.3, block_rows=16).first().copies / n

    assert work(1600) <= 1.5 * work(400)
    assert matching._block_size(400, 64) == 64 and matching._block_size(10**9, 64) == matching.BLOCK_ROWS
