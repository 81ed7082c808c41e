"""The stages on the smallest data set against brute force, and rules that hold for all queries."""

import re
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from corpus import COLUMNS, ODD, SF, docs
from storyloom.llm import quality
from storyloom.llm.queries import ORACLES, QUERIES
from test_lines import brute as line_brute
from test_simhash import five, grouped

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What every stage read and wrote."""
    folder = tmp_path_factory.mktemp("pipeline")
    before, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, SF).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out[name] = (before, after)
        before = after
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing",
    ]
    for name in list(stages)[:-1]:
        before, after = stages[name]
        assert after.dtypes == before.dtypes == [tuple(c.split()) if c.split()[1] != "long" else (c.split()[0], "bigint") for c in COLUMNS.split(", ")]


def test_quality_stage_drops_what_the_operator_rejects(spark, stages):
    before, after = stages["quality_rules"]
    forest = quality.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in quality.judge(before, forest).collect() if r.kept}
    assert {r.doc_id for r in after.collect()} == want
    assert 0 < len(want) < before.count()


def test_line_stage(stages):
    before, after = ({r.doc_id: r for r in df.collect()} for df in stages["line_dedup"])
    ids = sorted(before)
    want = line_brute([before[i].text for i in ids], 10)
    assert {i: after[i].text for i in ids} == {i: t for i, (_, _, t) in zip(ids, want)}
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_near_duplicate_stage(stages):
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in stages["simhash_near_dedup"])
    sets = {i: five(t) for i, t in before.items()}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert set(after) == set(grouped(sets, near).values())
    assert all(before[i] == t for i, t in after.items())


def test_mixing_stage(stages):
    before, after = stages["source_mixing"]
    texts = {r.doc_id: r.text for r in before.collect()}
    copies = Counter(r.doc_id for r in after.collect())
    assert max(copies.values()) <= 3 and set(copies) <= set(texts)
    assert all(r.text == texts[r.doc_id] for r in after.collect())


def test_packing_stage(stages):
    before, after = stages["best_fit_packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    filled = Counter()
    for r in after.collect():
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048


def test_every_stage_takes_odd_rows(spark, stages):
    odd = docs(spark, [*ODD, "x y", "x y"], ids=[*range(len(ODD)), None, None], sources=[None, *["s"] * (len(ODD) + 1)])
    for frame in (odd, odd.filter("false")):
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, frame, SF).collect()
            assert (len(rows) > 0) == (frame is odd and name != "quality_rules"), name


def test_all_operators_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["op2_secret_scan", "op4_document_fingerprints", "op9_mixing"])
def test_native_queries_run_no_python(spark, name):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().explainString(mode)
    assert not re.search("Python|Pandas|Arrow", plan)
    source = {"op2": "secret_scan", "op4": "fingerprints", "op9": "mixing"}[name.split("_")[0]]
    assert not re.search(r"udf|in_batches|mapIn|applyIn|\.rdd|toPandas", (ROOT / f"storyloom/llm/{source}.py").read_text())


def test_nothing_outside_imports_the_corpus_operators():
    for path in (ROOT / "storyloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "storyloom.llm" not in path.read_text(), path
    for path in (ROOT / "storyloom/llm").glob("*.py"):
        assert not re.search("localCheckpoint|crossJoin|except ImportError", path.read_text()), path
