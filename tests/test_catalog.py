"""Every registered query against its SQL on the smallest data set, and house rules for the sources."""

import re
from pathlib import Path

import pytest

import oracle
from __spark_entry__ import entry
from storyloom.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert oracle.compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF) == ""


def test_entry(spark):
    assert entry(spark).count() > 0


def test_null_order_is_always_explicit():
    bare = re.compile(r"\.(desc|asc)\(\)")
    found = [p.name for p in (ROOT / "storyloom").rglob("*.py") if bare.search(p.read_text())]
    assert found == []


def test_no_clock_and_no_local_checkpoint():
    for p in (ROOT / "storyloom").rglob("*.py"):
        text = p.read_text()
        assert "localCheckpoint" not in text and "current_timestamp" not in text and "datetime.now" not in text, p.name
