"""Search through trigrams against a scan of all texts."""

import os

import pytest
from pyspark.sql import functions as F

from storyloom.operators import listing, search_index
from storyloom.session import shared_folder

TEXTS = [
    "Hello World", "hello_world", "100% sure", "back\\slash", "x", None, "", "ΟΔΟΣ street", "İstanbul nights", "naïve Café",
    "日本語のテキスト", "tab\tand\nnewline here", "aaaa", "abcabc", "50 percent", "ab", "😀😀😀 smile", "HELLO", "worldly hello",
]
TERMS = [
    "hello", " HELLO ", "o_w", "hel%wor", "100%", r"100\%", r"back\slash", r"back\\slash", "lo_", "xy", "aaaa", "aaa", "bca",
    "οδος", "ΟΔΟΣ", "istanbul", "İst", "CAFÉ", "テキスト", "and\nnew", "😀😀😀", "%%%", "___", "absent term", "percent\\", "q", None, "  ",
]
SCHEMA = "id long, title string, summary string, full_content string, url string"


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (i * 7 - 20, TEXTS[i % 19], TEXTS[(i * 3) % 19] if i % 4 else None, f"{TEXTS[(i * 5) % 19]} and {TEXTS[(i * 11) % 19]}", f"https://h{i % 3}.example/a_{i}")
        for i in range(200)
    ]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def index(spark, rows):
    path = shared_folder(spark, "search").removeprefix("file:")
    search_index.write_index(rows.filter("id < 700"), path, range_ids=100)
    search_index.write_index(rows.filter("id >= 700"), path, range_ids=100)
    return path


@pytest.mark.parametrize("term", TERMS)
def test_search_finds_what_a_scan_finds(spark, rows, index, term):
    want = {r.id for r in listing.search(rows, term).select("id").collect()}
    found = [r.id for r in search_index.indexed_search(spark, index, rows.schema, term, 100).select("id").collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_url_patterns(spark, rows):
    path = shared_folder(spark, "urls")
    search_index.write_index(rows, path, columns=["url"])
    for pattern in ("H1.EXAMPLE", "a_1", "a\\_1", "/a_", "%7", "h"):
        want = {tuple(r) for r in listing.url_pattern_match(rows, pattern).collect()}
        assert {tuple(r) for r in search_index.indexed_url_match(spark, path, rows.schema, pattern).collect()} == want


def test_only_folders_with_candidates_are_read(spark, rows):
    path = shared_folder(spark, "search").removeprefix("file:")
    marked = rows.withColumn("title", F.when(F.col("id") == 421, "a needle here").otherwise(F.col("title")))
    search_index.write_index(marked, path, range_ids=100)
    folders = [f for f in os.listdir(f"{path}/rows") if f.startswith("id_range=")]
    assert len(folders) > 10
    for folder in folders:
        if folder != "id_range=4":
            for name in os.listdir(f"{path}/rows/{folder}"):
                if name.endswith(".parquet"):
                    with open(f"{path}/rows/{folder}/{name}", "wb") as f:
                        f.write(b"not a table")
            for name in os.listdir(f"{path}/rows/{folder}"):
                if name.endswith(".crc"):
                    os.remove(f"{path}/rows/{folder}/{name}")
    found = search_index.indexed_search(spark, path, rows.schema, "Needle", 100)
    assert [r.id for r in found.collect()] == [421]
    with pytest.raises(Exception):
        search_index.indexed_search(spark, path, rows.schema, "e", 100).collect()
        search_index.indexed_search(spark, path, rows.schema, "he", 100).collect()


def test_trigrams_are_read_by_slot_and_value(spark, rows, index):
    plan = search_index.candidates(spark, index, ["hel", "ell"])._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "slot#" in scan.split("PartitionFilters")[1].split("PushedFilters")[0] and "In(gram, [" in scan


def test_replaced_rows_are_found_by_their_new_texts_only(spark, rows):
    path = shared_folder(spark, "search").removeprefix("file:")
    search_index.write_index(rows, path, range_ids=100)
    untouched = {f: sorted(os.listdir(f"{path}/rows/{f}")) for f in os.listdir(f"{path}/rows") if f.startswith("id_range=") and f != "id_range=1"}
    changed = rows.filter("id IN (106, 113)").withColumn("title", F.lit("Quetzal")).withColumn("full_content", F.lit(None).cast("string"))
    search_index.replace_rows(changed, path, range_ids=100)
    now = rows.filter("id NOT IN (106, 113)").unionByName(changed)
    for term in ("quetzal", "hello", "and", "slash"):
        want = {r.id for r in listing.search(now, term).collect()}
        assert {r.id for r in search_index.indexed_search(spark, path, rows.schema, term, 100).collect()} == want
    assert untouched == {f: sorted(os.listdir(f"{path}/rows/{f}")) for f in untouched}


def test_literal_runs():
    assert search_index.literal_runs(r"%ab_c\%d%%\\e%") == ["ab", "c%d", "\\e"]
