"""Compare registered queries with their SQL run by DuckDB on the same files.

    python tests/oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


EXACT = bool(os.environ.get("ORACLE_EXACT"))  # compare doubles to the last bit


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v if EXACT else float(f"{v:.10g}")
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, query, sql: str | None, sf_dir: str, seconds: list | None = None) -> str:
    """Empty when equal, else what differs."""
    start = time.monotonic()
    df = query(spark, sf_dir)
    mine = [tuple(r) for r in df.collect()]
    if seconds is not None:
        seconds.append(time.monotonic() - start)
    if sql is None:
        return "" if df.columns else "no columns"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, mine), rows_of(names, theirs)
    if a == b:
        types = {c[0]: str(c[1]) for c in cur.description}
        odd = {c: types[c] for c, t in df.dtypes if types[c] != _DUCK.get(t, types[c])}
        return f"types {odd} for {dict(df.dtypes)}" if odd else ""
    extra, missing = list((a - b).items())[:2], list((b - a).items())[:2]
    return f"{len(mine)} rows vs {len(theirs)}; only here {str(extra)[:600]}; only in SQL {str(missing)[:600]}"


_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def main(sf_dir: str, names: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from storyloom.session import build_session

    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                   "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), oracle_sql(), 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        start, spent = time.monotonic(), []
        try:
            diff = compare(spark, con, name, query, sqls.get(name), sf_dir, spent)
        except Exception as exc:  # report and go on with the others
            diff = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += bool(diff)
        mark = "DIFF" if diff else ("ok" if name in sqls else "rows")
        print(f"{mark:5} {name:28} spark {sum(spent):6.2f}s all {time.monotonic() - start:6.2f}s {diff}", flush=True)
    print(f"{bad} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]))
