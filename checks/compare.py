"""Run registered queries against their SQL and report differences.

``python -m checks.compare [sf_dir] [query ...]``
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

from checks import oracle, queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        if Path(f"{sf_dir}/{table}.parquet").exists():
            connection.execute(
                f"create view {table} as select * from '{sf_dir}/{table}.parquet'"
            )
    return connection


def difference(name: str, frame: DataFrame, connection) -> str | None:
    """None when the rows of ``frame`` and of the SQL agree as multisets, else a report."""
    columns = sorted(frame.columns)
    mine = Counter(tuple(r[c] for c in columns) for r in frame.collect())
    result = connection.execute(oracle.statement(name))
    found = [d[0] for d in result.description]
    if sorted(found) != columns:
        return f"columns {columns} against {sorted(found)}"
    order = [found.index(c) for c in columns]
    theirs = Counter(tuple(row[i] for i in order) for row in result.fetchall())
    if mine == theirs:
        return None
    only_mine, only_theirs = mine - theirs, theirs - mine
    sample = [sorted(map(str, side))[:2] for side in (only_mine, only_theirs)]
    return (
        f"{sum(mine.values())} rows against {sum(theirs.values())}; differing "
        f"{sum(only_mine.values())}/{sum(only_theirs.values())}\n  "
        f"{columns}\n  " + "\n  ".join(line for side in sample for line in side)
    )


def main(sf_dir: str, names: list[str]) -> int:
    from pricewake.session import local_session

    spark, connection = local_session("8"), connect(sf_dir)
    failed = 0
    for name in names or list(oracle.BODIES):
        start = time.time()
        try:
            problem = difference(name, queries.run(name, spark, sf_dir), connection)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s", flush=True)
        if problem:
            print("  " + problem, flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    arguments = sys.argv[1:] or ["/root/testdata/sf0.01"]
    sys.exit(min(1, main(arguments[0], arguments[1:])))
