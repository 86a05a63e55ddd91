"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import math
import os
from collections import Counter

import pytest

from folia.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{small}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return round(float(value), 5)
    return str(value)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, small, duck, name):
    got = catalogue.QUERIES[name](spark, small)
    want = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert bag(got.columns, [tuple(r) for r in got.collect()]) == bag(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).limit(5).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.count() > 0 and rows.columns == ["doc_id", "page_num", "chunk_index", "coverage", "reason"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
