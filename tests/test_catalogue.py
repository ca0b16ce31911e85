"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from strandspark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(cell, v)) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(spark, duck, query, sql):
    df = query(spark, SF)
    names = sorted(df.columns)
    found = duck.execute(sql)
    have = [c[0] for c in found.description]
    assert sorted(have) == names
    at = [have.index(c) for c in names]
    assert Counter(tuple(map(cell, r)) for r in df.select(names).collect()) == Counter(tuple(cell(r[i]) for i in at) for r in found.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    if name in catalogue.ORACLE_SQL:
        same(spark, duck, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])
    else:
        assert catalogue.QUERIES[name](spark, SF).count() > 0
