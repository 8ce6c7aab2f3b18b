"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from cartolith.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    got = duck.execute(SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    expected = sorted(repr([plain(r[names.index(c)]) for c in order]) for r in got.fetchall())
    assert sorted(repr([plain(r[c]) for c in order]) for r in rows) == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert os.path.exists(entry.ROOT)
