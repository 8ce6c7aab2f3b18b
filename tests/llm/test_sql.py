"""Every query of the subpackage that has SQL against it."""

import duckdb
import pytest

from cartolith.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    got = con.execute(queries.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted(repr([r[names.index(c)] for c in sorted(names)]) for r in got.fetchall())
    assert sorted(repr([r[c] for c in sorted(names)]) for r in df.collect()) == expected
