"""Every query against its SQL."""

from __future__ import annotations

import duckdb
import pytest

from codeloom import catalog, code_queries, text_queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def plain(x):
    return f"{x:.5f}" if isinstance(x, float) or type(x).__name__ == "Decimal" else str(x)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_like_sql(spark, small, con, name):
    df = catalog.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    result = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())
