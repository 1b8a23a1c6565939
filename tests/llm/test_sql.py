"""The queries with SQL equal DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tessera.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    want = sorted(tuple(r[cols.index(c)] for c in sorted(cols)) for r in cur.fetchall())
    assert sorted(tuple(r[c] for c in sorted(cols)) for r in df.collect()) == want
