"""Every query with an oracle equals DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return int(v) if type(v).__name__ == "Decimal" and v == int(v) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    cur = duck.execute(registry.ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(cols) == sorted(df.columns)
    key = sorted(cols)
    a = sorted(repr([norm(r[c]) for c in key]) for r in got)
    b = sorted(repr([norm(r[cols.index(c)]) for c in key]) for r in want)
    assert a == b
