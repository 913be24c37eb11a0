"""Every query of the engine against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera.queries import ORACLES, QUERIES, TABLES

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(map(plain, (dict(zip(names, r, strict=True))[c] for c in sorted(names)))) for r in cur.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(map(plain, (r[c] for c in sorted(names)))) for r in df.collect()) == want
