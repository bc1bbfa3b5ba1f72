"""Every registered query runs on the smallest tables; SQL-expressible ones
match the DuckDB oracle row for row."""

import math
from collections import Counter

import duckdb
import pytest

from refract.plans import catalog
from refract.sources.tables import TABLES

from sample_dirs import SF_SMALL

catalog.load_all()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = catalog.QUERIES[name](spark, SF_SMALL)
    cols = df.columns
    rows = Counter(tuple(_norm(x) for x in r) for r in df.collect())
    sql = catalog.ORACLE.get(name)
    if sql is None:
        assert sum(rows.values()) > 0
        return
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(ocols)
    idx = [ocols.index(c) for c in cols]
    orows = Counter(tuple(_norm(r[i]) for i in idx) for r in cur.fetchall())
    assert rows == orows
