"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import duckdb
import pytest

from priceboard.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events pages".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v.isoformat()[:10] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    assert got
    if name in Q.SQL:
        r = duck.execute(Q.SQL[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        assert sorted((tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall()), key=str) == got
