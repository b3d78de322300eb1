"""Every library query with an SQL form against DuckDB on the smallest tables; the others must give rows."""

import os

import duckdb
import pytest

from tarn import queries as library

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def norm(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(norm, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(library.QUERIES))
def test_query(spark, duck, name):
    df = library.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in library.SQL:
        assert got
        return
    r = duck.execute(library.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["query_id", "doc_id", "score", "rank"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
