"""Every registered query outside the corpus operators against its DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest

from lectern.plans.catalog import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in ORACLE:
        assert df.columns
        return
    r = con.execute(ORACLE[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(x[columns.index(c)]) for c in sorted(columns)) for x in r.fetchall()), key=repr)
    got = sorted((tuple(plain(x[c]) for c in sorted(columns)) for x in rows), key=repr)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
