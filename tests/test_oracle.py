"""Every query that has SQL gives the same rows in both engines, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from planwright.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    show = lambda v: "-" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = df.collect()
    c = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in c.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, c.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
