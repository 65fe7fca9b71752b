"""Every query of the reference's own operators against its SQL, on the smallest tables, and again on tables dealt over other partitions."""

import duckdb
import pytest

from __spark_entry__ import entry
from clausework.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([text(x) for x in v])
    return str(v)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(tuple(text(x) for x in r) for r in df.select(*[f"`{c}`" for c in names]).collect())


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, con, name):
    got = rows_of(QUERIES[name](spark, sf))
    r = con.execute(SQL[name])
    order = sorted(range(len(r.description)), key=lambda i: r.description[i][0])
    want = sorted(tuple(text(x[i]) for i in order) for x in r.fetchall())
    assert got == ([r.description[i][0] for i in order], want)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_names():
    assert set(SQL) <= set(QUERIES)
