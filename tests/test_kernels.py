import os

import pytest

from strandflow.plans import kernels

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def same_rows(spark_rows, duck_rows):
    norm = lambda rows: sorted(repr(tuple(r)) for r in rows)
    return norm(spark_rows) == norm(duck_rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(kernels.ORACLE_SQL))
def test_kernel_equals_its_sql(spark, con, name):
    df = kernels.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(cols)} from ({kernels.ORACLE_SQL[name]})").fetchall()
    assert same_rows(df.select(*cols).collect(), want)


def test_every_query_has_sql():
    assert set(kernels.QUERIES) == set(kernels.ORACLE_SQL)
