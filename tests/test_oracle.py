"""Every registered query against its SQL, at the smallest scale."""

import duckdb
import pytest

from quarry.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted([tuple(r[i] for i in order) for r in data], key=lambda r: [(x is None, 0 if x is None else x) for x in r])


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    cur = con.execute(sql)
    columns = [x[0] for x in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, cur.fetchall())


def test_recall_of_the_index(spark):
    """At least 0.9 of the ten nearest by an exact search."""
    from pyspark.sql import functions as F

    from quarry.operators import search
    from quarry.plans import tables

    sf = "/root/testdata/sf0.01"
    found = {(r["query_id"], r["id"]) for r in registry.queries()["ivf_probe"](spark, sf).collect()}
    exact = search.knn(tables.vectors(spark, sf), tables.asked_twice(spark, sf), k=10).where(F.col("rank") <= 10)
    true = {(r["query_id"], r["id"]) for r in exact.select("query_id", "id").collect()}
    assert len(found & true) >= 0.9 * len(true) > 0
