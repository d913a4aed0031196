"""Each query against its SQL on the smallest tables."""

import duckdb
import pytest
from weft.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    own = duckdb.connect()
    for name in TABLES:
        own.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return own


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_and_sql_agree(spark, con, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = con.sql(registry.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda d: sorted(tuple(None if v != v else round(float(v), 6) if isinstance(v, float) else str(v) for v in row) for row in d[columns].astype(object).where(d[columns].notna(), None).values.tolist())
    assert plain(got) == plain(want)


def test_flagship(spark):
    assert registry.flagship(spark, SF).columns == ["origin", "node", "kind", "distance"]


def test_entry_points_work_without_the_corpus_package(spark, monkeypatch):
    import sys

    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(__spark_entry__.queries()) == set(registry.QUERIES) and set(__spark_entry__.oracle_sql()) == set(registry.ORACLE_SQL)
