import duckdb
import pytest
from tidebar.plans import registry

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name not in registry.SQL:
        assert len(got)
        return
    want = con.sql(registry.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    keys = [c for c in columns if got[c].dtype != "float64"] + [c for c in columns if got[c].dtype == "float64"]
    a, b = (x[columns].sort_values(keys).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b)
    for c in columns:
        assert ((a[c].astype(str) == b[c].astype(str)) | (a[c].isna() & b[c].isna())).all(), c


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(5).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
