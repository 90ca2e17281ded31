"""Each query with SQL against DuckDB on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in os.listdir(SF):
        f = f"{SF}/{p}"
        c.execute(f"create view {p.split('.')[0]} as select * from '{f + '/*.parquet' if os.path.isdir(f) else f}'")
    return c


def _plain(rows):
    return sorted((tuple(round(float(x), 6) if type(x).__name__ in ("float", "Decimal") else x for x in r) for r in rows), key=str)


from tidegraph.plans import registry  # noqa: E402


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, db, name):
    df = registry.queries()[name](spark, SF)
    got = db.execute(registry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    assert _plain(df.collect()) == _plain([tuple(r[i] for i in at) for r in got.fetchall()])


def test_entry_imports():
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
