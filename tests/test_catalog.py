"""Every query of the library against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from kestrix.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    # -0.0 and 0.0 are one value
    clean = [tuple(r[i] + 0.0 if isinstance(r[i], float) else r[i] for i in order) for r in rows]
    return [columns[i] for i in order], sorted(clean, key=lambda r: [(v is None, v) if not isinstance(v, float) or not math.isnan(v) else (True, 0) for v in r])


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    out = db.execute(catalog.ORACLES[name])
    want = table([d[0] for d in out.description], out.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    bad = [(a, b) for a, b in zip(got[1], want[1]) if not all(math.isclose(x, y, rel_tol=0, abs_tol=2e-6) if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b))]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1 and set(entry.oracle_sql()) <= set(entry.queries())
