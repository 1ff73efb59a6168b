"""Every query against its SQL twin on the smallest tables, or for its shape where there is none."""

import decimal
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as contract  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()
CORE = sorted(n for n, f in QUERIES.items() if not getattr(f, "from_llm", False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def compare(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted([plain(r[c]) for c in cols] for r in df.collect())
    if name not in ORACLES:
        assert len(set(cols)) == len(cols)
        return
    done = duck.execute(ORACLES[name])
    theirs = [d[0] for d in done.description]
    assert sorted(theirs) == cols
    want = sorted([plain(r[theirs.index(c)]) for c in cols] for r in done.fetchall())
    assert rows == want


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    compare(spark, duck, name)


def test_every_oracle_has_a_query():
    assert not [n for n in ORACLES if n not in QUERIES]


def test_entry(spark):
    assert contract.entry(spark).count() > 0
