import os

import pytest

duckdb = pytest.importorskip("duckdb")
from peerlens.llm import queries  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = {tuple(str(v) for v in r) for r in df.collect()}
    if name in queries.ORACLES:
        c = duckdb.connect()
        for f in os.listdir(DATA):
            c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
        done = c.execute(queries.ORACLES[name])
        assert [d[0] for d in done.description] == df.columns
        assert rows == {tuple(str(v) for v in r) for r in done.fetchall()}
