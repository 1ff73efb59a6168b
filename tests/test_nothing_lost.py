import os

import pytest

import __spark_entry__ as contract
from peerlens.runtime import table

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
def test_what_the_stream_leaves_out_is_a_reject(spark):
    rows = table(spark, DATA, "sealed").select("row_id", "ts_us").collect()
    got = contract.queries()["stm01_rejects"](spark, DATA).collect()
    want = [r["row_id"] for r in rows if r["ts_us"] is None]
    assert want and sorted(want) == sorted(r["row_id"] for r in got)
