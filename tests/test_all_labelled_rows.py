"""Sets and coverage over every embedding, not over ids of one parity."""

import os

import pytest

import __spark_entry__ as contract
from peerlens.runtime import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
QUERIES = contract.queries()


def test_every_embedding_has_a_set(spark):
    rows = table(spark, DATA, "embeddings").select("vec_id", "label", "embedding").collect()
    got = {r["id"]: r for r in QUERIES["mdl02_all_sets"](spark, DATA).collect()}
    assert sorted(got) == sorted(r["vec_id"] for r in rows)
    assert all(got[r["vec_id"]]["label"] is not None for r in rows)
    known = [r for r in rows if r["label"] is not None and r["embedding"]]
    assert sum(r["is_calibration"] for r in got.values()) == len(known)
    cover = QUERIES["mdl06_coverage"](spark, DATA).collect()
    assert {r["truth"]: r["n"] for r in cover} == {y: sum((r["label"] % 2 == 0) == bool(y) for r in known) for y in (0, 1)}
    # the quantile of n scores at level 0.9 covers at least that share of them
    assert all(r["coverage"] >= 0.9 for r in cover)
