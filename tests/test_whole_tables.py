"""Queries that must answer for every row of their table."""

import os

import pytest

import __spark_entry__ as contract
from peerlens.plans import scoring

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
QUERIES = contract.queries()


def test_trained_ensemble_scores_every_candidate(spark):
    got = QUERIES["org09_trained_ensemble"](spark, DATA).collect()
    want = {tuple(r) for r in scoring.candidates(spark, DATA).select("txid", "peer_ip").collect()}
    assert want and len(got) == len(want) and {(r["txid"], r["peer_ip"]) for r in got} == want
    assert all(0 <= r["p_origin"] <= 1 for r in got)
