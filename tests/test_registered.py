"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from checks.compare import compare
from checks.oracles import ORACLES
from checks.queries import QUERIES
from tests.conftest import tx  # noqa: F401  (the session fixture lives there)

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize(
    "name",
    [
        "sandwich_candidates_all", "sandwich_candidates_split", "sandwich_hot_pool", "roundtrips_many_chunks",
        "wash_trades_all", "clean_swaps", "validate_swaps", "normalise_raw_swaps", "percentile_brackets",
        "detection_metrics", "top20_sandwiches", "candidates_to_table",
    ],
)
def test_query_equals_sql(spark, name):
    assert compare(spark, FOLDER, name) is None


def test_entry(spark):
    assert contract.entry(spark).count() == 8
