"""Registered queries against their oracles.  Inferred attributes are those of this size."""

from __future__ import annotations

import pathlib

import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from workload import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.01"

# These train many models; tests/test_learning.py covers what they do on small fixtures.
SLOW = {"train_predict_labels", "boruta_select", "prediction_impacts"}

pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="tables are not available")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, connection, name):
    sql = ORACLES.get(name)
    if sql is None:
        assert QUERIES[name](spark, FOLDER).count() > 0
    else:
        assert compare(spark, connection, FOLDER, QUERIES[name], sql) is None


def test_entry(spark):
    flagship = entry.entry(spark)
    assert flagship.columns[0] == "custkey" and flagship.count() == 150


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
