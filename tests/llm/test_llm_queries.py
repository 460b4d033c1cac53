"""The registered queries against their oracles, and the names that they must have."""

from __future__ import annotations

import pytest
from fixtures import FOLDER
from oracle import compare, connect

import __spark_entry__ as entry
from featloom.llm.queries import ORACLES, QUERIES


def test_one_query_per_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", ORACLES)
def test_oracle(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, QUERIES[name], ORACLES[name]) is None
