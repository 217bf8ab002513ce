"""Every registered query that has an oracle, against DuckDB at the smallest scale."""

from __future__ import annotations

import os

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry
from curbflow.workload.trips import drop_layers

SF_DIR = "/root/testdata/sf0.001"
NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF_DIR):
        pytest.skip("driver tables are not here")
    return connect(SF_DIR)


@pytest.fixture(scope="module", autouse=True)
def tidy(spark):
    yield
    drop_layers(spark)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_oracle(spark, duck, name):
    frame = entry.queries()[name](spark, SF_DIR)
    assert compare(frame, duck, entry.oracle_sql()[name]) is None


def test_every_oracle_has_a_query_and_entry_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
