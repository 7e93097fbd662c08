"""Every registered query against its DuckDB SQL, and the driver contract."""

from __future__ import annotations

import pytest
from oracle import differences

import __spark_entry__ as contract
from trialspark.bindings import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= contract.queries().items()
    assert ORACLES.items() <= contract.oracle_sql().items()


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert sum(row["n"] for row in rows) == spark.read.parquet(f"{FOLDER}/customer.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert differences(spark, FOLDER, name) is None
