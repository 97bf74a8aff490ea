"""Every registered query against its DuckDB oracle (driver's gate, sf0.001 so
the suite stays quick; the driver itself checks sf0.01)."""

import os

import pytest

import __spark_entry__ as entry
from cribra.plans import table_jobs  # noqa: F401  (registers its queries)
from cribra.plans import table_queries as tq
from oracle import compare

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(tq.ORACLE))
def test_query_matches_oracle(spark, name):
    r = compare(spark, name, SF)
    assert r["ok"], r.get("detail")


def test_every_query_has_an_oracle():
    assert set(tq.QUERIES) == set(tq.ORACLE)


def test_entry_registers_all_of_them():
    assert set(tq.QUERIES) <= set(entry.queries()) and set(tq.ORACLE) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and len(df.columns) > 0
