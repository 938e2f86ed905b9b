"""Every registered query with an oracle equals DuckDB at sf0.01."""

import pytest

import __spark_entry__ as entry_mod
from tests.conftest import SF01
from tests.harness import compare, rows_of

ORACLES = entry_mod.oracle_sql()
QUERIES = entry_mod.queries()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_duckdb(spark, duck01, key):
    got = rows_of(QUERIES[key](spark, SF01))
    want = duck01.execute(ORACLES[key]).df()
    diff = compare(got, want)
    assert diff is None, f"{key}: {diff}"


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) == 106  # days with both vectors and a next bar at sf0.001
    assert set(df.columns) >= {"series", "day", "n_items", "v", "label"}
