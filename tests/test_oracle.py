"""Spark result == DuckDB oracle SQL on the smallest test tables, for a representative subset
(``python tests/run_oracle.py`` runs every registered query at sf0.01)."""

import pytest

from harness import compare, duck

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
SUBSET = ["order_lines", "customer_features", "segment_profile", "segment_category_share", "quarterly_top_products",
          "global_summary", "winsorize", "davies_bouldin", "top_per_segment", "tag_intents", "link_sends",
          "segment_zscores", "unpivot_items", "fix_rounding_drift"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_oracle(spark, con, name):
    ok, info = compare(E.queries()[name](spark, SF), E.oracle_sql()[name], con)
    assert ok, info


def test_every_query_has_a_callable_and_sql_keys_subset():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 150


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 4 and "n" in df.columns
