"""Every query with SQL agrees with it; every other query gives named rows of one schema."""

import pytest
from compare import differences

import __spark_entry__ as entry
from tidemark.plans import registry

SMALL = "/root/testdata/sf0.001"
SQL = sorted(registry.ORACLE_SQL)
ROWS = sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL))


@pytest.mark.parametrize("part", range(4))
def test_queries_agree_with_their_sql(spark, part):
    assert differences(spark, registry.QUERIES, registry.ORACLE_SQL, SMALL, SQL[part::4]) == {}


#: Those that mine are held against plain versions in test_mined.py and test_avoid.py, where there is enough to mine.
MINE = {"beam_search_full_size", "leave_one_feature_out", "heap_miner_stop", "heap_miner_no_bounce", "stop_scenarios", "no_bounce_scenarios", "broad_scenarios", "simplified_rules", "exported_styles", "beam_search", "or_sets_exhaustive", "or_sets_greedy", "portfolio_diversified", "preset_search", "final_filter", "good_scenarios"}


@pytest.mark.parametrize("name", sorted(set(ROWS) - MINE))
def test_queries_without_sql_are_repeatable(spark, name):
    first, second = (registry.QUERIES[name](spark, SMALL) for _ in range(2))
    assert first.schema == second.schema and len(set(first.columns)) == len(first.columns)
    assert sorted(map(str, first.collect())) == sorted(map(str, second.collect()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
