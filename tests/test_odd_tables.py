"""Queries against their SQL on tables that the driver's small ones don't show."""

import math

import duckdb
import pytest
from compare import TABLES, differences
from pyspark.sql import functions as F

from tidemark.plans import registry, reports, rules

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def tables(tmp_path):
    """A folder of the small tables in which some are replaced by what SQL selects."""

    def make(**other):
        for t in TABLES:
            if t in other:
                duckdb.connect().execute(f"COPY ({other[t]}) TO '{tmp_path}/{t}.parquet'")
            else:
                (tmp_path / f"{t}.parquet").symlink_to(f"{SMALL}/{t}.parquet")
        return str(tmp_path)

    return make


def test_codes_of_more_than_six_digits(spark, tables):
    at = tables(part=f"SELECT p.* REPLACE (k AS p_partkey) FROM (SELECT * FROM '{SMALL}/part.parquet' LIMIT 1) p, (SELECT unnest([0, 7, 100000, 100001, 999998, 1000000, 1000001, 1000002, 1000008, 1199998]) AS k)")
    assert differences(spark, registry.QUERIES, registry.ORACLE_SQL, at, ["codes_from_names"]) == {}


def test_no_signal_is_positive(spark, monkeypatch):
    """SQL's lift is 0 / 0 then, which is NaN: no side is favoured, and scores that take the lift are NaN."""
    never = {n: (lambda *a, f=getattr(m, n): f(*a).withColumn(rules.Y, F.lit(False))) for m, n in ((rules, "split_rows"), (reports, "signal_rows"))}
    monkeypatch.setattr(rules, "split_rows", never["split_rows"])
    monkeypatch.setattr(reports, "signal_rows", never["signal_rows"])
    assert rules.inferred_ops(spark, SMALL).collect() == []
    rows = reports.rule_scores(spark, SMALL).collect()
    assert rows and all(math.isnan(r.stop_avoid) and math.isnan(r.broad) and r.walk_forward == 0 for r in rows)
