"""Every registered key with an oracle: Spark result == DuckDB result (sf0.001),
compared like the driver does (names sorted, rows as a multiset)."""

import pytest

import __spark_entry__ as E
from ledgerlens.plans.registry import oracle_queries, spark_queries
from oracle import compare, duck

SF = "/root/testdata/sf0.001"
ORACLE = oracle_queries()   # the optional operators have their own tests


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_key_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF)
    r = compare(df, con, ORACLE[key])
    assert r["names"], (r["s_names"], r["d_names"])
    assert r["rows"][0] == r["rows"][1]
    assert r["values"], (r["s_sample"], r["d_sample"])


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 15
    assert {"customer_id", "anomaly_score", "risk_level", "escalation_action"} <= set(df.columns)


def test_rows_only_keys_run(spark):
    for key in sorted(set(spark_queries()) - set(ORACLE)):
        assert E.queries()[key](spark, SF).count() >= 0
