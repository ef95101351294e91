"""Every query of the subpackage that has an oracle, against DuckDB on the smallest scale."""

import pytest

from ledgerlens.llm.queries import ORACLE_SQL, QUERIES
from oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_matches_duckdb(spark, key):
    r = compare(QUERIES[key](spark, SF), duck(SF), ORACLE_SQL[key])
    assert r["names"], (r["s_names"], r["d_names"])
    assert r["values"], (r["s_sample"], r["d_sample"])
