"""Plans whose figures must not outgrow the ledger: what is dropped, stored or joined how, on hand-made rows."""

from __future__ import annotations

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from ledgerlens.config import RiskConfig
from ledgerlens.operators import features as A
from ledgerlens.operators import graph as G
from ledgerlens.operators import risk as R
from ledgerlens.plans import compose as Q
from ledgerlens.sources import bindings as B

DAY = dt.datetime(2024, 1, 1)
TX = "transaction_id long, customer_id long, timestamp timestamp_ntz, amount double, transaction_type string, counterparty_id long, counterparty_country string, is_cash boolean"


def _joins(df):
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return plan.count("BroadcastHashJoin"), plan.count("SortMergeJoin"), plan.count("ShuffledHashJoin")


@pytest.fixture
def ledger(spark):
    rows = [(i, c, DAY + dt.timedelta(hours=7 * i), 9000.0 + i, "transfer" if i % 2 else "deposit", i % 4 if i % 2 else None, "XX", i % 3 == 0)
            for i, c in enumerate(itertools.islice(itertools.cycle([0, 1, 2, 3, 7, None]), 60))]
    return spark.createDataFrame(rows, TX)


def test_edges_on_no_cycle_are_dropped(spark):
    """Payers nobody pays and payees that pay nobody take part in no wedge; a chain of two behind them goes in the second round."""
    ring = [(0, 1), (1, 2), (2, 0), (2, 1)]
    payers = [(100 + i, i % 3) for i in range(50)]
    payees = [(i % 3, 200 + i) for i in range(50)]
    chain = [(300, 301), (301, 0), (0, 302), (302, 303), (5, 5)]
    edges = spark.createDataFrame(ring + payers + payees + chain, "src long, dst long")
    assert sorted(map(tuple, G.cycle_edges(edges).collect())) == sorted(ring)
    assert {(r.node, r.cycles) for r in G.cycle_counts(edges, 3).collect()} == {(0, 1), (1, 1), (2, 1)}
    assert {(r.node, r.circular_flow_count) for r in G.circular_flow(edges).collect()} == {(0, 1), (1, 2), (2, 2)}


def test_graph_without_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 3)], "src long, dst long")
    assert G.circular_flow(edges).collect() == []


def test_features_read_the_ledger_once(spark, ledger):
    """one family also stores its columns, so that a ledger that is a join is made once."""
    reads = spark.sparkContext.accumulator(0)

    def count(it):
        for b in it:
            reads.add(b.num_rows)
            yield b

    tx = ledger.mapInArrow(count, ledger.schema)
    for family in ("structuring", "behavioral", "core"):
        reads.value = 0
        A.engineer_features(tx, None, RiskConfig(), feature_set=family, graph=False).collect()
        assert reads.value == ledger.count()


def test_a_family_stores_its_own_columns(ledger):
    assert set(A.read_once(ledger, {"structuring"}).columns) == {"transaction_id", "customer_id", "timestamp", "amount", "is_cash"}
    assert set(A.read_once(ledger, {"behavioral"}).columns) == {"transaction_id", "customer_id", "timestamp", "amount", "transaction_type"}
    assert set(A.read_once(ledger, {*A.FAMILIES, "graph"}).columns) == {"transaction_id", *A.LEDGER_COLUMNS}


def test_frames_of_customers_are_not_broadcast(spark, ledger):
    """a row per customer on both sides is joined by hashed partitions."""
    customers = spark.createDataFrame([(0, "a", True, "expired"), (1, "b", False, "verified")], "customer_id long, name string, pep_flag boolean, kyc_status string")
    scores = spark.createDataFrame([(0, 0.4), (1, 0.2)], "customer_id long, anomaly_score double")
    feat = spark.createDataFrame([(0, 1, 2), (1, 0, 0)], "customer_id long, pep_flag int, kyc_status_encoded int")
    cls = R.classify_risk(scores, feat, customers)
    assert _joins(cls) == (0, 0, 2)
    assert _joins(A.enrich_customers(scores, customers)) == (0, 0, 1)
    hits = spark.createDataFrame([(0, 5)], "customer_id long, rapid_movement_count long")
    assert _joins(Q.pattern_search(hits, cls, "rapid", RiskConfig())) == (0, 0, 2)   # names, which it does not read, are not joined


def _tables(spark, at):
    """Tables of both bindings: keys that repeat or are null, counterparties without a customer."""
    w = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    w("nation", [(0, "N0", 0), (1, "N1", 0)], "n_nationkey int, n_name string, n_regionkey int")
    w("customer", [(1, 0), (2, 1), (2, 0), (3, None), (None, 1), *[(i, 1) for i in range(50, 90)]], "c_custkey long, c_nationkey int")
    w("orders", [(10, 1, "p"), (11, 2, "q"), (11, 3, "q"), (None, 4, "r")], "o_orderkey long, o_custkey long, o_orderpriority string")
    w("lineitem", [(10, 1, 1, 1, 5.0, "R", "F", DAY), (10, 1, 2, 2, 5.0, "R", "O", DAY), (11, 1, None, 1, 6.0, "A", "F", DAY),
                   (11, 2, 9, 2, 7.0, "N", "O", DAY), (None, 2, 1, 2, 7.0, "N", "O", DAY), (12, 2, 1, 2, 7.0, "N", "O", DAY)],
      "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")
    w("events", [(1, DAY, 1, "view", 2.0, '{"k": 1}'), (2, DAY, 2, "click", 2.0, '{"k": 2}'), (3, DAY, 2, "view", 2.0, None), (4, DAY, None, "error", 300.0, '{"k": 9}')],
      "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    return str(at)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_ledger_is_not_shuffled_for_the_country(spark, tmp_path, monkeypatch, most):
    """the country table holds the ledger's counterparties alone and is broadcast up to a number; beyond it the rows are the same."""
    at = _tables(spark, tmp_path)
    monkeypatch.setattr(B, "COUNTRY_ROWS", most)
    l, t = B.ledger_l(spark, at), B.ledger_t(spark, at)
    key = lambda r: (r.transaction_id, r.customer_id, r.counterparty_id, r.counterparty_country)
    assert sorted(map(key, l.collect()), key=str) == sorted([
        ("10-1-1-1", 1, 1, "N0"), ("10-2-1-2", 1, 2, "N0"), ("10-2-1-2", 1, 2, "N1"), ("11-1-1", 2, None, None), ("11-1-1", 3, None, None),
        ("11-2-2-9", 2, None, None), ("11-2-2-9", 3, None, None)], key=str)
    assert sorted(map(key, t.collect()), key=str) == sorted([(1, 1, 1, "N0"), (2, 2, None, "N0"), (2, 2, None, "N1"), (3, 2, None, None), (4, None, None, None)], key=str)
    named = B._customer_country(spark, at, spark.createDataFrame([(1,), (2,), (9,), (None,)], "k long"))
    assert named.count() == 3
    if most:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            assert _joins(l)[:2] == (1, 0) and _joins(t) == (1, 0, 0)
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
