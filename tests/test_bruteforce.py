"""Skew-safe plans (bucketed windows, range join, two-level gaps) against naive
definitions on a random ledger where one customer holds a third of the rows."""

import datetime as dt
import random

import pandas as pd
import pytest

from ledgerlens.config import RiskConfig
from ledgerlens.operators import features as A

SCHEMA = ("transaction_id string, customer_id string, timestamp timestamp_ntz, amount double, "
          "transaction_type string, is_cash boolean")


@pytest.fixture(scope="module")
def ledger():
    rng = random.Random(7)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(1500):
        cust = "HOT" if i % 3 == 0 else f"C{rng.randint(0, 40)}"
        ts = t0 + dt.timedelta(seconds=rng.randint(0, 60 * 86400))
        if rng.random() < 0.05 and rows:          # exact duplicates of an earlier timestamp
            ts = rows[-1][2]
        amt = rng.choice([round(rng.uniform(8000, 9999.99), 2), round(rng.uniform(1, 30000), 2), 8000.0, 10000.0])
        typ = rng.choice(["deposit", "withdrawal", "transfer", "wire_transfer"])
        rows.append((f"t{i}", cust, ts, amt, typ, rng.random() < 0.6))
    return rows


def brute(rows, cfg):
    df = pd.DataFrame(rows, columns=["tid", "cust", "ts", "amount", "type", "cash"])
    out = {}
    for c, g in df.groupby("cust"):
        g = g.sort_values("ts")
        near = g[g.cash & (g.amount >= cfg.structuring_lower) & (g.amount < cfg.ctr_threshold)].ts.tolist()
        win = dt.timedelta(days=cfg.structuring_window_days)
        cluster = max((sum(1 for u in near if t <= u <= t + win) for t in near), default=None)
        deps = g[(g.type == "deposit") & (g.amount >= cfg.rapid_min_deposit)]
        outs = g[g.type.isin(["transfer", "wire_transfer"])]
        h = dt.timedelta(hours=cfg.rapid_hours)
        rapid = sum(int(((outs.ts > d.ts) & (outs.ts <= d.ts + h) & (outs.amount >= d.amount * cfg.rapid_ratio)).sum())
                    for d in deps.itertuples())
        gaps = g.ts.diff().dropna()
        out[c] = {"cluster": cluster, "rapid": rapid,
                  "min_gap_h": gaps.min().total_seconds() / 3600 if len(g) > 1 else 999.0,
                  "dormant": int(gaps.dt.days.max() >= cfg.dormancy_days) if len(g) > 1 else 0}
    return out


def one_day(n=900):
    """One customer with most rows, all within a day, some at the very same time; few others."""
    rng = random.Random(3)
    t0 = dt.datetime(2024, 3, 5)
    rows = []
    for i in range(n):
        cust = f"C{i % 9}" if i % 8 == 0 else "HOT"
        ts = t0 + dt.timedelta(microseconds=rng.choice([5, rng.randint(0, 30), rng.randint(0, 86_399_999_999)]))
        rows.append((f"t{i}", cust, ts, rng.choice([9000.0, 6000.0, round(rng.uniform(5000, 30000), 2)]),
                     rng.choice(["deposit", "deposit", "transfer", "wire_transfer", "withdrawal"]), rng.random() < 0.6))
    return rows


def days_apart(n=600):
    """Several days and week borders, so that windows reach over slabs and buckets."""
    rng = random.Random(5)
    t0 = dt.datetime(1969, 12, 20)
    return [(f"t{i}", "HOT" if i % 3 else f"C{i % 7}", t0 + dt.timedelta(hours=rng.randint(0, 40 * 24)), rng.choice([8000.0, 9999.99, 10000.0, 14000.0, 20000.0]),
             rng.choice(["deposit", "transfer", "wire_transfer"]), rng.random() < 0.5) for i in range(n)]


def median_of(rows, cust):
    return pd.Series([r[3] for r in rows if r[1] == cust]).median()


@pytest.mark.parametrize("heavy_rows", [100_000, 20, 0], ids=["whole", "hot-cut", "all-cut"])
@pytest.mark.parametrize("rows", ["mixed", "one-day", "days"])
def test_skew_safe_features_equal_brute_force(spark, ledger, rows, heavy_rows):
    data = {"mixed": ledger, "one-day": one_day(), "days": days_apart()}[rows]
    cfg = RiskConfig(rapid_min_deposit=5000.0, dormancy_days=3, heavy_rows=heavy_rows)
    tx = spark.createDataFrame(data, SCHEMA)
    ref = brute(data, cfg)
    cl = {r[0]: r[1] for r in A.structuring_cluster(tx, cfg).collect()}
    rp = {r[0]: r[1] for r in A.rapid_movement(tx, cfg).collect()}
    tm = {r["customer_id"]: r for r in A.engineer_features(tx, None, cfg, graph=False).collect()}
    assert set(tm) == set(ref)
    for c, want in ref.items():
        assert cl.get(c) == want["cluster"], c
        assert rp.get(c, 0) == want["rapid"], c
        assert tm[c]["min_gap_hours"] == pytest.approx(want["min_gap_h"]), c
        assert tm[c]["dormancy_flag"] == want["dormant"], c
        assert tm[c]["median_amount"] == pytest.approx(median_of(data, c)), c
    assert ref["HOT"]["rapid"] > 0 and ref["HOT"]["cluster"] > 3


def test_heavy_customers_are_found_and_few(spark):
    tx = spark.range(30_000).selectExpr("case when id % 3 = 0 then 'HOT' else concat('C', id) end as customer_id")
    assert [r[0] for r in A.heavy_customers(tx, RiskConfig(heavy_rows=100)).collect()] == ["HOT"]
    assert A.heavy_customers(tx, RiskConfig()).count() == 0
    even = spark.range(60_000).selectExpr("cast(id % 3000 as string) as customer_id")
    assert A.heavy_customers(even, RiskConfig(heavy_rows=10)).count() == 1024      # the rest have 1 in 1,024 of all rows at most
    assert A.heavy_customers(even, RiskConfig(heavy_rows=20)).count() == 0


def test_no_unit_holds_a_heavy_customer(spark):
    """A third of the ledger belongs to one customer on one day: what meets in one window, measured on the frames."""
    from pyspark.sql import functions as F

    from ledgerlens.functions import dominance

    tx = spark.range(60_000).selectExpr(
        "cast(id as string) as transaction_id", "case when id % 3 = 0 then 'HOT' else concat('C', id % 5000) end as customer_id",
        "timestampadd(MICROSECOND, case when id % 3 = 0 then xxhash64(id) % 40000000000 else id * 1000000 end, timestamp_ntz'2024-03-05 12:00:00') as timestamp",
        "8000.0D + abs(xxhash64(id, 1)) % 1999 as amount", "case when id % 2 = 0 then 'deposit' else 'transfer' end as transaction_type", "true as is_cash")
    cfg = RiskConfig(heavy_rows=1000, rapid_min_deposit=5000.0)
    largest = lambda df, *unit: df.groupBy(*unit).count().agg(F.max("count")).first()[0]
    assert largest(A.gap_units(tx, cfg), "customer_id", "slab") < 20_000 / 100
    assert largest(A.cluster_points(tx, cfg)[0], "customer_id", "slab") < 2 * 20_000 / 100
    seen = []
    real = dominance.count_pairs

    def spy(points, unit, *a, **k):
        seen.append((points, unit))
        return real(points, unit, *a, **k)
    A.count_pairs, keep = spy, A.count_pairs
    try:
        total = A.rapid_movement(tx, cfg).where("customer_id = 'HOT'").first()[1]
    finally:
        A.count_pairs = keep
    assert total > 20_000 and len(seen) == 3 and all(largest(p, *u) < 20_000 / 50 for p, u in seen[:2])
    assert largest(seen[2][0], *seen[2][1]) <= 3 * 256 * 256
