"""Hand-made micro tables for operator edge cases (SURVEY §5 'Ours' 2-4)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlens.config import RiskConfig
from ledgerlens.operators import features as A
from ledgerlens.operators import graph as G
from ledgerlens.operators import risk as R
from ledgerlens.operators import scoring as D
from ledgerlens.operators import feedback as H
from ledgerlens.operators import sampling as M
from ledgerlens.operators.iforest import isolation_forest_scores
from ledgerlens.sources import io

SCHEMA = ("transaction_id string, customer_id string, timestamp timestamp_ntz, amount double, "
          "transaction_type string, channel string, counterparty_id string, counterparty_country string, "
          "is_cash boolean")
T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def ledger(spark, rows):
    full = [(f"x{i}",) + r + (None,) * (8 - len(r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def by_id(df, col):
    return {r["customer_id"]: r[col] for r in df.collect()}


def test_structuring_cluster_window_is_inclusive(spark):
    d7 = dt.timedelta(days=7)
    rows = [("A", T0, 9000.0, "deposit", "branch", None, None, True),
            ("A", T0 + d7, 9000.0, "deposit", "branch", None, None, True),            # exactly 7 d: inside
            ("A", T0 + d7 + dt.timedelta(microseconds=1), 9000.0, "deposit", "branch", None, None, True),
            ("B", T0, 8500.0, "deposit", "branch", None, None, True)]
    out = by_id(A.structuring_cluster(ledger(spark, rows), RiskConfig()), "structuring_cluster_max")
    assert out == {"A": 2, "B": 1}


def test_near_ctr_band_half_open(spark):
    rows = [("A", T0, a, "deposit", "branch", None, None, True) for a in (7999.99, 8000.0, 9999.99, 10000.0)]
    rows.append(("A", T0, 9000.0, "deposit", "branch", None, None, False))  # not cash
    f = A.base_aggregates(ledger(spark, rows), RiskConfig()).first()
    assert f["cash_near_ctr_count"] == 2
    assert f["cash_near_ctr_total"] == pytest.approx(17999.99)


def test_single_row_customer_defaults(spark):
    rows = [("A", T0, 100.0, "deposit", "branch", None, None, True)]
    f = A.engineer_features(ledger(spark, rows), None, RiskConfig(), graph=False).first()
    assert f["std_amount"] == 0.0 and f["mean_gap_hours"] == 999.0 and f["min_gap_hours"] == 999.0
    assert f["dormancy_flag"] == 0 and f["near_ctr_avg_gap_hours"] == 0.0 and f["amount_cv"] == 0.0


def test_dormancy_whole_days(spark):
    rows = [("A", T0, 1.0, "deposit"), ("A", T0 + dt.timedelta(days=89, hours=23), 1.0, "deposit"),
            ("B", T0, 1.0, "deposit"), ("B", T0 + dt.timedelta(days=90), 1.0, "deposit")]
    out = by_id(A.timing_features(ledger(spark, rows), RiskConfig()), "dormancy_flag")
    assert out == {"A": 0, "B": 1}


def test_min_gap_across_days(spark):
    rows = [("A", dt.datetime(2024, 1, 1, 23, 59), 1.0, "deposit"),
            ("A", dt.datetime(2024, 1, 2, 0, 1), 1.0, "deposit"),
            ("A", dt.datetime(2024, 1, 2, 5, 0), 1.0, "deposit")]
    g = A.gap_extremes(ledger(spark, rows), RiskConfig()).first()
    assert g["min_gap_us"] == 2 * 60 * 1_000_000


def test_rapid_movement_boundaries(spark):
    h24 = dt.timedelta(hours=24)
    rows = [("A", T0, 20000.0, "deposit"),
            ("A", T0, 15000.0, "transfer"),                       # same instant: not after
            ("A", T0 + h24, 14000.0, "wire_transfer"),            # exactly 24 h, 0.7 x: counts
            ("A", T0 + h24 + dt.timedelta(microseconds=1), 19000.0, "transfer"),  # too late
            ("A", T0 + dt.timedelta(hours=1), 13999.0, "transfer"),  # below 0.7 x
            ("B", T0, 19999.0, "deposit"), ("B", T0 + dt.timedelta(hours=1), 19999.0, "transfer")]
    out = by_id(A.rapid_movement(ledger(spark, rows), RiskConfig()), "rapid_movement_count")
    assert out == {"A": 1}


def test_unusual_time(spark):
    rows = [("A", dt.datetime(2024, 1, 1, 5, 59), 1.0, "deposit"),   # Monday 05:59 -> unusual
            ("A", dt.datetime(2024, 1, 1, 22, 59), 1.0, "deposit"),  # 22h -> usual
            ("A", dt.datetime(2024, 1, 1, 23, 0), 1.0, "deposit"),   # 23h -> unusual
            ("A", dt.datetime(2024, 1, 6, 12, 0), 1.0, "deposit")]   # Saturday -> unusual
    f = A.base_aggregates(ledger(spark, rows), RiskConfig()).first()
    assert f["unusual_time_pct"] == 0.75


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_cycles_and_self_loops(spark):
    e = edges(spark, [("a", "a"), ("a", "b"), ("b", "a"),                       # self loop + 2-cycle
                      ("p", "q"), ("q", "r"), ("r", "s"), ("s", "p"),           # 4-cycle
                      ("u", "v"), ("v", "w"), ("w", "x"), ("x", "y"), ("y", "u")])  # 5-cycle: ignored
    cf = {r["node"]: r["circular_flow_count"] for r in G.circular_flow(e, 4).collect()}
    assert cf == {"a": 1, "b": 1, "p": 1, "q": 1, "r": 1, "s": 1}
    deg = {r["node"]: (r["network_in_degree"], r["network_out_degree"]) for r in G.degrees(e).collect()}
    assert deg["a"] == (2, 2)


def test_triangle_counted_once(spark):
    e = edges(spark, [("1", "2"), ("2", "3"), ("3", "1"), ("1", "3"), ("3", "2"), ("2", "1")])
    assert G.cycles(e, 3).count() == 2          # both directions
    assert G.cycles(e, 2).count() == 3


def test_pagerank_sums_to_one_with_dangling(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")])  # d dangles
    pr = G.pagerank(e, RiskConfig(pagerank_iterations=12))
    assert pr.agg(F.sum("network_pagerank")).first()[0] == pytest.approx(1.0, abs=1e-9)
    conv = G.pagerank(e)
    assert conv.agg(F.sum("network_pagerank")).first()[0] == pytest.approx(1.0, abs=1e-9)


def test_pagerank_converges_on_a_slow_graph(spark):
    """A ring fed by many senders mixes slowly; the default must reach the fixed point, not stop early."""
    pairs = [(f"r{i}", f"r{(i + 1) % 41}") for i in range(41)] + [(f"s{i}", "r0") for i in range(60)]
    got = {r[0]: r[1] for r in G.pagerank(edges(spark, pairs)).collect()}
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    rank = {n: 1 / len(got) for n in got}
    for _ in range(500):
        new = dict.fromkeys(got, 0.15 / len(got))
        for n, r in rank.items():
            for m in out.get(n) or got:
                new[m] += 0.85 * r / len(out.get(n) or got)
        rank = new
    assert sum(abs(got[n] - rank[n]) for n in got) < 101 * 1e-5


def scores_frame(spark, vals):
    return spark.createDataFrame([(str(i), v) for i, v in enumerate(vals)], "customer_id string, anomaly_score double")


def test_levels_on_exact_cuts(spark):
    s = scores_frame(spark, [0.3, 0.30000000000000004, 0.6, 0.8, 0.81])
    lv = [r["risk_level"] for r in R.classify_risk(s).orderBy("customer_id").collect()]
    assert lv == ["low", "medium", "medium", "high", "critical"]


def test_pep_and_kyc_upgrades(spark):
    s = scores_frame(spark, [0.5, 0.7, 0.2, 0.1])
    feat = spark.createDataFrame([("0", 1, 0), ("1", 1, 0), ("2", 0, 2), ("3", 0, 2)],
                                 "customer_id string, pep_flag int, kyc_status_encoded int")
    out = {r["customer_id"]: (r["risk_level"], r["escalation_action"]) for r in R.classify_risk(s, feat).collect()}
    assert out == {"0": ("high", "flag_for_review"), "1": ("critical", "file_sar"),
                   "2": ("medium", "monitor"), "3": ("low", "no_action")}


def test_rule_score_order_and_clip(spark):
    f = spark.createDataFrame([("a", 10, 0, 0.0, 0, 0.0, 0, 0, 1, 1)],
                              "customer_id string, cash_near_ctr_count int, structuring_cluster_max int, "
                              "velocity_ratio_7d double, rapid_movement_count int, high_risk_country_pct double, "
                              "dormancy_flag int, circular_flow_count int, pep_flag int, kyc_status_encoded int")
    r = D.score_rules(f).first()["rule_score"]
    assert r == pytest.approx(min(1.0, 0.35 * 1.3 + 0.05))


def test_zscore_single_row_is_zero_after_fill(spark):
    f = spark.createDataFrame([("a", 1.0, 2.0)], "customer_id string, x double, y double")
    out = D.detect_anomalies(f, RiskConfig(), method="zscore").first()
    assert out["anomaly_score"] == 0.0


def test_forest_ranks_planted_outlier_first_and_is_deterministic(spark):
    rows = [(str(i), float(i % 7), float((i * 3) % 11)) for i in range(400)] + [("out", 500.0, -300.0)]
    f = spark.createDataFrame(rows, "customer_id string, x double, y double")
    cfg = RiskConfig(forest_trees=50)
    s1 = isolation_forest_scores(f, ["x", "y"], cfg)
    top = s1.orderBy(F.desc("isolation_forest_score")).first()
    assert top["customer_id"] == "out" and top["isolation_forest_score"] == pytest.approx(1.0)
    s2 = isolation_forest_scores(f.repartition(3), ["x", "y"], cfg)
    a = {r[0]: r[1] for r in s1.collect()}
    b = {r[0]: r[1] for r in s2.collect()}
    assert a == pytest.approx(b)


def test_stratified_sample_keeps_all_positives(spark):
    rows = [(f"t{i}", "c", "P" if i % 10 == 0 else "none") for i in range(200)]
    df = spark.createDataFrame(rows, "transaction_id string, customer_id string, ground_truth_pattern string")
    s = M.stratified_sample(df, 50)
    assert s.count() == 50
    assert s.filter("ground_truth_pattern = 'P'").count() == 20
    small = M.stratified_sample(df, 10)
    assert small.count() == 10 and small.filter("ground_truth_pattern = 'none'").count() == 0
    key = lambda x: sorted(r["transaction_id"] for r in x.collect())
    assert key(M.stratified_sample(df, 50)) == key(M.stratified_sample(df.repartition(5), 50))
    assert key(M.stratified_sample(df, 500)) == sorted(r[0] for r in rows)


def test_feedback_roundtrip(spark, tmp_path):
    path = str(tmp_path / "fb")
    assert H.feedback_stats(io.read_feedback(spark, path)).first()["confirmed"] == 0
    rows = [(dt.datetime(2024, 1, 1), "A", "Confirm"), (dt.datetime(2024, 1, 2), "A", "False Positive"),
            (dt.datetime(2024, 1, 1), "B", "Confirm")]
    io.append_feedback(spark.createDataFrame(rows, "timestamp timestamp_ntz, entity_id string, decision string"), path)
    io.append_feedback(spark.createDataFrame(rows[:1], "timestamp timestamp_ntz, entity_id string, decision string"), path)
    fb = io.read_feedback(spark, path)
    st = H.feedback_stats(fb).first()
    assert (st["confirmed"], st["false_positives"]) == (3, 1)
    latest = {r["entity_id"]: r["decision"] for r in H.feedback_latest(fb).collect()}
    assert latest == {"A": "False Positive", "B": "Confirm"}


def test_csv_source_coerces_bad_timestamps(spark, tmp_path):
    p = tmp_path / "tx.csv"
    p.write_text("transaction_id,customer_id,timestamp,amount\nt1,C-1,2024-01-01 10:00:00,5.0\nt2,C-1,notadate,6.0\n")
    df = io.read_transactions(spark, str(p))
    ts = [r["timestamp"] for r in df.orderBy("transaction_id").collect()]
    assert ts[0] == dt.datetime(2024, 1, 1, 10) and ts[1] is None


def test_parquet_source_needs_no_suffix_and_is_typed(spark, tmp_path):
    path = str(tmp_path / "plain_folder")
    spark.createDataFrame([(1, "C", "2024-01-01 10:00:00", "NaN"), (2, "C", "bad", "1.5")], "id long, customer_id string, timestamp string, amount string").write.parquet(path)
    df = io.read_transactions(spark, path, "parquet", {"id": "transaction_id"})
    assert dict(df.dtypes) == {"transaction_id": "string", "customer_id": "string", "timestamp": "timestamp_ntz", "amount": "double"}
    assert [tuple(r) for r in df.orderBy("transaction_id").collect()] == [("1", "C", dt.datetime(2024, 1, 1, 10), None), ("2", "C", None, 1.5)]
    with pytest.raises(ValueError):
        io.read_transactions(spark, path, "orc")


def test_small_and_missing_amounts(spark):
    rows = [("A", T0, 0.004, "deposit"), ("A", T0, 0.004, "deposit"), ("B", T0, float("nan"), "deposit"), ("B", T0, 2.0, "deposit")]
    f = {r["customer_id"]: r for r in A.engineer_features(ledger(spark, rows), None, RiskConfig(), graph=False).collect()}
    assert f["A"]["total_amount"] == pytest.approx(0.008) and f["A"]["avg_amount"] == pytest.approx(0.004)
    assert f["B"]["total_amount"] == 2.0 and f["B"]["max_amount"] == 2.0 and f["B"]["rapid_movement_count"] == 0


def test_now_comes_from_all_rows_and_missing_times_are_usual(spark):
    rows = [("A", T0, 1.0, "deposit"), (None, T0 + dt.timedelta(days=60), 1.0, "deposit"),
            ("B", dt.datetime(2024, 1, 3, 2, 0), 1.0, "deposit"), ("B", None, 1.0, "deposit")]
    f = {r["customer_id"]: r for r in A.base_aggregates(ledger(spark, rows), RiskConfig()).collect()}
    assert f["A"]["txn_count_30d"] == 0 and f["B"]["unusual_time_pct"] == 0.5


def test_features_of_listed_customers(spark):
    df = ledger(spark, [("A", T0, 1.0, "deposit"), ("B", T0, 2.0, "deposit"), ("B", T0, 3.0, "deposit")])
    f = A.engineer_features(df, None, RiskConfig(), graph=False, customer_ids=["B"]).collect()
    assert [(r["customer_id"], r["total_transactions"]) for r in f] == [("B", 2)]


def test_date_only_ends_by_content(spark):
    from ledgerlens.operators import filters as Fl
    rows = [("A", dt.datetime(2024, 1, 5, 18), 1.0, "deposit"), ("A", dt.datetime(2024, 1, 6, 0), 1.0, "deposit")]
    df = ledger(spark, rows)
    assert [Fl.by_dates(df, None, e).count() for e in ("2024-01-05", "2024-1-5", "2024-01-05 18:00:00", "2024-01-05 17:00:00")] == [1, 1, 1, 0]


def test_customer_lists_of_any_length(spark):
    from ledgerlens.operators import filters as Fl
    df = spark.createDataFrame([(i, 1.0) for i in range(3000)], "customer_id long, amount double")
    assert Fl.by_customers(df, range(2500)).count() == 2500 and Fl.by_customers(df, [5, 5, None]).count() == 1
    assert Fl.by_customers(df, []).count() == 3000


def test_hot_customer_cluster_is_not_quadratic(spark):
    import time
    df = spark.range(200_000).selectExpr("cast(id as string) transaction_id", "'H' customer_id",
                                         "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id*2) timestamp", "9000D amount", "true is_cash")
    t = time.time()
    assert A.structuring_cluster(df, RiskConfig()).first()["structuring_cluster_max"] == 200_000
    assert time.time() - t < 60


def test_customer_csv_and_sample_writer(spark, tmp_path):
    p = tmp_path / "cust.csv"
    p.write_text("customer_id,name,age,account_open_date,pep_flag\nC-1,Ann,40,2020-02-03,true\nC-2,Bo,31,bad,false\n")
    c = io.read_customers(spark, str(p)).orderBy("customer_id").collect()
    assert c[0]["account_open_date"] == dt.date(2020, 2, 3) and c[1]["account_open_date"] is None
    out = str(tmp_path / "sample")
    io.write_sample(spark.createDataFrame([(1, "a")], "id int, v string"), out)
    io.write_sample(spark.createDataFrame([(2, "b")], "id int, v string"), out)   # overwrite
    assert [r["id"] for r in spark.read.parquet(out).collect()] == [2]


def test_ml_feature_choice(spark):
    from ledgerlens.plans import catalog as K
    feat = K.FEAT(spark, "/root/testdata/sf0.001")
    cols = D.ml_features(feat)
    assert len(cols) == 33 and not set(cols) & {"pep_flag", "dormancy_flag", "rapid_movement_count",
                                                "risk_category_encoded", "kyc_status_encoded"}
    only_text = spark.createDataFrame([("a", 1, 2, 3, 4, 5, 6)],
                                      "customer_id string, pep_flag int, dormancy_flag int, rapid_movement_count int, "
                                      "risk_category_encoded int, kyc_status_encoded int, x int")
    assert D.ml_features(only_text.drop("x")) == ["pep_flag", "dormancy_flag", "rapid_movement_count",
                                                  "risk_category_encoded", "kyc_status_encoded"]


def test_sample_without_truth_and_shuffle(spark):
    df = spark.createDataFrame([(f"t{i}", i) for i in range(100)], "transaction_id string, v int")
    s = M.stratified_sample(df, 30)
    assert s.count() == 30
    assert sorted(r["v"] for r in s.collect()) == sorted(r["v"] for r in M.stratified_sample(df.repartition(4), 30).collect())
    sh = M.stratified_sample(df, 30, shuffle=True)
    assert sorted(r["v"] for r in sh.collect()) == sorted(r["v"] for r in s.collect())


def _naive_cycles(pairs, k):
    adj = {}
    for a, b in set(pairs):
        if a != b:
            adj.setdefault(a, set()).add(b)
    found = set()

    def walk(path):
        if len(path) == k:
            if path[0] in adj.get(path[-1], ()):
                i = path.index(min(path))
                found.add(tuple(path[i:] + path[:i]))
            return
        for nxt in adj.get(path[-1], ()):
            if nxt not in path:
                walk(path + [nxt])
    for start in adj:
        walk([start])
    return found


def test_cycles_match_naive_enumeration_with_a_hub(spark):
    import random
    rng = random.Random(3)
    nodes = [f"n{i:02d}" for i in range(30)]
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(160)]
    pairs += [("hub", n) for n in nodes[::2]] + [(n, "hub") for n in nodes[1::3]]   # a high-degree node
    e = edges(spark, pairs)
    for k in (2, 3, 4):
        want = _naive_cycles(pairs, k)
        got = G.cycles(e, k).collect()
        canon = set()
        for r in got:
            m = list(r["members"])
            i = m.index(min(m))
            canon.add(tuple(m[i:] + m[:i]))
        assert len(got) == len(canon) == len(want) and canon == want, k
        per = {}
        for c in want:
            for n in c:
                per[n] = per.get(n, 0) + 1
        assert {r["node"]: r["cycles"] for r in G.cycle_counts(e, k).collect()} == per, k


def test_nan_amounts_are_missing_in_filters_thresholds_and_boxes(spark):
    import numpy as np

    from ledgerlens.operators import filters, profile
    from ledgerlens.plans.compose import threshold_customers

    nan = float("nan")
    rows = [("a", "deposit", 50.0), ("a", "deposit", 60.0), ("a", "deposit", 100.0), ("a", "deposit", nan), ("a", "deposit", None), ("b", "wire", nan)]
    df = spark.createDataFrame(rows, "customer_id string, transaction_type string, amount double").withColumn("is_cash", F.lit(True))
    assert sorted(r.amount for r in filters.by_amount(df, lo=55).collect()) == [60.0, 100.0]
    assert sorted(r.amount for r in filters.by_amount(df, hi=70).collect()) == [50.0, 60.0]
    assert sorted(r.amount for r in filters.by_amount(df, lo=55, hi=70).collect()) == [60.0]
    assert [tuple(r) for r in threshold_customers(df, 1, min_amount=55).collect()] == [("a", 2, 160.0)]
    assert {r.customer_id: r.total_amount for r in threshold_customers(df, 1).collect()} == {"a": 210.0, "b": None}
    box = {r.transaction_type: r for r in profile.box_stats(df).collect()}
    assert set(box) == {"deposit"} and (box["deposit"].q1, box["deposit"].median, box["deposit"].q3, box["deposit"].outliers) == (55.0, 60.0, 80.0, 0)
    clip = profile.clip_bound(df, q=0.5, cap=50000.0)
    got = profile.box_stats(df, clip_upper=clip).first()
    cut = np.minimum([50.0, 60.0, 100.0], 60.0)
    assert [got.q1, got.median, got.q3] == list(np.quantile(cut, [0.25, 0.5, 0.75])) and (got.whisker_lo, got.whisker_hi, got.outliers) == (50.0, 60.0, 0)


def test_histograms_keep_empty_bins_and_bounds(spark):
    from ledgerlens.operators import profile

    df = spark.createDataFrame([(1.0,), (2.0,), (2.5,), (9.0,), (float("nan"),), (None,)], "amount double")
    got = [(r.bin, r.bin_lo, r.bin_hi, r["count"]) for r in profile.histogram(df, "amount", 4).orderBy("bin").collect()]
    assert got == [(0, 1.0, 3.0, 3), (1, 3.0, 5.0, 0), (2, 5.0, 7.0, 0), (3, 7.0, 9.0, 1)]
    got = [(r.bin_lo, r["count"]) for r in profile.histogram(df, "amount", 2, lo=0, hi=4).orderBy("bin").collect()]
    assert got == [(0.0, 1), (2.0, 2)]
    assert [(r.bin_lo, r["count"]) for r in profile.histogram(df.where("amount > 100"), "amount", 2, lo=0, hi=4).orderBy("bin").collect()] == [(0.0, 0), (2.0, 0)]
    assert [(r.bin_lo, r["count"]) for r in profile.histogram(df.where("amount is null"), "amount", 2).collect()] == [(None, 0), (None, 0)]


@pytest.mark.parametrize("key", ["hist_amount", "box_by_type"])
def test_quantile_plans_read_the_ledger_a_few_times(spark, key):
    """Scalar subqueries are planned once: the ledger's three tables are read at most six times each."""
    import __spark_entry__ as E

    plan = E.queries()[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") < 20


def test_daily_sketches_merge_to_the_overview(spark):
    from ledgerlens.operators import profile

    tx = spark.range(200_000).selectExpr("id as transaction_id", "concat('C', id % 30000) as customer_id",
                                         "timestampadd(HOUR, cast(id % 600 as int), timestamp_ntz'2024-01-01 00:00:00') as timestamp")
    days = profile.daily_sketches(tx)
    assert days.count() == 25
    late = profile.daily_sketches(tx.where("transaction_id < 1000"))
    exact = profile.overview(tx).first()
    for merged, n in ((days, 200_000), (days.unionByName(late), 201_000)):
        r = profile.overview_of_sketches(merged).first()
        assert r.total_transactions == n and abs(r.unique_customers_estimate - 30_000) < 30_000 * 3 / 64
        assert (r.first_timestamp, r.last_timestamp) == (exact.first_timestamp, exact.last_timestamp)
    coarse = profile.overview_of_sketches(profile.daily_sketches(tx, lg_k=8)).first()
    assert abs(coarse.unique_customers_estimate - 30_000) < 30_000 * 4 / 16
    none = profile.overview_of_sketches(profile.daily_sketches(tx.where("false"))).first()
    assert (none.total_transactions, none.unique_customers_estimate) == (0, 0)


def _plain_pagerank(edges, steps, alpha=0.85):
    nodes = {n for e in edges for n in e}
    out = {n: [d for s, d in edges if s == n] for n in nodes}
    rank = {n: 1 / len(nodes) for n in nodes}
    for _ in range(steps):
        lost = sum(rank[n] for n in nodes if not out[n])
        new = {n: alpha * lost / len(nodes) + (1 - alpha) / len(nodes) for n in nodes}
        for n in nodes:
            for d in out[n]:
                new[d] += alpha * rank[n] / len(out[n])
        rank = new
    return rank


@pytest.mark.parametrize("heavy_rows,every", [(100_000, 1), (3, 1), (3, 3)])
def test_pagerank_with_hub_blocks_matches_the_plain_way(spark, heavy_rows, every):
    edges = [("hub", f"n{i}") for i in range(40)] + [(f"n{i}", "hub") for i in range(0, 40, 3)] + [(f"n{i}", f"n{i * 7 % 40}") for i in range(1, 30)] + [("hub", "hub")]
    cfg = RiskConfig(pagerank_iterations=7, heavy_rows=heavy_rows, pagerank_checkpoint_every=every)
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {r.node: r.network_pagerank for r in G.pagerank(df, cfg).collect()}
    want = _plain_pagerank(edges, 7)
    assert set(got) == set(want) and all(abs(got[n] - want[n]) < 1e-12 for n in want)


def test_no_block_holds_a_hub(spark):
    edges = spark.range(30_000).selectExpr("case when id % 3 = 0 then -1 else id end as src", "id as dst")
    dealt, hubs = G.edge_blocks(edges, RiskConfig(heavy_rows=100))
    assert [r.src for r in hubs.collect()] == [-1]
    sizes = dealt.groupBy("src", "block").count()
    assert sizes.agg(F.max("count")).first()[0] < 10_000 / 100 and sizes.where("src = -1").count() == G.HUB_BLOCKS
    assert dealt.count() == 30_000


def test_all_families_read_the_source_once(spark, tmp_path):
    """By Spark's own records of the jobs: the source table is scanned once, the rest reads the stored columns."""
    src = str(tmp_path / "ledger")
    rows = [("A", T0 + dt.timedelta(hours=i), 9000.0 + i, "deposit" if i % 2 else "transfer", "online", "B", "US", True) for i in range(30)]
    ledger(spark, rows).write.parquet(src)
    tx = spark.read.parquet(src)
    plans = []
    out = A.engineer_features(tx, None, RiskConfig(pagerank_iterations=2))
    plans.append(out._jdf.queryExecution().optimizedPlan().toString())
    out.collect()
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert not any(src in p for p in plans) and out.count() == 1


@pytest.mark.parametrize("seed,nodes,edges", [(1, 9, 40), (2, 30, 200), (3, 6, 36)])
def test_cycle_counts_match_enumeration(spark, seed, nodes, edges):
    """Random graphs with self loops and repeated edges, a hub pair among them, against plain enumeration."""
    import collections
    import random

    rng = random.Random(seed)
    pairs = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)] + [(0, i) for i in range(nodes)] + [(i, 1) for i in range(nodes)] + [(1, i) for i in range(0, nodes, 2)]
    out = collections.defaultdict(set)
    for s, d in pairs:
        if s != d:
            out[s].add(d)
    want = {k: collections.Counter() for k in (2, 3, 4)}

    def walk(path):
        for d in out[path[-1]]:
            if d == path[0] and len(path) in want:
                want[len(path)].update(path)
            elif d > path[0] and d not in path and len(path) < 4:
                walk(path + [d])
    for start in range(nodes):
        walk([start])
    df = spark.createDataFrame(pairs, "src long, dst long")
    for k in (2, 3, 4):
        assert {r.node: r.cycles for r in G.cycle_counts(df, k).collect()} == dict(want[k])
    for top in (2, 3, 4):
        total = sum((want[k] for k in range(2, top + 1)), collections.Counter())
        assert {r.node: r.circular_flow_count for r in G.circular_flow(df, top).collect()} == dict(total)


def test_samples_of_rows_without_a_key_are_exact_and_repeatable(spark):
    df = spark.range(3000).selectExpr("case when id % 3 > 0 then id end as transaction_id", "cast(id as string) as note", "'none' as ground_truth_pattern")
    picks = [sorted(r.note for r in M.stratified_sample(df.repartition(n), target=700).collect()) for n in (2, 7)]
    assert picks[0] == picks[1] and len(picks[0]) == len(set(picks[0])) == 700
    without = sum(int(x) % 3 == 0 for x in picks[0])
    assert 150 < without < 320     # a third of the rows has no key: they are picked like any other
