"""Every registered key: a Spark plan over the bound fixture tables and, where the
semantics are SQL-expressible, the DuckDB oracle for the same answer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FilterSpec, RiskConfig
from ..operators import explain as X
from ..operators import features as A
from ..operators import feedback as H
from ..operators import filters as Fl
from ..operators import graph as G
from ..operators import profile as P
from ..operators import risk as R
from ..operators import sampling as M
from ..operators import scoring as D
from ..session import ensure_checkpoint_dir
from ..sources import bindings as B
from ..sources import io as S
from . import compose as Q
from .registry import register
from .sql import (FEATURE_NUMERIC, classify_ctes, d, feature_ctes, forest_ctes, graph_ctes, level_sql, action_sql,
                  ml_feature_names, rule_score_sql, rule_terms_sql, sentence_sql, standardize_sql, with_, zscore_ctes)

# Static twins of the binding configs for SQL generation (the high-risk set is the `hr` CTE).
CFG_T = RiskConfig(rapid_min_deposit=5000.0, dormancy_days=2, velocity_multiplier=1.2, pagerank_iterations=10)
CFG_L = RiskConfig(velocity_multiplier=1.2, pagerank_iterations=10)

# ------------------------------------------------------------------ memo
_MEMO: dict = {}


def clear_memo(spark: SparkSession | None = None) -> None:
    for v in _MEMO.values():
        if isinstance(v, DataFrame):
            v.unpersist()
    _MEMO.clear()


def _m(spark: SparkSession, sf: str, name: str, build):
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _MEMO:
        _MEMO[key] = build()
    return _MEMO[key]


def T(s, sf):
    return _m(s, sf, "T", lambda: B.ledger_t(s, sf))


def L(s, sf):
    return _m(s, sf, "L", lambda: B.ledger_l(s, sf))


def C(s, sf):
    return _m(s, sf, "C", lambda: B.customers_c(s, sf))


def FB(s, sf):
    return _m(s, sf, "FB", lambda: B.feedback_fb(s, sf))


def cfg_t(s, sf):
    return _m(s, sf, "cfgT", lambda: B.config_t(s, sf))


def cfg_l(s, sf):
    return _m(s, sf, "cfgL", lambda: B.config_l(s, sf))


def FEAT(s, sf):
    """Full feature matrix of T (persisted: many keys read it)."""
    return _m(s, sf, "FEAT", lambda: A.engineer_features(T(s, sf), C(s, sf), cfg_t(s, sf)).persist())


def FEAT_OWN(s, sf):
    """Features of T that need no graph, for the keys that read no graph column."""
    return _m(s, sf, "FEAT_OWN", lambda: A.engineer_features(T(s, sf), C(s, sf), cfg_t(s, sf), graph=False).persist())


def FEAT_L(s, sf):
    return _m(s, sf, "FEAT_L", lambda: A.engineer_features(L(s, sf), C(s, sf), cfg_l(s, sf)).persist())


def SCORES(s, sf):
    """Rules mode: anomaly_score = rule_score."""
    return _m(s, sf, "SCORES", lambda: D.detect_anomalies(FEAT(s, sf), cfg_t(s, sf), method="rules", ordered=False))


def CLS(s, sf):
    return _m(s, sf, "CLS", lambda: R.classify_risk(SCORES(s, sf), FEAT(s, sf), C(s, sf), cfg_t(s, sf)).persist())


def FLAGGED(s, sf):
    return _m(s, sf, "FLAGGED", lambda: X.flagged_entities(CLS(s, sf), FEAT(s, sf), C(s, sf), cfg_t(s, sf)))


# ------------------------------------------------------------------ SQL helpers
def sql_t(*ctes_and_tail, graph=True, customers=True, cfg=CFG_T, src="t"):
    *ctes, tail = ctes_and_tail
    return with_(*feature_ctes(src, cfg, graph=graph, customers=customers), *ctes) + "\n" + tail


def sql_plain(*ctes_and_tail):
    *ctes, tail = ctes_and_tail
    return with_(*ctes) + "\n" + tail


ML = ml_feature_names(FEATURE_NUMERIC)
SC_RULES = f"sc AS (SELECT customer_id, {rule_score_sql(CFG_T)} AS rule_score, {rule_score_sql(CFG_T)} AS anomaly_score FROM feat)"
CLS_SQL = [SC_RULES, *classify_ctes(CFG_T)]

# ============================================================ S: scans
TX_COLS = ["transaction_id", "customer_id", "timestamp", "amount", "transaction_type", "channel",
           "counterparty_id", "counterparty_country", "is_cash", "ground_truth_flag", "ground_truth_pattern"]


@register("scan_transactions", sql_plain(B.T_SQL, "SELECT * FROM t"), dbl=["amount"], digits=2)
def scan_transactions(s, sf):
    return T(s, sf)


@register("scan_transactions_l", sql_plain(B.L_SQL, "SELECT * FROM l"), dbl=["amount"], digits=2)
def scan_transactions_l(s, sf):
    return L(s, sf)


@register("scan_customers", sql_plain(B.C_SQL, "SELECT * FROM c"))
def scan_customers(s, sf):
    return C(s, sf)


@register("read_transactions", """SELECT CAST(event_id AS VARCHAR) AS transaction_id, CAST(user_id AS VARCHAR) AS customer_id,
  CAST(ts AS TIMESTAMP) AS "timestamp", CAST(value AS DOUBLE) AS amount, event_type AS transaction_type FROM events""")
def read_transactions(s, sf):
    df = S.read_transactions(s, f"{sf}/events.parquet", "parquet", {
        "event_id": "transaction_id", "user_id": "customer_id", "ts": "timestamp", "value": "amount", "event_type": "transaction_type"})
    return df.select("transaction_id", "customer_id", "timestamp", "amount", "transaction_type")


@register("read_customers", """SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS name FROM customer""")
def read_customers(s, sf):
    return S.read_customers(s, f"{sf}/customer.parquet", "parquet", {"c_custkey": "customer_id", "c_name": "name"}).select("customer_id", "name")


# ============================================================ F: filters
IDS = [3, 7, 11, 42, 99, 120]


@register("filter_customers", sql_plain(B.T_SQL, f"SELECT * FROM t WHERE customer_id IN ({', '.join(map(str, IDS))})"))
def filter_customers(s, sf):
    return Fl.by_customers(T(s, sf), IDS)


@register("filter_dates", sql_plain(B.T_SQL, """SELECT * FROM t WHERE "timestamp" >= TIMESTAMP '2024-01-05'
  AND "timestamp" < TIMESTAMP '2024-01-13'"""))
def filter_dates(s, sf):
    return Fl.by_dates(T(s, sf), "2024-01-05", "2024-01-12")


@register("filter_dates_midnight", sql_plain(B.T_SQL, """SELECT * FROM t WHERE "timestamp" >= TIMESTAMP '2024-01-05'
  AND "timestamp" <= TIMESTAMP '2024-01-12'"""))
def filter_dates_midnight(s, sf):
    return Fl.by_dates(T(s, sf), "2024-01-05", "2024-01-12", end_of_day=False)


@register("filter_amount", sql_plain(B.T_SQL, "SELECT * FROM t WHERE amount >= 1000 AND amount <= 5000"))
def filter_amount(s, sf):
    return Fl.by_amount(T(s, sf), 1000.0, 5000.0)


@register("filter_types", sql_plain(B.T_SQL, "SELECT * FROM t WHERE transaction_type IN ('transfer', 'wire_transfer')"))
def filter_types(s, sf):
    return Fl.by_types(T(s, sf), ["transfer", "wire_transfer"])


@register("filter_countries", sql_plain(B.T_SQL, "SELECT * FROM t WHERE counterparty_country IN ('NATION_0', 'NATION_5', 'NATION_7')"))
def filter_countries(s, sf):
    return Fl.by_countries(T(s, sf), ["NATION_0", "NATION_5", "NATION_7"])


@register("filter_channels", sql_plain(B.T_SQL, "SELECT * FROM t WHERE channel IN ('atm', 'mobile')"))
def filter_channels(s, sf):
    return Fl.by_channels(T(s, sf), ["atm", "mobile"])


@register("filter_last_n_days", sql_plain(B.T_SQL, """SELECT * FROM t
  WHERE "timestamp" >= CAST(CAST((SELECT max("timestamp") FROM t) AS DATE) - 7 AS TIMESTAMP)
    AND "timestamp" < CAST(CAST((SELECT max("timestamp") FROM t) AS DATE) + 1 AS TIMESTAMP)"""))
def filter_last_n_days(s, sf):
    return Fl.last_n(T(s, sf), 7, "days")


SPEC = FilterSpec(date_start="2024-01-03", date_end="2024-01-20", min_amount=500.0, max_amount=15000.0,
                  transaction_types=("deposit", "transfer"), channels=("branch", "online", "atm"))


@register("filter_composite", sql_plain(B.T_SQL, """SELECT * FROM t WHERE "timestamp" >= TIMESTAMP '2024-01-03'
  AND "timestamp" < TIMESTAMP '2024-01-21' AND amount >= 500 AND amount <= 15000
  AND transaction_type IN ('deposit', 'transfer') AND channel IN ('branch', 'online', 'atm')"""))
def filter_composite(s, sf):
    return Fl.apply_filters(T(s, sf), SPEC)


@register("near_ctr_rows", sql_plain(B.T_SQL, "SELECT * FROM t WHERE coalesce(is_cash, false) AND amount >= 8000 AND amount < 10000"))
def near_ctr_rows(s, sf):
    return Fl.near_ctr(Fl.cash_only(T(s, sf)), cfg_t(s, sf))


@register("customer_lookup", sql_plain(B.C_SQL, "SELECT * FROM c WHERE customer_id = 42 LIMIT 1"))
def customer_lookup(s, sf):
    return Fl.get_customer(C(s, sf), 42)


# ============================================================ P: profile
@register("profile_overview", sql_plain(B.T_SQL, B.C_SQL, """SELECT count(*) AS total_transactions,
  count(DISTINCT customer_id) AS unique_customers, min("timestamp") AS first_timestamp,
  max("timestamp") AS last_timestamp, CAST(11 AS BIGINT) AS column_count,
  (SELECT count(*) FROM c) AS customer_rows FROM t"""))
def profile_overview(s, sf):
    return P.overview(T(s, sf), C(s, sf))


@register("profile_nulls", sql_plain(B.T_SQL, "UNPIVOT (SELECT " + ", ".join(
    f'count(*) FILTER (WHERE "{c}" IS NULL) AS "{c}"' for c in TX_COLS) +
    " FROM t) ON " + ", ".join(f'"{c}"' for c in TX_COLS) + " INTO NAME column_name VALUE nulls"))
def profile_nulls(s, sf):
    return P.null_counts(T(s, sf))


DESCRIBE_SQL = """SELECT count(amount) AS count, round(avg(amount), 2) AS mean, round(stddev_samp(amount), 2) AS std,
  round(min(amount), 2) AS min, round(quantile_cont(amount, 0.25), 2) AS p25, round(quantile_cont(amount, 0.5), 2) AS p50,
  round(quantile_cont(amount, 0.75), 2) AS p75, round(max(amount), 2) AS max FROM {src}"""


@register("profile_amount", sql_plain(B.T_SQL, DESCRIBE_SQL.format(src="t")))
def profile_amount(s, sf):
    return P.describe(T(s, sf), "amount")


@register("profile_amount_l", sql_plain(B.L_SQL, DESCRIBE_SQL.format(src="l")))
def profile_amount_l(s, sf):
    return P.describe(L(s, sf), "amount")


def _hist_sql(values_cte: str, bins: int) -> str:
    return f"""{values_cte},
b AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
cnt AS (SELECT CASE WHEN b.hi = b.lo THEN 0 ELSE CAST(least(floor((x - b.lo) / (b.hi - b.lo) * {bins}), {bins - 1}) AS INTEGER) END AS bin,
               count(*) AS n FROM v CROSS JOIN b GROUP BY 1)
SELECT g.bin, b.lo + (b.hi - b.lo) * g.bin / {bins} AS bin_lo, b.lo + (b.hi - b.lo) * (g.bin + 1) / {bins} AS bin_hi,
       coalesce(cnt.n, 0) AS count
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range({bins})) g CROSS JOIN b LEFT JOIN cnt ON cnt.bin = g.bin"""


CLIP_T = "(SELECT least(quantile_cont(amount, 0.99), 50000::DOUBLE) FROM t)"


@register("hist_amount", "WITH " + B.T_SQL.strip() + ",\n" + _hist_sql(
    f"v AS (SELECT least(CAST(amount AS DOUBLE), {CLIP_T}) AS x FROM t WHERE amount IS NOT NULL)", 50),
    dbl=["bin_lo", "bin_hi"])
def hist_amount(s, sf):
    return P.histogram(T(s, sf), "amount", 50, clip=(0.99, 50000.0))


@register("hist_near_ctr", "WITH " + B.T_SQL.strip() + ",\n" + _hist_sql(
    "v AS (SELECT CAST(amount AS DOUBLE) AS x FROM t WHERE coalesce(is_cash, false) AND amount >= 8000 AND amount < 10000)", 20),
    dbl=["bin_lo", "bin_hi"])
def hist_near_ctr(s, sf):
    return P.histogram(Fl.near_ctr(Fl.cash_only(T(s, sf)), cfg_t(s, sf)), "amount", 20)


@register("box_by_type", sql_plain(B.T_SQL, f"""v AS (SELECT transaction_type AS grp, least(CAST(amount AS DOUBLE), {CLIP_T}) AS x
  FROM t WHERE amount IS NOT NULL)""", """q AS (SELECT grp, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
  quantile_cont(x, 0.75) AS q3 FROM v GROUP BY grp)""", """f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_f, q3 + 1.5 * (q3 - q1) AS hi_f FROM q)""",
    """SELECT f.grp AS transaction_type, f.q1, f.median, f.q3,
  min(v.x) FILTER (WHERE v.x >= f.lo_f AND v.x <= f.hi_f) AS whisker_lo,
  max(v.x) FILTER (WHERE v.x >= f.lo_f AND v.x <= f.hi_f) AS whisker_hi,
  count(*) FILTER (WHERE NOT (v.x >= f.lo_f AND v.x <= f.hi_f)) AS outliers
FROM v JOIN f ON v.grp = f.grp GROUP BY f.grp, f.q1, f.median, f.q3"""),
    dbl=["q1", "median", "q3", "whisker_lo", "whisker_hi"])
def box_by_type(s, sf):
    t = T(s, sf)
    return P.box_stats(t, "transaction_type", "amount", clip_upper=P.clip_bound(t))


@register("type_counts", sql_plain(B.T_SQL, "SELECT transaction_type, count(*) AS count FROM t WHERE transaction_type IS NOT NULL GROUP BY 1"))
def type_counts(s, sf):
    return P.value_counts(T(s, sf), "transaction_type")


@register("channel_share", sql_plain(B.T_SQL, """SELECT channel, count(*) AS count,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 4)::DOUBLE AS share_pct FROM t WHERE channel IS NOT NULL GROUP BY 1"""))
def channel_share(s, sf):
    return P.value_counts(T(s, sf), "channel", share=True)


DAILY_SQL = """d AS (SELECT CAST("timestamp" AS DATE) AS day, count(amount) AS count, coalesce(sum(amount), 0)::DOUBLE AS total
  FROM {src} WHERE "timestamp" IS NOT NULL GROUP BY 1)"""


def _daily(src):
    return sql_plain(B.T_SQL if src == "t" else B.L_SQL, DAILY_SQL.format(src=src), """SELECT CAST(g.day AS DATE) AS day,
  coalesce(d.count, 0) AS count, coalesce(d.total, 0)::DOUBLE AS total
FROM (SELECT unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS day) g
LEFT JOIN d ON d.day = CAST(g.day AS DATE)""")


@register("daily_volume", _daily("t"), dbl=["total"], digits=4)
def daily_volume(s, sf):
    return P.daily_series(T(s, sf))


@register("daily_volume_l", _daily("l"), dbl=["total"], digits=4)
def daily_volume_l(s, sf):
    return P.daily_series(L(s, sf))


TOPC_SQL = """SELECT customer_id, sum(amount) AS total_amount,
  count(amount) AS txn_count, avg(amount) AS avg_amount
FROM {src} WHERE customer_id IS NOT NULL GROUP BY customer_id ORDER BY total_amount DESC, customer_id LIMIT 10"""


@register("top_customers", sql_plain(B.T_SQL, TOPC_SQL.format(src="t")), dbl=["total_amount", "avg_amount"], digits=4)
def top_customers(s, sf):
    return P.top_customers(T(s, sf), 10)


@register("top_customers_l", sql_plain(B.L_SQL, TOPC_SQL.format(src="l")), dbl=["total_amount", "avg_amount"], digits=4)
def top_customers_l(s, sf):
    return P.top_customers(L(s, sf), 10)


@register("cash_split", sql_plain(B.T_SQL, """SELECT is_cash, count(amount) AS count,
  sum(amount) AS total, avg(amount) AS mean,
  (SELECT round(avg(CASE WHEN coalesce(is_cash, false) THEN 1::DOUBLE ELSE 0::DOUBLE END) * 100, 1) FROM t) AS cash_pct
FROM t WHERE is_cash IS NOT NULL GROUP BY is_cash"""), dbl=["total", "mean"], digits=4)
def cash_split(s, sf):
    return P.cash_split(T(s, sf))


@register("top_countries", sql_plain(B.T_SQL, B.HR_SQL, """SELECT counterparty_country, count, counterparty_country IN (SELECT country FROM hr) AS high_risk
FROM (SELECT counterparty_country, count(*) AS count FROM t WHERE counterparty_country IS NOT NULL GROUP BY 1
      ORDER BY count DESC, counterparty_country LIMIT 15)"""))
def top_countries(s, sf):
    return P.top_countries(T(s, sf), 15, cfg_t(s, sf))


@register("near_ctr_stats", sql_plain(B.T_SQL, """SELECT count(*) FILTER (WHERE coalesce(is_cash, false) AND amount >= 8000 AND amount < 10000) AS near_ctr_count,
  round(count(*) FILTER (WHERE coalesce(is_cash, false) AND amount >= 8000 AND amount < 10000) * 100.0
        / greatest(count(*) FILTER (WHERE coalesce(is_cash, false)), 1), 2)::DOUBLE AS near_ctr_pct FROM t"""))
def near_ctr_stats(s, sf):
    return P.near_ctr_stats(T(s, sf), cfg_t(s, sf))


@register("truth_profile", sql_plain(B.T_SQL, """SELECT ground_truth_pattern AS pattern, count(*) AS rows,
  (SELECT count(*) FILTER (WHERE coalesce(ground_truth_flag, false)) FROM t) AS flagged_rows,
  round((SELECT count(*) FILTER (WHERE coalesce(ground_truth_flag, false)) FROM t) * 100.0 / (SELECT count(*) FROM t), 4)::DOUBLE AS flagged_pct
FROM t WHERE ground_truth_pattern IS DISTINCT FROM 'none' GROUP BY 1"""))
def truth_profile(s, sf):
    return P.truth_profile(T(s, sf))


DESC_FEATS = [c for c in FEATURE_NUMERIC if c != "customer_id"]


@register("feature_describe", sql_t("""lng AS (UNPIVOT (SELECT customer_id, """ + ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" for c in DESC_FEATS) + """ FROM feat) ON """ + ", ".join(DESC_FEATS)
    + " INTO NAME feature VALUE value)", """SELECT feature, count(value) AS count, round(avg(value), 4) AS mean,
  round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min, round(quantile_cont(value, 0.25), 4) AS p25,
  round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.75), 4) AS p75, round(max(value), 4) AS max
FROM lng GROUP BY feature"""))
def feature_describe(s, sf):
    return P.describe_features(FEAT(s, sf), DESC_FEATS)


# ============================================================ A: features
# Only statistics whose last bits depend on evaluation order are rounded; ratios of counts
# are the same IEEE operations in both engines.
# digits per column, scaled to magnitude: sums ~1e7 (4), std ~1e4 (6), ratios ~1 (9), PageRank ~1e-4 (12)
FEATURE_DBL = {"total_amount": 4, "avg_amount": 6, "cash_near_ctr_total": 4, "txn_volume_1d": 4, "txn_volume_7d": 4,
               "txn_volume_30d": 4, "high_risk_country_volume": 4,
               "std_amount": 6, "median_amount": 6, "amount_cv": 9, "network_pagerank": 12}


def _feat_key(key: str, cols: list[str], graph: bool = False, customers: bool = False, digits: int = 6,
              src: str = "t", family: str | None = None, heavy_rows: int | None = None):
    """A feature key. With ``family`` it computes only that family (plus the core
    aggregation that defines the customer rows); otherwise it reads the full matrix.
    ``heavy_rows`` lets customers with more rows be cut into slabs, which changes no result."""
    dbl = [(c, FEATURE_DBL[c]) for c in cols if c in FEATURE_DBL]
    cfg = CFG_T if src == "t" else CFG_L
    sql = sql_t(f"SELECT customer_id, {', '.join(cols)} FROM feat", graph=graph, customers=customers, cfg=cfg, src=src)

    def fn(s, sf):
        if family is not None:
            tx, c = (T(s, sf), cfg_t(s, sf)) if src == "t" else (L(s, sf), cfg_l(s, sf))
            c = c if heavy_rows is None else c.with_(heavy_rows=heavy_rows)
            f = _m(s, sf, f"FAM_{src}_{family}_{customers}_{heavy_rows}", lambda: A.engineer_features(
                tx, C(s, sf) if customers else None, c, feature_set=family, graph=False))
            return f.select("customer_id", *cols)
        return (FEAT(s, sf) if src == "t" else FEAT_L(s, sf)).select("customer_id", *cols)
    register(key, sql, dbl=dbl, digits=digits)(fn)


_feat_key("feat_core", A.CORE, family="core")
_feat_key("feat_near_ctr", ["cash_near_ctr_count", "cash_near_ctr_total"], family="structuring")
_feat_key("feat_structuring_cluster", ["structuring_cluster_max"], family="structuring")
_feat_key("feat_near_ctr_gap", ["near_ctr_avg_gap_hours"], family="structuring")
_feat_key("feat_cash", ["total_cash_transactions", "cash_transaction_pct"], family="structuring")
_feat_key("feat_window_counts", ["txn_count_1d", "txn_volume_1d", "txn_count_7d", "txn_volume_7d",
                                 "txn_count_30d", "txn_volume_30d"], family="velocity")
_feat_key("feat_velocity_ratio", ["velocity_ratio_7d", "velocity_ratio_30d"], family="velocity")
_feat_key("feat_timing", ["mean_gap_hours", "min_gap_hours"], family="velocity")
_feat_key("feat_geo_risk", ["high_risk_country_txns", "high_risk_country_volume", "high_risk_country_pct"],
          family="geographic")
_feat_key("feat_unique_countries", ["unique_countries"], family="geographic")
_feat_key("feat_rapid_movement", ["rapid_movement_count"], family="behavioral")
_feat_key("feat_dormancy", ["dormancy_flag"], family="behavioral")
_feat_key("feat_unusual_time", ["unusual_time_pct"], family="behavioral")
_feat_key("feat_amount_cv", ["amount_cv"], family="behavioral")
_feat_key("feat_enriched", ["risk_category", "pep_flag", "kyc_status", "account_type"], customers=True,
          family="core")
_feat_key("feat_encoded", ["risk_category_encoded", "kyc_status_encoded", "pep_flag"], customers=True,
          family="core")
ALL_FEATS = A.CORE + A.STRUCT + A.VELOC + A.GEO + A.BEHAV + A.GRAPH + [
    "risk_category", "pep_flag", "kyc_status", "account_type", "risk_category_encoded", "kyc_status_encoded"]
_feat_key("feature_matrix", ALL_FEATS, graph=True, customers=True)
_feat_key("feature_matrix_l", ALL_FEATS, graph=True, customers=True, src="l")
_feat_key("feat_rapid_movement_l", ["rapid_movement_count"], src="l", family="behavioral")
_feat_key("feat_dormancy_l", ["dormancy_flag"], src="l", family="behavioral")
_feat_key("feat_structuring_cluster_l", ["structuring_cluster_max", "cash_near_ctr_count"], src="l",
          family="structuring")

# the same features with many customers cut into slabs: the way of a customer with very many rows, on whole tables
_feat_key("feat_core_cut", A.CORE, family="core", heavy_rows=60)
_feat_key("feat_timing_cut", ["mean_gap_hours", "min_gap_hours"], family="velocity", heavy_rows=60)
_feat_key("feat_dormancy_cut_l", ["dormancy_flag"], src="l", family="behavioral", heavy_rows=40)
_feat_key("feat_structuring_cluster_cut_l", ["structuring_cluster_max", "cash_near_ctr_count"], src="l", family="structuring", heavy_rows=40)
_feat_key("feat_rapid_movement_cut", ["rapid_movement_count"], family="behavioral", heavy_rows=60)
_feat_key("feat_rapid_movement_cut_l", ["rapid_movement_count"], src="l", family="behavioral", heavy_rows=40)


@register("feature_alerts", sql_t("""SELECT count(*) FILTER (WHERE cash_near_ctr_count >= 3) AS structuring_suspects,
  count(*) FILTER (WHERE rapid_movement_count > 0) AS rapid_suspects,
  count(*) FILTER (WHERE high_risk_country_pct > 0.3) AS geo_suspects FROM feat""", graph=False, customers=False))
def feature_alerts(s, sf):
    return A.feature_alerts(FEAT_OWN(s, sf), cfg_t(s, sf))


# ---------------------------------------------------------------- graph
def _graph_sql(tail: str, src: str = "t", cfg: RiskConfig = CFG_T) -> str:
    return with_(B.T_SQL if src == "t" else B.L_SQL, *graph_ctes(src, cfg)) + "\n" + tail


def EDGES(s, sf):
    return _m(s, sf, "EDGES", lambda: G.transfer_edges(T(s, sf)).persist())


def EDGES_L(s, sf):
    return _m(s, sf, "EDGES_L", lambda: G.transfer_edges(L(s, sf)).persist())


@register("graph_edges", _graph_sql("SELECT src, dst FROM e"))
def graph_edges(s, sf):
    return EDGES(s, sf)


@register("graph_degree", _graph_sql("SELECT node, network_in_degree, network_out_degree FROM dg"))
def graph_degree(s, sf):
    return G.degrees(EDGES(s, sf))


@register("graph_pagerank", _graph_sql("SELECT node, rank AS network_pagerank FROM pr"), dbl=["network_pagerank"],
          digits=8)
def graph_pagerank(s, sf):
    return _m(s, sf, "PR", lambda: G.pagerank(EDGES(s, sf), cfg_t(s, sf)))


for _k in (2, 3, 4):
    def _cyc(s, sf, _k=_k):
        return G.cycle_counts(EDGES(s, sf), _k)
    register(f"graph_cycles_{_k}", _graph_sql(
        f"SELECT node, count(*) AS cycles FROM (SELECT unnest(members) AS node FROM cyc{_k}) GROUP BY node"))(_cyc)


@register("graph_circular_flow", _graph_sql("SELECT node, circular_flow_count FROM cf"))
def graph_circular_flow(s, sf):
    return G.circular_flow(EDGES(s, sf), 4)


@register("graph_cycles_3_l", _graph_sql(
    "SELECT node, count(*) AS cycles FROM (SELECT unnest(members) AS node FROM cyc3) GROUP BY node", src="l", cfg=CFG_L))
def graph_cycles_3_l(s, sf):
    return G.cycle_counts(EDGES_L(s, sf), 3)


@register("graph_pagerank_l", _graph_sql("SELECT node, rank AS network_pagerank FROM pr", src="l", cfg=CFG_L),
          dbl=["network_pagerank"], digits=8)
def graph_pagerank_l(s, sf):
    return G.pagerank(EDGES_L(s, sf), cfg_l(s, sf))


@register("graph_circular_flow_l", _graph_sql("SELECT node, circular_flow_count FROM cf", src="l", cfg=CFG_L))
def graph_circular_flow_l(s, sf):
    return G.circular_flow(EDGES_L(s, sf), 4)


@register("graph_degree_l", _graph_sql("SELECT node, network_in_degree, network_out_degree FROM dg", src="l", cfg=CFG_L))
def graph_degree_l(s, sf):
    return G.degrees(EDGES_L(s, sf))


# ============================================================ D: scoring
STD_SQL_COLS = ML


@register("standardize", sql_t(*standardize_sql(ML)), dbl=ML, digits=5)
def standardize(s, sf):
    return D.standardize(FEAT(s, sf), ML)


@register("minmax_invert", sql_t("""SELECT customer_id, amount_cv,
  1::DOUBLE - (amount_cv - (SELECT min(amount_cv) FROM feat)) / ((SELECT max(amount_cv) FROM feat)
  - (SELECT min(amount_cv) FROM feat) + CAST(1e-10 AS DOUBLE)) AS minmax_score FROM feat""", graph=False, customers=False),
    dbl=["amount_cv", "minmax_score"])
def minmax_invert(s, sf):
    return D.minmax_invert(FEAT_OWN(s, sf).select("customer_id", "amount_cv"), "amount_cv", "minmax_score")


@register("iforest_cut", sql_t("""SELECT quantile_cont(amount_cv, 0.1) AS threshold,
  count(*) FILTER (WHERE amount_cv < (SELECT quantile_cont(amount_cv, 0.1) FROM feat)) AS anomalies,
  CAST(0.1 AS DOUBLE) AS contamination FROM feat""", graph=False, customers=False), dbl=["threshold", "contamination"])
def iforest_cut(s, sf):
    return D.contamination_cut(FEAT_OWN(s, sf), "amount_cv", 0.1)


@register("score_zscore", sql_t(*zscore_ctes(CFG_T, ML), "SELECT customer_id, max_z, zscore_score FROM zs"),
          dbl=["max_z", "zscore_score"])
def score_zscore(s, sf):
    return D.zscore_columns(FEAT(s, sf), ML, cfg_t(s, sf)).select("customer_id", "max_z", "zscore_score")


@register("zscore_summary", sql_t(*zscore_ctes(CFG_T, ML), """SELECT count(*) FILTER (WHERE max_z > 3) AS anomalies_above_3sigma,
  avg(max_z) AS mean_max_zscore FROM zs"""), dbl=["mean_max_zscore"])
def zscore_summary(s, sf):
    return D.zscore_summary(D.zscore_columns(FEAT(s, sf), ML, cfg_t(s, sf)), cfg_t(s, sf))


for _name, _hit, _contrib in rule_terms_sql(CFG_T):
    _key = {"structuring": "rule_structuring", "velocity_spike": "rule_velocity", "rapid_movement": "rule_rapid",
            "geographic_risk": "rule_geo", "dormancy_activation": "rule_dormancy",
            "round_tripping": "rule_circular"}[_name]

    def _rule(s, sf, _name=_name):
        return D.single_rule(FEAT(s, sf), _name, cfg_t(s, sf))
    register(_key, sql_t(f"SELECT customer_id, {_hit} AS hit, {_contrib} AS contribution FROM feat"),
             dbl=["contribution"], digits=9)(_rule)


@register("score_rules", sql_t(f"SELECT customer_id, {rule_score_sql(CFG_T)} AS rule_score FROM feat"),
          dbl=["rule_score"], digits=9)
def score_rules(s, sf):
    return D.score_rules(FEAT(s, sf), cfg_t(s, sf)).select("customer_id", "rule_score")


@register("rule_hit_counts", sql_t("UNPIVOT (SELECT " + ", ".join(
    f"count(*) FILTER (WHERE {hit}) AS {name}" for name, hit, _ in rule_terms_sql(CFG_T))
    + f", count(*) FILTER (WHERE pep_flag = 1) AS pep_amplified, count(*) FILTER (WHERE {rule_score_sql(CFG_T)} > {d(0.3)}) AS rule_anomalies FROM feat)"
    + " ON " + ", ".join([n for n, _, _ in rule_terms_sql(CFG_T)] + ["pep_amplified", "rule_anomalies"])
    + " INTO NAME rule VALUE hits"))
def rule_hit_counts(s, sf):
    return D.rule_hit_counts(D.score_rules(FEAT(s, sf), cfg_t(s, sf)), cfg_t(s, sf))


ENS_SQL = [*zscore_ctes(CFG_T, ML),
           f"""en AS (SELECT f.customer_id, z.zscore_score, {rule_score_sql(CFG_T)} AS rule_score FROM feat f
  JOIN zs z ON z.customer_id = f.customer_id)"""]


@register("score_ensemble", sql_t(*ENS_SQL, """SELECT customer_id, coalesce(zscore_score, 0) AS zscore_score, rule_score,
  coalesce((0::DOUBLE + zscore_score * 0.25::DOUBLE + rule_score * 0.45::DOUBLE) / (0.25::DOUBLE + 0.45::DOUBLE), 0) AS ensemble_score,
  coalesce((0::DOUBLE + zscore_score * 0.25::DOUBLE + rule_score * 0.45::DOUBLE) / (0.25::DOUBLE + 0.45::DOUBLE), 0) AS anomaly_score FROM en"""),
    dbl=["zscore_score", "rule_score", "ensemble_score", "anomaly_score"])
def score_ensemble(s, sf):
    return D.detect_anomalies(FEAT(s, sf), cfg_t(s, sf), method="ensemble", forest=False)


@register("score_single_method", sql_t(*zscore_ctes(CFG_T, ML), """SELECT customer_id, coalesce(zscore_score, 0) AS zscore_score,
  coalesce(zscore_score, 0) AS anomaly_score FROM zs"""), dbl=["zscore_score", "anomaly_score"])
def score_single_method(s, sf):
    return D.detect_anomalies(FEAT(s, sf), cfg_t(s, sf), method="zscore")


@register("anomaly_summary", sql_t(*ENS_SQL, """SELECT count(*) AS analyzed, count(*) FILTER (WHERE a > 0.3) AS flagged,
  count(*) FILTER (WHERE a > 0.6) AS high_risk, count(*) FILTER (WHERE a > 0.8) AS critical FROM (
  SELECT coalesce((0::DOUBLE + zscore_score * 0.25::DOUBLE + rule_score * 0.45::DOUBLE) / (0.25::DOUBLE + 0.45::DOUBLE), 0) AS a FROM en)"""))
def anomaly_summary(s, sf):
    return D.anomaly_summary(D.detect_anomalies(FEAT(s, sf), cfg_t(s, sf), method="ensemble", forest=False),
                             cfg_t(s, sf))


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@register("score_iforest", _recursive(sql_t(*forest_ctes(CFG_T, ML), """SELECT customer_id, isolation_forest_score,
  isolation_forest_score AS anomaly_score FROM ifs""")), dbl=["isolation_forest_score", "anomaly_score"])
def score_iforest(s, sf):
    return D.detect_anomalies(FEAT(s, sf), cfg_t(s, sf), method="isolation_forest")


FOREST_ENS_SQL = [*forest_ctes(CFG_T, ML), *ENS_SQL, """sc AS (SELECT en.customer_id, isolation_forest_score, coalesce(zscore_score, 0) AS zscore_score, rule_score,
  coalesce((0::DOUBLE + isolation_forest_score * 0.3::DOUBLE + zscore_score * 0.25::DOUBLE + rule_score * 0.45::DOUBLE)
           / (0::DOUBLE + 0.3::DOUBLE + 0.25::DOUBLE + 0.45::DOUBLE), 0) AS ensemble_score FROM en JOIN ifs ON ifs.customer_id = en.customer_id)""",
                  "sc1 AS (SELECT *, ensemble_score AS anomaly_score FROM sc)"]


@register("full_analysis_ensemble", _recursive(sql_t(*FOREST_ENS_SQL, *classify_ctes(CFG_T, "sc1"), "SELECT * FROM cls")),
          dbl=["isolation_forest_score", "zscore_score", "rule_score", "ensemble_score", "anomaly_score"])
def full_analysis_ensemble(s, sf):
    _, _, cls = Q.analyse(T(s, sf), C(s, sf), cfg_t(s, sf), method="ensemble", features=FEAT(s, sf))
    return cls


# ============================================================ R: risk
@register("risk_level", sql_t(SC_RULES, f"SELECT customer_id, anomaly_score, {level_sql('anomaly_score', CFG_T)} AS risk_level FROM sc"),
          dbl=["anomaly_score"], digits=9)
def risk_level(s, sf):
    return R.classify_risk(SCORES(s, sf), cfg=cfg_t(s, sf)).select("customer_id", "anomaly_score", "risk_level")


@register("risk_action", sql_t(SC_RULES, f"""SELECT customer_id, {level_sql('anomaly_score', CFG_T)} AS risk_level,
  {action_sql(level_sql('anomaly_score', CFG_T))} AS escalation_action FROM sc"""))
def risk_action(s, sf):
    return R.classify_risk(SCORES(s, sf), cfg=cfg_t(s, sf)).select("customer_id", "risk_level", "escalation_action")


def _upgrade_sql(pep: bool, kyc: bool) -> str:
    lv = level_sql("s.anomaly_score", CFG_T)
    e = lv
    if pep:
        e = f"(CASE WHEN f.pep_flag = 1 AND ({e}) = 'medium' THEN 'high' ELSE {e} END)"
        e = f"(CASE WHEN f.pep_flag = 1 AND {e} = 'high' AND s.anomaly_score > {d(CFG_T.pep_critical_cut)} THEN 'critical' ELSE {e} END)"
    if kyc:
        e = f"(CASE WHEN f.kyc_status_encoded = 2 AND {e} = 'low' AND s.anomaly_score > {d(CFG_T.kyc_medium_cut)} THEN 'medium' ELSE {e} END)"
    return e


@register("risk_pep_upgrade", sql_t(SC_RULES, f"""SELECT s.customer_id, {_upgrade_sql(True, False)} AS risk_level,
  {action_sql(_upgrade_sql(True, False))} AS escalation_action FROM sc s LEFT JOIN feat f ON f.customer_id = s.customer_id"""))
def risk_pep_upgrade(s, sf):
    return R.classify_risk(SCORES(s, sf), FEAT(s, sf).select("customer_id", "pep_flag"), cfg=cfg_t(s, sf)) \
        .select("customer_id", "risk_level", "escalation_action")


@register("risk_kyc_upgrade", sql_t(SC_RULES, f"""SELECT s.customer_id, {_upgrade_sql(False, True)} AS risk_level,
  {action_sql(_upgrade_sql(False, True))} AS escalation_action FROM sc s LEFT JOIN feat f ON f.customer_id = s.customer_id"""))
def risk_kyc_upgrade(s, sf):
    return R.classify_risk(SCORES(s, sf), FEAT(s, sf).select("customer_id", "kyc_status_encoded"), cfg=cfg_t(s, sf)) \
        .select("customer_id", "risk_level", "escalation_action")


@register("risk_classified", sql_t(*CLS_SQL, "SELECT customer_id, anomaly_score, risk_level, escalation_action FROM cls"),
          dbl=["anomaly_score"], digits=9)
def risk_classified(s, sf):
    return CLS(s, sf).select("customer_id", "anomaly_score", "risk_level", "escalation_action")


@register("risk_top_n", sql_t(SC_RULES, "top AS (SELECT * FROM sc ORDER BY anomaly_score DESC, customer_id LIMIT 25)",
                              *classify_ctes(CFG_T, "top"),
                              "SELECT customer_id, anomaly_score, risk_level, escalation_action FROM cls"),
          dbl=["anomaly_score"], digits=9)
def risk_top_n(s, sf):
    return R.classify_risk(SCORES(s, sf), FEAT(s, sf), C(s, sf), cfg_t(s, sf), top_n=25) \
        .select("customer_id", "anomaly_score", "risk_level", "escalation_action")


@register("risk_enriched", sql_t(*CLS_SQL, "SELECT customer_id, risk_level, name, account_type, country, pep_flag FROM cls"))
def risk_enriched(s, sf):
    return CLS(s, sf).select("customer_id", "risk_level", "name", "account_type", "country", "pep_flag")


LEVELS_SQL = "lv AS (SELECT * FROM (VALUES ('critical', 0), ('high', 1), ('medium', 2), ('low', 3)) v(risk_level, level_order))"


@register("risk_distribution", sql_t(*CLS_SQL, LEVELS_SQL, """SELECT lv.risk_level, lv.level_order, coalesce(n, 0) AS customers,
  round(coalesce(coalesce(n, 0) * 100.0 / (SELECT count(*) FROM cls), 0), 4)::DOUBLE AS share_pct
FROM lv LEFT JOIN (SELECT risk_level, count(*) AS n FROM cls GROUP BY 1) k ON k.risk_level = lv.risk_level"""))
def risk_distribution(s, sf):
    return R.risk_distribution(CLS(s, sf))


@register("action_distribution", sql_t(*CLS_SQL, """ac AS (SELECT * FROM (VALUES ('file_sar', 0), ('flag_for_review', 1),
  ('monitor', 2), ('no_action', 3)) v(escalation_action, action_order))""", """SELECT ac.escalation_action, ac.action_order,
  coalesce(n, 0) AS customers FROM ac LEFT JOIN (SELECT escalation_action, count(*) AS n FROM cls GROUP BY 1) k
  ON k.escalation_action = ac.escalation_action"""))
def action_distribution(s, sf):
    return R.action_distribution(CLS(s, sf))


@register("top_risky", sql_t(*CLS_SQL, """SELECT customer_id, anomaly_score, risk_level FROM cls
  ORDER BY anomaly_score DESC, customer_id LIMIT 15"""), dbl=["anomaly_score"], digits=9)
def top_risky(s, sf):
    return R.top_by_score(CLS(s, sf), 15).select("customer_id", "anomaly_score", "risk_level")


@register("score_histogram", sql_t(*CLS_SQL, """v AS (SELECT CAST(anomaly_score AS DOUBLE) AS x FROM cls WHERE anomaly_score IS NOT NULL)""",
    """cnt AS (SELECT CAST(least(floor((x - 0::DOUBLE) / (1::DOUBLE - 0::DOUBLE) * 29), 28) AS INTEGER) AS bin, count(*) AS n
  FROM v WHERE x >= 0 AND x <= 1 GROUP BY 1)""", """h AS (SELECT g.bin, 0::DOUBLE + (1::DOUBLE - 0::DOUBLE) * g.bin / 29 AS bin_lo,
  0::DOUBLE + (1::DOUBLE - 0::DOUBLE) * (g.bin + 1) / 29 AS bin_hi, coalesce(cnt.n, 0) AS count
  FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(29)) g LEFT JOIN cnt ON cnt.bin = g.bin)""",
    f"""SELECT *, CASE WHEN bin_lo >= {d(0.8)} THEN 'critical' WHEN bin_lo >= {d(0.6)} THEN 'high'
  WHEN bin_lo >= {d(0.3)} THEN 'medium' ELSE 'low' END AS band FROM h"""), dbl=["bin_lo", "bin_hi"])
def score_histogram(s, sf):
    return R.score_histogram(CLS(s, sf), cfg_t(s, sf))


# ============================================================ X: explanation
def _flag_sql(tail: str) -> str:
    return sql_t(*CLS_SQL, """fl AS (SELECT * FROM cls WHERE risk_level <> 'low' ORDER BY anomaly_score DESC, customer_id LIMIT 20)""",
                 f"""fx AS (SELECT fl.customer_id, fl.anomaly_score, fl.risk_level, fl.escalation_action,
  coalesce(fl.name, 'Unknown') AS customer_name, coalesce(fl.country, 'N/A') AS customer_country,
  coalesce(fl.account_type, 'N/A') AS account_type,
  list_filter([{", ".join(f"CASE WHEN {cond} THEN '{code}' END" for code, cond in _EVIDENCE_SQL)}], lambda x: x IS NOT NULL) AS codes,
  list_filter([{", ".join(f"CASE WHEN {cond} THEN '{p}' END" for p, cond in _PATTERN_SQL)}], lambda x: x IS NOT NULL) AS pats
  FROM fl LEFT JOIN feat f ON f.customer_id = fl.customer_id)""", tail)


_EVIDENCE_SQL = [
    ("STRUCTURING", "f.cash_near_ctr_count >= 3"), ("RAPID_MOVEMENT", "f.rapid_movement_count > 0"),
    ("VELOCITY_SPIKE", f"f.velocity_ratio_7d >= {d(5.0)}"), ("GEOGRAPHIC_RISK", f"f.high_risk_country_pct > {d(0.2)}"),
    ("DORMANT_ACTIVATION", "f.dormancy_flag = 1"), ("UNUSUAL_TIMING", f"f.unusual_time_pct > {d(0.4)}"),
    ("PEP", "f.pep_flag = 1"), ("AMOUNT_VOLATILITY", f"f.amount_cv > {d(3.0)}"),
    ("NETWORK_CENTRALITY", f"f.network_pagerank > {d(0.05)}"), ("CIRCULAR_FLOW", "f.circular_flow_count > 0")]
_PATTERN_SQL = [
    ("structuring", "f.cash_near_ctr_count >= 3"), ("rapid_movement", "f.rapid_movement_count > 0"),
    ("velocity_spike", f"f.velocity_ratio_7d >= {d(5.0)}"), ("geographic_risk", f"f.high_risk_country_pct > {d(0.2)}"),
    ("dormant_activation", "f.dormancy_flag = 1"), ("round_trip", "f.circular_flow_count > 0")]
CODES_SQL = f"CASE WHEN len(codes) = 0 AND anomaly_score > {d(0.3)} THEN ['STATISTICAL_ANOMALY'] ELSE codes END"


@register("evidence_codes", _flag_sql(f"SELECT CAST(customer_id AS VARCHAR) AS entity_id, array_to_string({CODES_SQL}, ',') AS evidence_codes FROM fx"))
def evidence_codes(s, sf):
    return FLAGGED(s, sf).select("entity_id", F.array_join("evidence_codes", ",").alias("evidence_codes"))


@register("detected_patterns", _flag_sql("SELECT CAST(customer_id AS VARCHAR) AS entity_id, array_to_string(pats, ',') AS detected_patterns FROM fx"))
def detected_patterns(s, sf):
    return FLAGGED(s, sf).select("entity_id", F.array_join("detected_patterns", ",").alias("detected_patterns"))


@register("flagged_top20", _flag_sql("SELECT CAST(customer_id AS VARCHAR) AS entity_id, anomaly_score AS risk_score, risk_level FROM fx"),
          dbl=["risk_score"], digits=9)
def flagged_top20(s, sf):
    return FLAGGED(s, sf).select("entity_id", "risk_score", "risk_level")


@register("flagged_entities", _flag_sql("""SELECT CAST(customer_id AS VARCHAR) AS entity_id, 'customer' AS entity_type,
  anomaly_score AS risk_score, risk_level, escalation_action, array_to_string(pats, ',') AS detected_patterns,
  """ + f"array_to_string({CODES_SQL}, ',')" + """ AS evidence_codes, customer_name, customer_country, account_type FROM fx"""),
    dbl=["risk_score"], digits=9)
def flagged_entities(s, sf):
    return FLAGGED(s, sf).select(
        "entity_id", "entity_type", "risk_score", "risk_level", "escalation_action",
        F.array_join("detected_patterns", ",").alias("detected_patterns"),
        F.array_join("evidence_codes", ",").alias("evidence_codes"),
        "customer_name", "customer_country", "account_type")


def _explanation_sql() -> str:
    own = X.sentences(CFG_T)
    lines = ", ".join(f"CASE WHEN {cond} THEN {sentence_sql(own[code])} END" for code, cond in _EVIDENCE_SQL)
    actions = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.ACTION_TEXT.items())
    return sql_t(*CLS_SQL, """fl AS (SELECT * FROM cls WHERE risk_level <> 'low' ORDER BY anomaly_score DESC, customer_id LIMIT 20)""",
                 f"""fy AS (SELECT fl.*, list_filter([{lines}], lambda x: x IS NOT NULL) AS fired FROM fl LEFT JOIN feat f ON f.customer_id = fl.customer_id)""",
                 f"""fz AS (SELECT *, CASE WHEN len(fired) = 0 AND anomaly_score > {d(CFG_T.risk_low_upper)} THEN [{sentence_sql(own["STATISTICAL_ANOMALY"])}] ELSE fired END AS lines FROM fy)""",
                 f"""SELECT CAST(customer_id AS VARCHAR) AS entity_id, array_to_string(lines, chr(10)) AS key_evidence,
  upper(risk_level) || ' risk, score ' || format('{{:,.3f}}', round_even(anomaly_score, 3)) || ': customer ' || CAST(customer_id AS VARCHAR) || ' (' ||
  coalesce(name, 'Unknown') || ', ' || coalesce(account_type, 'N/A') || ' account, ' || coalesce(country, 'N/A') || ')' || chr(10) ||
  array_to_string(list_transform(lines, lambda x: '- ' || x || chr(10)), '') || 'Action: ' || CASE escalation_action {actions} ELSE 'decide by hand' END AS explanation FROM fz""")


@register("explanation_text", _explanation_sql())
def explanation_text(s, sf):
    return FLAGGED(s, sf).select("entity_id", "explanation", F.array_join("key_evidence", "\n").alias("key_evidence"))


@register("pattern_counts", _flag_sql("SELECT p AS pattern, count(*) AS customers FROM (SELECT unnest(pats) AS p FROM fx) GROUP BY 1"))
def pattern_counts(s, sf):
    return X.pattern_counts(FLAGGED(s, sf))


@register("flagged_level_counts", _flag_sql("SELECT risk_level, count(*) AS customers FROM fx GROUP BY 1"))
def flagged_level_counts(s, sf):
    return X.flagged_level_counts(FLAGGED(s, sf))


@register("filter_risk_level", sql_t(*CLS_SQL, "SELECT customer_id, risk_level FROM cls WHERE risk_level IN ('critical', 'high')"))
def filter_risk_level(s, sf):
    return X.min_level(CLS(s, sf), "high").select("customer_id", "risk_level")


# ============================================================ Q: compositions
Q1_SQL = """q AS (SELECT customer_id, count(*) AS txn_count, sum(amount) AS total_amount FROM t
  WHERE customer_id IS NOT NULL AND amount < 10000 AND amount >= 8000 AND coalesce(is_cash, false)
  GROUP BY customer_id HAVING count(*) >= 3)"""


@register("threshold_customers", sql_plain(B.T_SQL, Q1_SQL, "SELECT count(*) AS qualifying_customers, CAST(3 AS BIGINT) AS threshold FROM q"))
def threshold_customers(s, sf):
    q = Q.threshold_customers(T(s, sf), 3, 8000.0, 10000.0, cash_only=True)
    return q.agg(F.count(F.lit(1)).alias("qualifying_customers")).withColumn("threshold", F.lit(3).cast("bigint"))


@register("threshold_top10", sql_plain(B.T_SQL, Q1_SQL, "SELECT * FROM q ORDER BY txn_count DESC, customer_id LIMIT 10"),
          dbl=["total_amount"], digits=2)
def threshold_top10(s, sf):
    q = Q.threshold_customers(T(s, sf), 3, 8000.0, 10000.0, cash_only=True)
    return q.orderBy(F.col("txn_count").desc(), F.col("customer_id")).limit(10)


LOOKUP_IDS = [0, 5, 17, 42, 101]


@register("entity_lookup", sql_t(*CLS_SQL, f"""fx AS (SELECT k.customer_id, k.anomaly_score, k.risk_level, k.escalation_action,
  list_filter([{", ".join(f"CASE WHEN {cond} THEN '{code}' END" for code, cond in _EVIDENCE_SQL)}], lambda x: x IS NOT NULL) AS codes
  FROM cls k LEFT JOIN feat f ON f.customer_id = k.customer_id WHERE k.customer_id IN ({", ".join(map(str, LOOKUP_IDS))}))""",
    f"""SELECT CAST(customer_id AS VARCHAR) AS entity_id, anomaly_score AS risk_score, risk_level, escalation_action,
  array_to_string({CODES_SQL}, ',') AS evidence_codes FROM fx"""), dbl=["risk_score"], digits=9)
def entity_lookup(s, sf):
    out = Q.entity_lookup(CLS(s, sf), FEAT(s, sf), C(s, sf), LOOKUP_IDS, cfg_t(s, sf))
    return out.select("entity_id", "risk_score", "risk_level", "escalation_action",
                      F.array_join("evidence_codes", ",").alias("evidence_codes"))


CMP_COLS = DESC_FEATS


@register("entity_compare", sql_t("UNPIVOT (SELECT customer_id, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in CMP_COLS)
                                  + f" FROM feat WHERE customer_id IN (0, 5, 17)) ON {', '.join(CMP_COLS)} INTO NAME feature VALUE value"),
          dbl=["value"], digits=4)
def entity_compare(s, sf):
    return Q.entity_compare(FEAT(s, sf), [0, 5, 17])


@register("full_analysis", sql_t(*CLS_SQL, """SELECT customer_id, anomaly_score, risk_level, escalation_action, name, account_type,
  country, pep_flag FROM cls"""), dbl=["anomaly_score"], digits=9)
def full_analysis(s, sf):
    return CLS(s, sf).select("customer_id", "anomaly_score", "risk_level", "escalation_action", "name", "account_type",
                             "country", "pep_flag")


for _p, _rule in Q.PATTERN_RULES.items():
    _hit, _contrib = {n: (h, c) for n, h, c in rule_terms_sql(CFG_T)}[_rule]

    def _pat(s, sf, _p=_p):
        return Q.pattern_search(FEAT(s, sf), CLS(s, sf), _p, cfg_t(s, sf))
    register(f"pattern_{_p}", sql_t(*CLS_SQL, f"""SELECT f.customer_id, {_contrib} AS contribution, k.anomaly_score, k.risk_level
  FROM feat f JOIN cls k ON k.customer_id = f.customer_id WHERE {_hit}"""), dbl=["contribution", "anomaly_score"], digits=9)(_pat)


@register("pattern_wire_only", with_(*feature_ctes(
    "tw", CFG_T, source_ctes=[B.T_SQL, "tw AS (SELECT * FROM t WHERE transaction_type IN ('wire_transfer'))"]), *CLS_SQL)
    + """\nSELECT k.customer_id, k.anomaly_score, k.risk_level, f.total_transactions, f.total_amount, f.network_out_degree
FROM cls k JOIN feat f ON f.customer_id = k.customer_id""", dbl=[("anomaly_score", 9), ("total_amount", 4)])
def pattern_wire_only(s, sf):
    return Q.type_search(T(s, sf), C(s, sf), ["wire_transfer"], cfg_t(s, sf))


@register("run_totals", sql_t(*CLS_SQL, """SELECT (SELECT count(*) FROM t) AS total_analyzed,
  (SELECT count(*) FROM cls WHERE risk_level <> 'low') AS total_flagged"""))
def run_totals(s, sf):
    return Q.run_totals(T(s, sf), CLS(s, sf))


# ============================================================ M, H, V
SAMPLE_HASH = "('0x' || substr(md5(CAST(transaction_id AS VARCHAR) || ':42'), 1, 15))::BIGINT"


@register("stratified_sample", sql_plain(B.T_SQL, f"""ps AS (SELECT *, ground_truth_pattern IS DISTINCT FROM 'none' AS pos FROM t)""",
    f"""rk AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY {SAMPLE_HASH}, transaction_id) AS nth FROM ps)""",
    """SELECT * EXCLUDE (pos, nth) FROM rk WHERE nth <= CASE WHEN pos THEN 2000
  ELSE greatest(2000 - (SELECT count(*) FROM ps WHERE pos), 0) END"""), dbl=["amount"], digits=2)
def stratified_sample(s, sf):
    return M.stratified_sample(T(s, sf), target=2000, seed=42)


@register("sample_below_positives", sql_plain(B.T_SQL, f"""rk AS (SELECT *, row_number() OVER (ORDER BY {SAMPLE_HASH}, transaction_id) AS nth
  FROM t WHERE ground_truth_pattern IS DISTINCT FROM 'none')""", "SELECT * EXCLUDE (nth) FROM rk WHERE nth <= 7"), dbl=["amount"], digits=2)
def sample_below_positives(s, sf):
    """M2: a target below the number of positives picks among them and no other row."""
    return M.stratified_sample(T(s, sf), target=7, seed=42)


@register("sample_without_truth", sql_plain(B.T_SQL, f"""rk AS (SELECT *, row_number() OVER (ORDER BY {SAMPLE_HASH}, transaction_id) AS nth FROM t)""",
    "SELECT * EXCLUDE (nth, ground_truth_flag, ground_truth_pattern) FROM rk WHERE nth <= 500"), dbl=["amount"], digits=2)
def sample_without_truth(s, sf):
    """M3: without truth columns every row is a normal one."""
    return M.stratified_sample(T(s, sf).drop("ground_truth_flag", "ground_truth_pattern"), target=500, seed=42)


def _scratch(s) -> str:
    """A new path in the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(s).rstrip('/')}/ledger-{uuid.uuid4().hex}"


@register("write_sample", sql_plain(B.L_SQL, """SELECT transaction_id, customer_id, "timestamp", amount, is_cash FROM l"""), dbl=["amount"], digits=2)
def write_sample(s, sf):
    """S3: a table written and read again."""
    path = _scratch(s)
    S.write_sample(L(s, sf).select("transaction_id", "customer_id", "timestamp", "amount", "is_cash"), path)
    return s.read.parquet(path)


@register("feedback_log", sql_plain(B.FB_SQL, """SELECT "timestamp", CAST(entity_id AS VARCHAR) AS entity_id, decision FROM fb"""))
def feedback_log(s, sf):
    """Decisions appended in two writes, the log read back."""
    path = _scratch(s)
    for part in ("decision = 'Confirm'", "decision <> 'Confirm'"):
        S.append_feedback(FB(s, sf).where(part), path)
    return S.read_feedback(s, path)


@register("stratified_sample_counts", sql_plain(B.T_SQL, """SELECT class, rows FROM (
  SELECT 'positive' AS class, least(count(*), 2000) AS rows FROM t WHERE ground_truth_pattern IS DISTINCT FROM 'none'
  UNION ALL
  SELECT 'normal', greatest(least(2000 - (SELECT count(*) FROM t WHERE ground_truth_pattern IS DISTINCT FROM 'none'),
                         (SELECT count(*) FROM t WHERE ground_truth_pattern IS NOT DISTINCT FROM 'none')), 0))
WHERE rows > 0"""))
def stratified_sample_counts(s, sf):
    return M.sample_class_counts(M.stratified_sample(T(s, sf), target=2000, seed=42))


@register("feedback_stats", sql_plain(B.FB_SQL, """SELECT count(*) FILTER (WHERE decision = 'Confirm') AS confirmed,
  count(*) FILTER (WHERE decision = 'False Positive') AS false_positives FROM fb"""))
def feedback_stats(s, sf):
    return H.feedback_stats(FB(s, sf))


@register("feedback_latest", sql_plain(B.FB_SQL, """SELECT entity_id, arg_max(decision, "timestamp") AS decision,
  max("timestamp") AS decided_at FROM fb GROUP BY entity_id"""))
def feedback_latest(s, sf):
    return H.feedback_latest(FB(s, sf))


@register("risk_after_feedback", sql_t(*CLS_SQL, B.FB_SQL, """fp AS (SELECT entity_id FROM fb GROUP BY entity_id
  HAVING arg_max(decision, "timestamp") = 'False Positive')""", """SELECT lv.risk_level, coalesce(n, 0) AS customers
FROM (VALUES ('medium'), ('high'), ('critical')) lv(risk_level) LEFT JOIN (
  SELECT risk_level, count(*) AS n FROM cls WHERE risk_level <> 'low' AND customer_id NOT IN (SELECT entity_id FROM fp)
  GROUP BY 1) k ON k.risk_level = lv.risk_level"""))
def risk_after_feedback(s, sf):
    return H.risk_after_feedback(CLS(s, sf), FB(s, sf))


@register("top_entities", sql_t(*CLS_SQL, """SELECT customer_id, anomaly_score, risk_level FROM cls WHERE risk_level <> 'low'
  ORDER BY anomaly_score DESC, customer_id LIMIT 8"""), dbl=["anomaly_score"], digits=9)
def top_entities(s, sf):
    return H.top_entities(CLS(s, sf), 8)


@register("eval_metrics", sql_t(*CLS_SQL, """tr AS (SELECT customer_id, max(CAST(coalesce(ground_truth_flag, false) AS INTEGER)) AS actual
  FROM t WHERE customer_id IS NOT NULL GROUP BY customer_id)""", """j AS (SELECT coalesce(p.pred, 0) AS pred, coalesce(tr.actual, 0) AS actual
  FROM (SELECT customer_id, CAST(risk_level <> 'low' AS INTEGER) AS pred FROM cls) p FULL JOIN tr ON tr.customer_id = p.customer_id)""",
    """m AS (SELECT count(*) FILTER (WHERE pred = 1 AND actual = 1) AS tp, count(*) FILTER (WHERE pred = 1 AND actual = 0) AS fp,
  count(*) FILTER (WHERE pred = 0 AND actual = 1) AS fn, count(*) FILTER (WHERE pred = 0 AND actual = 0) AS tn FROM j)""",
    """SELECT tp, fp, fn, tn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall,
  2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif((tp / nullif(tp + fp, 0)) + (tp / nullif(tp + fn, 0)), 0) AS f1 FROM m"""),
    dbl=["precision", "recall", "f1"])
def eval_metrics(s, sf):
    return H.eval_metrics(CLS(s, sf), T(s, sf))


# ============================================================ Q2 / D5 additions
@register("amount_stats_filtered", sql_plain(B.T_SQL, """tf AS (SELECT * FROM t WHERE "timestamp" >= TIMESTAMP '2024-01-03'
  AND "timestamp" < TIMESTAMP '2024-01-21' AND amount >= 500 AND amount <= 15000
  AND transaction_type IN ('deposit', 'transfer') AND channel IN ('branch', 'online', 'atm'))""",
    DESCRIBE_SQL.format(src="tf")))
def amount_stats_filtered(s, sf):
    """Q2: amount statistics of the rows a filter spec keeps."""
    return P.describe(Fl.apply_filters(T(s, sf), SPEC), "amount")


@register("forest_anomalies", _recursive(sql_t(*forest_ctes(CFG_T, ML), """SELECT quantile_cont(-isolation_forest_score, 0.1) AS threshold,
  count(*) FILTER (WHERE -isolation_forest_score < (SELECT quantile_cont(-isolation_forest_score, 0.1) FROM ifs)) AS anomalies,
  CAST(0.1 AS DOUBLE) AS contamination FROM ifs""")), dbl=["threshold", "contamination"])
def forest_anomalies(s, sf):
    """D5 on the forest scores: threshold and number of anomalies at the clamped contamination."""
    from ..operators.iforest import forest_anomalies as fa, isolation_forest_scores
    return fa(isolation_forest_scores(FEAT(s, sf), ML, cfg_t(s, sf)), cfg_t(s, sf))


# ============================================================ Q5 with the reference's filter-first scope
WIRE_ONLY = FilterSpec(transaction_types=("wire_transfer",))


@register("full_analysis_filtered", with_(*feature_ctes(
    "tw", CFG_T, source_ctes=[B.T_SQL, "tw AS (SELECT * FROM t WHERE transaction_type IN ('wire_transfer'))"]),
    *CLS_SQL) + "\nSELECT customer_id, anomaly_score, risk_level, escalation_action FROM cls",
    dbl=["anomaly_score"], digits=9)
def full_analysis_filtered(s, sf):
    """Q5 with scope='filtered': the filter spec applies before the features, so
    'wire only' leaves no deposits for structuring or rapid movement."""
    _, _, cls = Q.analyse(T(s, sf), C(s, sf), cfg_t(s, sf), spec=WIRE_ONLY, scope="filtered")
    return cls.select("customer_id", "anomaly_score", "risk_level", "escalation_action")
