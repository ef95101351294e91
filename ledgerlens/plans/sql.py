"""DuckDB oracle SQL generators.

Independent formulations of the operators (plain windows and self joins where
the Spark plans use bucketed, skew-safe shapes), parameterised by the same
``RiskConfig`` so both engines see identical thresholds.
"""

from __future__ import annotations

from ..config import KYC_STATUS_CODES, RISK_CATEGORY_CODES, RULE_OWNED_COLUMNS, RiskConfig
from ..sources.bindings import C_SQL, FB_SQL, HR_SQL, L_SQL, T_SQL

BINDINGS = {"t": T_SQL, "l": L_SQL}


def msum(expr: str = "amount", filt: str | None = None) -> str:
    return f"sum({expr})" + (f" FILTER (WHERE {filt})" if filt else "")


def d(x: float) -> str:
    """A DOUBLE literal (DuckDB reads bare decimals as DECIMAL)."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


def feature_ctes(src: str, cfg: RiskConfig, graph: bool = True, customers: bool = True,
                 source_ctes: list[str] | None = None) -> list[str]:
    """CTEs ending in ``feat``: the full feature matrix of binding ``src`` (or of a
    view ``src`` defined by ``source_ctes``, e.g. a filtered ledger)."""
    lo, hi = d(cfg.structuring_lower), d(cfg.ctr_threshold)
    ctes = (list(source_ctes) if source_ctes else [BINDINGS[src]]) + [HR_SQL]
    if customers:
        ctes.append(C_SQL)
    ctes += [
        f"""x AS (
  SELECT customer_id, transaction_id, "timestamp" AS ts, amount, transaction_type,
         coalesce(is_cash, false) AS cash,
         coalesce(is_cash, false) AND amount >= {lo} AND amount < {hi} AS near,
         coalesce(counterparty_country IN (SELECT country FROM hr), false) AS hrisk,
         counterparty_country
  FROM {src} WHERE customer_id IS NOT NULL)""",
        f"""gl AS (SELECT max("timestamp") AS now, min("timestamp") AS first FROM {src})""",
        f"""agg AS (
  SELECT customer_id,
    count(transaction_id) AS total_transactions, {msum()} AS total_amount, avg(amount) AS avg_amount,
    coalesce(stddev_samp(amount), 0)::DOUBLE AS std_amount, max(amount) AS max_amount, min(amount) AS min_amount,
    median(amount) AS median_amount,
    count(*) FILTER (WHERE near) AS cash_near_ctr_count,
    coalesce({msum(filt='near')}, 0)::DOUBLE AS cash_near_ctr_total,
    min(ts) FILTER (WHERE near) AS near_first, max(ts) FILTER (WHERE near) AS near_last,
    count(*) FILTER (WHERE cash) AS total_cash_transactions,
    count(*) FILTER (WHERE ts >= (SELECT now FROM gl) - INTERVAL '1 days') AS txn_count_1d,
    coalesce({msum(filt="ts >= (SELECT now FROM gl) - INTERVAL '1 days'")}, 0)::DOUBLE AS txn_volume_1d,
    count(*) FILTER (WHERE ts >= (SELECT now FROM gl) - INTERVAL '7 days') AS txn_count_7d,
    coalesce({msum(filt="ts >= (SELECT now FROM gl) - INTERVAL '7 days'")}, 0)::DOUBLE AS txn_volume_7d,
    count(*) FILTER (WHERE ts >= (SELECT now FROM gl) - INTERVAL '30 days') AS txn_count_30d,
    coalesce({msum(filt="ts >= (SELECT now FROM gl) - INTERVAL '30 days'")}, 0)::DOUBLE AS txn_volume_30d,
    min(ts) AS first_ts, max(ts) AS last_ts, count(ts) AS n_ts,
    count(*) FILTER (WHERE hrisk) AS high_risk_country_txns,
    coalesce({msum(filt='hrisk')}, 0)::DOUBLE AS high_risk_country_volume,
    count(DISTINCT counterparty_country) AS unique_countries,
    avg(CASE WHEN hour(ts) < 6 OR hour(ts) > 22 OR isodow(ts) >= 6
             THEN 1::DOUBLE ELSE 0::DOUBLE END) AS unusual_time_pct
  FROM x GROUP BY customer_id)""",
        """gaps AS (
  SELECT customer_id, date_diff('microsecond', lag(ts) OVER (PARTITION BY customer_id ORDER BY ts), ts) AS gap
  FROM x WHERE ts IS NOT NULL)""",
        """gapagg AS (SELECT customer_id, min(gap) AS min_gap_us, max(gap) AS max_gap_us FROM gaps GROUP BY customer_id)""",
        f"""cl AS (
  SELECT customer_id, max(c) AS structuring_cluster_max FROM (
    SELECT customer_id, count(*) OVER (PARTITION BY customer_id ORDER BY ts
           RANGE BETWEEN CURRENT ROW AND INTERVAL '{cfg.structuring_window_days} days' FOLLOWING) AS c
    FROM x WHERE near AND ts IS NOT NULL) GROUP BY customer_id)""",
        f"""rp AS (
  SELECT dp.customer_id, count(*) AS rapid_movement_count
  FROM x dp JOIN x o ON dp.customer_id = o.customer_id AND o.ts > dp.ts
       AND o.ts <= dp.ts + INTERVAL '{cfg.rapid_hours} hours' AND o.amount >= dp.amount * {d(cfg.rapid_ratio)}
  WHERE dp.transaction_type = 'deposit' AND dp.amount >= {d(cfg.rapid_min_deposit)}
    AND o.transaction_type IN ('transfer', 'wire_transfer')
  GROUP BY dp.customer_id)""",
        f"""base AS (
  SELECT a.customer_id, total_transactions, total_amount, avg_amount, std_amount, max_amount, min_amount,
    median_amount, cash_near_ctr_count, cash_near_ctr_total,
    coalesce(cl.structuring_cluster_max, 0) AS structuring_cluster_max,
    CASE WHEN cash_near_ctr_count = 0 THEN 0::DOUBLE WHEN cash_near_ctr_count = 1 THEN 999::DOUBLE
         ELSE date_diff('microsecond', near_first, near_last) / {d(3.6e9)} / (cash_near_ctr_count - 1) END
      AS near_ctr_avg_gap_hours,
    total_cash_transactions,
    coalesce(total_cash_transactions / nullif(total_transactions, 0), 0)::DOUBLE AS cash_transaction_pct,
    txn_count_1d, txn_volume_1d, txn_count_7d, txn_volume_7d, txn_count_30d, txn_volume_30d,
    (txn_count_7d / 7) / (CASE WHEN total_transactions / sp.span = 0 THEN {d(0.001)}
                          ELSE total_transactions / sp.span END) AS velocity_ratio_7d,
    (txn_count_30d / 30) / (CASE WHEN total_transactions / sp.span = 0 THEN {d(0.001)}
                            ELSE total_transactions / sp.span END) AS velocity_ratio_30d,
    CASE WHEN n_ts < 2 THEN 999::DOUBLE ELSE date_diff('microsecond', first_ts, last_ts) / {d(3.6e9)} / (n_ts - 1) END
      AS mean_gap_hours,
    CASE WHEN n_ts < 2 THEN 999::DOUBLE ELSE g.min_gap_us / {d(3.6e9)} END AS min_gap_hours,
    high_risk_country_txns, high_risk_country_volume,
    coalesce(high_risk_country_txns / nullif(total_transactions, 0), 0)::DOUBLE AS high_risk_country_pct,
    unique_countries,
    coalesce(rp.rapid_movement_count, 0) AS rapid_movement_count,
    CASE WHEN n_ts < 2 THEN 0 WHEN floor(g.max_gap_us / {d(86400e6)}) >= {cfg.dormancy_days} THEN 1 ELSE 0 END
      AS dormancy_flag,
    coalesce(unusual_time_pct, 0)::DOUBLE AS unusual_time_pct,
    std_amount / (CASE WHEN avg_amount = 0 THEN 1::DOUBLE ELSE avg_amount END) AS amount_cv
  FROM agg a
  CROSS JOIN (SELECT greatest(floor(date_diff('microsecond', first, now) / {d(86400e6)}), 1) AS span FROM gl) sp
  LEFT JOIN gapagg g ON g.customer_id = a.customer_id
  LEFT JOIN cl ON cl.customer_id = a.customer_id
  LEFT JOIN rp ON rp.customer_id = a.customer_id)""",
    ]
    last = "base"
    if graph:
        ctes += graph_ctes(src, cfg)
        ctes.append("""gfeat AS (
  SELECT b.*, coalesce(pr.rank, 0)::DOUBLE AS network_pagerank,
         coalesce(dg.network_in_degree, 0) AS network_in_degree,
         coalesce(dg.network_out_degree, 0) AS network_out_degree,
         coalesce(cf.circular_flow_count, 0) AS circular_flow_count
  FROM base b LEFT JOIN pr ON pr.node = b.customer_id LEFT JOIN dg ON dg.node = b.customer_id
  LEFT JOIN cf ON cf.node = b.customer_id)""")
        last = "gfeat"
    if customers:
        rc = " ".join(f"WHEN '{k}' THEN {v}" for k, v in RISK_CATEGORY_CODES)
        kc = " ".join(f"WHEN '{k}' THEN {v}" for k, v in KYC_STATUS_CODES)
        ctes.append(f"""feat AS (
  SELECT f.*, cu.risk_category, coalesce(CAST(cu.pep_flag AS INTEGER), 0) AS pep_flag, cu.kyc_status,
         cu.account_type,
         CASE cu.risk_category {rc} ELSE 0 END AS risk_category_encoded,
         CASE cu.kyc_status {kc} ELSE 0 END AS kyc_status_encoded
  FROM {last} f LEFT JOIN c cu ON cu.customer_id = f.customer_id)""")
    else:
        ctes.append(f"feat AS (SELECT * FROM {last})")
    return ctes


def graph_ctes(src: str, cfg: RiskConfig) -> list[str]:
    """Edges ``e``, degrees ``dg``, PageRank ``pr`` (K unrolled iterations),
    cycles ``cyc2``/``cyc3``/``cyc4`` and per-node totals ``cf``."""
    alpha = d(cfg.pagerank_alpha)
    ctes = [
        f"""e AS (
  SELECT DISTINCT customer_id AS src, counterparty_id AS dst FROM {src}
  WHERE transaction_type IN ('transfer', 'wire_transfer') AND counterparty_id IS NOT NULL
    AND customer_id IS NOT NULL AND CAST(counterparty_id AS VARCHAR) <> '')""",
        """dg AS (
  SELECT coalesce(o.node, i.node) AS node, coalesce(i.n, 0) AS network_in_degree,
         coalesce(o.n, 0) AS network_out_degree
  FROM (SELECT src AS node, count(*) AS n FROM e GROUP BY src) o
  FULL JOIN (SELECT dst AS node, count(*) AS n FROM e GROUP BY dst) i ON o.node = i.node)""",
        """nd AS (SELECT n.node, count(e.src) AS outdeg
  FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) n LEFT JOIN e ON e.src = n.node GROUP BY n.node)""",
        """nn AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM nd)""",
        """r0 AS (SELECT node, outdeg, 1::DOUBLE / (SELECT n FROM nn) AS rank FROM nd)""",
    ]
    for k in range(1, cfg.pagerank_iterations + 1):
        p = f"r{k - 1}"
        ctes.append(f"""r{k} AS (
  SELECT r.node, r.outdeg,
         {alpha} * (coalesce(c.inflow, 0::DOUBLE)
                    + (SELECT coalesce(sum(rank) FILTER (WHERE outdeg = 0), 0::DOUBLE) FROM {p})
                      * (1::DOUBLE / (SELECT n FROM nn)))
         + (1::DOUBLE - {alpha}) * (1::DOUBLE / (SELECT n FROM nn)) AS rank
  FROM {p} r LEFT JOIN (SELECT e.dst AS node, sum(q.rank / q.outdeg) AS inflow
                        FROM e JOIN {p} q ON e.src = q.node GROUP BY e.dst) c ON c.node = r.node)""")
    ctes.append(f"pr AS (SELECT node, rank FROM r{cfg.pagerank_iterations})")
    ctes += [
        """se AS (SELECT src, dst FROM e WHERE src <> dst)""",
        """cyc2 AS (SELECT [a.src, a.dst] AS members FROM se a JOIN se b ON a.dst = b.src AND b.dst = a.src
  WHERE a.src < a.dst)""",
        """cyc3 AS (SELECT [a.src, a.dst, b.dst] AS members FROM se a JOIN se b ON a.dst = b.src
  JOIN se c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst)""",
        """cyc4 AS (SELECT [a.src, a.dst, b.dst, c.dst] AS members FROM se a JOIN se b ON a.dst = b.src
  JOIN se c ON b.dst = c.src JOIN se f ON c.dst = f.src AND f.dst = a.src
  WHERE a.src < a.dst AND a.src < b.dst AND a.src < c.dst AND a.dst <> c.dst)""",
    ]
    parts = " UNION ALL ".join(f"SELECT unnest(members) AS node FROM cyc{k}" for k in range(2, cfg.cycle_max_len + 1))
    ctes.append(f"""cf AS (SELECT node, count(*) AS circular_flow_count FROM ({parts}) GROUP BY node)""")
    return ctes


def ml_feature_names(cols: list[str]) -> list[str]:
    return [c for c in cols if c not in RULE_OWNED_COLUMNS]


# numeric feature columns of the full matrix, in matrix order (schema of `feat`)
FEATURE_NUMERIC = [
    "total_transactions", "total_amount", "avg_amount", "std_amount", "max_amount", "min_amount", "median_amount",
    "cash_near_ctr_count", "cash_near_ctr_total", "structuring_cluster_max", "near_ctr_avg_gap_hours",
    "total_cash_transactions", "cash_transaction_pct",
    "txn_count_1d", "txn_volume_1d", "txn_count_7d", "txn_volume_7d", "txn_count_30d", "txn_volume_30d",
    "velocity_ratio_7d", "velocity_ratio_30d", "mean_gap_hours", "min_gap_hours",
    "high_risk_country_txns", "high_risk_country_volume", "high_risk_country_pct", "unique_countries",
    "rapid_movement_count", "dormancy_flag", "unusual_time_pct", "amount_cv",
    "network_pagerank", "network_in_degree", "network_out_degree", "circular_flow_count",
    "pep_flag", "risk_category_encoded", "kyc_status_encoded",
]


def rule_terms_sql(cfg: RiskConfig) -> list[tuple[str, str, str]]:
    """(name, hit, weighted contribution) in the reference's order."""
    def clip(e, lo, hi):
        return f"least(greatest({e}, {d(lo)}), {d(hi)})"
    s_hit = f"(cash_near_ctr_count >= {cfg.structuring_count} OR structuring_cluster_max >= {cfg.structuring_count})"
    v_hit = f"(velocity_ratio_7d >= {d(cfg.velocity_multiplier)})"
    r_hit = "(rapid_movement_count > 0)"
    g_hit = f"(high_risk_country_pct > {d(cfg.geo_rule_cut)})"
    dm_hit = "(dormancy_flag = 1)"
    c_hit = "(circular_flow_count > 0)"
    return [
        ("structuring", s_hit,
         f"(CASE WHEN {s_hit} THEN {clip(f'cash_near_ctr_count / {d(cfg.structuring_full)}', cfg.structuring_floor, 1.0)} ELSE 0::DOUBLE END) * {d(cfg.rule_structuring_w)}"),
        ("velocity_spike", v_hit,
         f"(CASE WHEN {v_hit} THEN {clip(f'velocity_ratio_7d / {d(cfg.velocity_full)}', cfg.velocity_floor, 1.0)} ELSE 0::DOUBLE END) * {d(cfg.rule_velocity_w)}"),
        ("rapid_movement", r_hit,
         f"(CASE WHEN {r_hit} THEN {clip(f'rapid_movement_count / {d(cfg.rapid_full)}', cfg.rapid_floor, 1.0)} ELSE 0::DOUBLE END) * {d(cfg.rule_rapid_w)}"),
        ("geographic_risk", g_hit,
         f"(CASE WHEN {g_hit} THEN least(high_risk_country_pct, {d(1.0)}) ELSE 0::DOUBLE END) * {d(cfg.rule_geo_w)}"),
        ("dormancy_activation", dm_hit, f"(CASE WHEN {dm_hit} THEN {d(cfg.rule_dormancy_add)} ELSE 0::DOUBLE END)"),
        ("round_tripping", c_hit,
         f"(CASE WHEN {c_hit} THEN {clip(f'circular_flow_count / {d(cfg.circular_full)}', cfg.circular_floor, 1.0)} ELSE 0::DOUBLE END) * {d(cfg.rule_circular_w)}"),
    ]


def rule_score_sql(cfg: RiskConfig) -> str:
    s = "0::DOUBLE"
    for _, _, contrib in rule_terms_sql(cfg):
        s = f"({s} + {contrib})"
    s = f"(CASE WHEN pep_flag = 1 THEN {s} * {d(cfg.pep_multiplier)} ELSE {s} END)"
    s = f"(CASE WHEN kyc_status_encoded >= 1 THEN {s} + {d(cfg.kyc_add)} ELSE {s} END)"
    return f"least(greatest({s}, 0::DOUBLE), 1::DOUBLE)"


_SQL_DECIMALS = {"money": 0, "ratio": 1, "rank": 4, "score": 3}


def sentence_sql(segments, prefix: str = "f.") -> str:
    """A sentence of ``explain.sentences`` as a SQL expression."""
    def one(seg):
        if isinstance(seg, str):
            return "'" + seg.replace("'", "''") + "'"
        kind, value = seg
        x = f"CAST(coalesce({prefix if value != 'anomaly_score' else ''}{value}, 0) AS DOUBLE)" if isinstance(value, str) else d(value)
        if kind == "count":
            return f"CAST(CAST({x} AS BIGINT) AS VARCHAR)"
        if kind == "percent":
            return f"CAST(CAST(round_even({x} * 100, 0) AS BIGINT) AS VARCHAR)"
        n = _SQL_DECIMALS[kind]
        return f"format('{{:,.{n}f}}', round_even({x}, {n}))"
    return " || ".join(one(s) for s in segments)


def _div(i: int) -> str:
    return (f"(CASE WHEN st.s_{i} <= CAST(1e-12 AS DOUBLE) * greatest(1::DOUBLE, abs(st.m_{i})) "
            f"THEN 1::DOUBLE ELSE st.s_{i} END)")


def zscore_ctes(cfg: RiskConfig, cols: list[str], src: str = "feat") -> list[str]:
    """``zs``: customer_id, max_z, zscore_score."""
    stats = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{i}, stddev_samp(CAST({c} AS DOUBLE)) AS s_{i}"
                      for i, c in enumerate(cols))
    zs = ", ".join(f"abs(CAST(f.{c} AS DOUBLE) - st.m_{i}) / {_div(i)}" for i, c in enumerate(cols))
    return [f"st AS (SELECT {stats} FROM {src})",
            f"zs0 AS (SELECT f.customer_id, greatest({zs}) AS max_z FROM {src} f CROSS JOIN st)",
            f"zs AS (SELECT customer_id, max_z, CASE WHEN max_z IS NULL THEN NULL ELSE least(max_z, {d(cfg.zscore_cap)}) END / {d(cfg.zscore_cap)} AS zscore_score FROM zs0)"]


def standardize_sql(cols: list[str], src: str = "feat") -> tuple[str, str]:
    stats = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{i}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{i}"
                      for i, c in enumerate(cols))
    body = ", ".join(f"(CAST(f.{c} AS DOUBLE) - st.m_{i}) / {_div(i)} AS {c}" for i, c in enumerate(cols))
    return f"st AS (SELECT {stats} FROM {src})", f"SELECT f.customer_id, {body} FROM {src} f CROSS JOIN st"


def forest_ctes(cfg: RiskConfig, cols: list[str], src: str = "feat") -> list[str]:
    """``ifs``: customer_id, isolation_forest_score. Grows the trees level by level and walks them, both by recursion."""
    prime = 2 ** 31 - 1
    num = lambda text, start, n: f"CAST('0x' || substr(md5({text}), {start}, {n}) AS BIGINT)"
    x = ", ".join(f"CAST(CAST(coalesce({c}, 0) AS FLOAT) AS DOUBLE)" for c in cols)
    key = f"'{cfg.forest_seed}:' || tree || ':' || node"
    path = lambda n: f"(CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1) + 0.5772156649015329::DOUBLE) - 2 * ({n} - 1)::DOUBLE / {n} WHEN {n} = 2 THEN 1 ELSE 0 END)"

    def splits(nodes: str) -> str:
        return f"""SELECT tree, node, c[1 + {num(key, 1, 8)} % len(c)] AS s, {num(key, 9, 13)} / 4503599627370496::DOUBLE AS u FROM (
    SELECT tree, node, list(struct_pack(f := f, lo := lo, hi := hi) ORDER BY f) AS c FROM (
      SELECT tree, node, f, min(v) AS lo, max(v) AS hi FROM (SELECT tree, node, unnest(x) AS v, unnest(range(1, {len(cols) + 1})) AS f FROM {nodes}) i
      GROUP BY tree, node, f HAVING max(v) > min(v)) k GROUP BY tree, node) p"""
    side = "CASE WHEN {x}[s.f] < s.lo + u * (s.hi - s.lo) THEN 0 ELSE 1 END"
    return [f"fx AS (SELECT customer_id, [{x}] AS x, {num('CAST(customer_id AS VARCHAR)', 1, 15)} % {prime} AS h FROM {src})",
            f"""fn AS (SELECT psi, CAST(ceil(log2(greatest(psi, 2))) AS INTEGER) AS deep FROM (
  SELECT least({cfg.forest_sample}, greatest(count(*), 1)) AS psi FROM fx))""",
            f"""ft AS (SELECT tree, 1 + {num(f"'{cfg.forest_seed}:' || tree || ':a'", 1, 15)} % {prime - 1} AS a,
  {num(f"'{cfg.forest_seed}:' || tree || ':b'", 1, 15)} % {prime} AS b FROM (SELECT range AS tree FROM range({cfg.forest_trees})))""",
            f"""fs AS (SELECT tree, customer_id, x FROM (SELECT tree, customer_id, x,
  row_number() OVER (PARTITION BY tree ORDER BY (h * a + b) % {prime}, customer_id) AS nth FROM fx, ft), fn WHERE nth <= psi)""",
            f"""fg AS (SELECT tree, CAST(1 AS BIGINT) AS node, 0 AS depth, x FROM fs
  UNION ALL SELECT g.tree, 2 * g.node + {side.format(x="g.x")}, g.depth + 1, g.x
  FROM fg g JOIN ({splits("fg")}) q ON q.tree = g.tree AND q.node = g.node, fn WHERE g.depth < fn.deep)""",
            f"fq AS ({splits('(SELECT fg.* FROM fg, fn WHERE depth < deep)')})",
            "fz AS (SELECT tree, node, count(*) AS n FROM fg GROUP BY tree, node)",
            f"""fw AS (SELECT customer_id, tree, CAST(1 AS BIGINT) AS node, 0 AS depth FROM fx, ft
  UNION ALL SELECT w.customer_id, w.tree, 2 * w.node + {side.format(x="fx.x")}, w.depth + 1
  FROM fw w JOIN fq ON fq.tree = w.tree AND fq.node = w.node JOIN fx ON fx.customer_id = w.customer_id)""",
            f"""fr AS (SELECT customer_id, round(-pow(2::DOUBLE, -avg(depth + {path('coalesce(n, 0)')}) / coalesce(nullif(any_value({path('psi')}), 0), 1)), 12) AS raw
  FROM (SELECT customer_id, tree, max(node) AS node, max(depth) AS depth FROM fw GROUP BY customer_id, tree) e LEFT JOIN fz USING (tree, node), fn GROUP BY customer_id)""",
            """ifs AS (SELECT customer_id, 1 - (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER () + 1e-10::DOUBLE) AS isolation_forest_score FROM fr)"""]


def level_sql(score: str, cfg: RiskConfig) -> str:
    return (f"CASE WHEN {score} <= {d(cfg.risk_low_upper)} THEN 'low' WHEN {score} <= {d(cfg.risk_medium_upper)} "
            f"THEN 'medium' WHEN {score} <= {d(cfg.risk_high_upper)} THEN 'high' ELSE 'critical' END")


def action_sql(level: str) -> str:
    return (f"CASE {level} WHEN 'low' THEN 'no_action' WHEN 'medium' THEN 'monitor' "
            f"WHEN 'high' THEN 'flag_for_review' ELSE 'file_sar' END")


def classify_ctes(cfg: RiskConfig, scores: str = "sc") -> list[str]:
    """``cls``: classification of ``scores`` (customer_id, anomaly_score) with
    PEP / KYC context from ``feat`` and customer columns from ``c``."""
    lv0 = level_sql("s.anomaly_score", cfg)
    return [f"""cls0 AS (
  SELECT s.*, {lv0} AS lv0, f.pep_flag AS ctx_pep, f.kyc_status_encoded AS ctx_kyc
  FROM {scores} s LEFT JOIN feat f ON f.customer_id = s.customer_id)""",
            f"""cls1 AS (SELECT *, CASE WHEN coalesce(ctx_pep = 1, false) AND lv0 = 'medium' THEN 'high' ELSE lv0 END AS lv1 FROM cls0)""",
            f"""cls2 AS (SELECT *, CASE WHEN coalesce(ctx_pep = 1, false) AND lv1 = 'high' AND anomaly_score > {d(cfg.pep_critical_cut)}
                         THEN 'critical' ELSE lv1 END AS lv2 FROM cls1)""",
            f"""cls3 AS (SELECT *, CASE WHEN coalesce(ctx_kyc = 2, false) AND lv2 = 'low' AND anomaly_score > {d(cfg.kyc_medium_cut)}
                         THEN 'medium' ELSE lv2 END AS risk_level FROM cls2)""",
            f"""cls AS (
  SELECT k.* EXCLUDE (lv0, lv1, lv2, ctx_pep, ctx_kyc), {action_sql('k.risk_level')} AS escalation_action,
         cu.name, cu.account_type, cu.country, cu.pep_flag
  FROM cls3 k LEFT JOIN c cu ON cu.customer_id = k.customer_id)"""]


__all__ = ["with_", "feature_ctes", "forest_ctes", "graph_ctes", "zscore_ctes", "rule_score_sql", "rule_terms_sql",
           "classify_ctes", "sentence_sql", "level_sql", "action_sql", "d", "FB_SQL", "C_SQL", "HR_SQL", "T_SQL", "L_SQL",
           "FEATURE_NUMERIC", "ml_feature_names"]
