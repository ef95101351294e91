"""Transfer graph as joins and aggregations over an edge frame.

* edges: distinct (src, dst) of transfers/wires with a counterparty;
* degrees: two ``groupBy`` counts (self loops count in both);
* PageRank: iterative join + aggregate; lineage cut with ``checkpoint()`` into the
  session's ``spark.checkpoint.dir`` (reliable storage, survives executor loss);
* cycles of length 2..max_len: edges of nodes without an edge in or out lie on no
  cycle and go first (``cycle_edges``); each directed simple cycle belongs to
  its highest (degree, id)-ranked node; all 2-paths are wedges centred below that
  node (O(m^1.5) for any degree skew) and 4-cycles meet in the middle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RiskConfig
from ..functions.heavy import heavy_keys
from ..session import ensure_checkpoint_dir, stored

#: a hub's edges are dealt out to so many blocks
HUB_BLOCKS = 256
#: how often edges on no cycle are dropped before cycles are searched; the cycles are the same for any number
TRIM_ROUNDS = 2


def transfer_edges(tx: DataFrame) -> DataFrame:
    """Distinct directed edges customer -> counterparty of transfers and wires."""
    cp = F.col("counterparty_id")
    e = tx.filter(F.col("transaction_type").isin("transfer", "wire_transfer") & cp.isNotNull()
                  & F.col("customer_id").isNotNull()
                  & (cp.cast("string") != ""))
    return e.select(F.col("customer_id").alias("src"), cp.cast(tx.schema["customer_id"].dataType).alias("dst")) \
        .distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """in/out degree of every node."""
    outd = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("network_out_degree"))
    ind = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("network_in_degree"))
    return outd.join(ind, "node", "full").select(
        "node", F.coalesce("network_in_degree", F.lit(0)).alias("network_in_degree"),
        F.coalesce("network_out_degree", F.lit(0)).alias("network_out_degree"))


def edge_blocks(edges: DataFrame, cfg: RiskConfig) -> tuple[DataFrame, DataFrame]:
    """(edges with ``block``, hubs): the edges of a hub (the 1,024 sources at most with the most edges and more than
    ``cfg.heavy_rows``) lie in ``HUB_BLOCKS`` blocks by their target, all others' in block 0."""
    hubs = heavy_keys(edges, "src", cfg.heavy_rows).withColumn("_hub", F.lit(True))
    block = F.when(F.col("_hub"), F.pmod(F.xxhash64("dst"), F.lit(HUB_BLOCKS))).otherwise(F.lit(0)).cast("int")
    return edges.join(F.broadcast(hubs), "src", "left").select("src", "dst", block.alias("block")), hubs


def pagerank(edges: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """PageRank with uniform teleport and dangling mass spread evenly.

    Iterates until the L1 change is below nodes * ``cfg.pagerank_tol`` (one 1-row aggregate per check; with a damping
    of 0.85 some 90 steps at most). ``cfg.pagerank_iterations`` sets a fixed number of steps instead. Edges are
    partitioned on (source, block) once, so that no step shuffles them and no partition holds a hub; a hub's share is
    sent to each of its blocks. The frames of nodes are joined by hashed partitions: they grow with the graph, and a
    broadcast in every step would send them all through the driver. Every ``cfg.pagerank_checkpoint_every`` steps end in a reliable checkpoint, where the
    change is checked.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    dealt, hubs = edge_blocks(edges, cfg)
    edges = dealt.repartition("src", "block").checkpoint()
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    outd = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("outdeg"))
    nodes = nodes.join(outd.hint("shuffle_hash"), "node", "left").select("node", F.coalesce("outdeg", F.lit(0)).alias("outdeg"))
    nodes = nodes.join(F.broadcast(hubs.withColumnRenamed("src", "node")), "node", "left").select(
        "node", "outdeg", F.when(F.col("_hub"), F.lit(HUB_BLOCKS)).otherwise(F.lit(1)).alias("blocks")).checkpoint()
    # node count: one scalar subquery, stored as a constant column in the checkpoint
    nodes = nodes.withColumn("inv_n", F.lit(1.0) / nodes.select(F.count(F.lit(1)).cast("double")).scalar())
    alpha = F.lit(cfg.pagerank_alpha)
    inv_n = F.col("inv_n")
    own = ["node", "outdeg", "blocks", "inv_n"]
    rank = nodes.select(*own, inv_n.alias("rank"))
    step = 0
    while cfg.pagerank_iterations is None or step < cfg.pagerank_iterations:
        senders = rank.filter(F.col("outdeg") > 0).select(
            F.col("node").alias("src"), F.try_divide(F.col("rank"), F.col("outdeg")).alias("share"),
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        contrib = edges.join(senders.hint("shuffle_hash"), ["src", "block"]).groupBy(F.col("dst").alias("node")).agg(F.sum("share").alias("inflow"))
        dangling = rank.select(F.coalesce(F.sum(F.when(F.col("outdeg") == 0, F.col("rank"))), F.lit(0.0))).scalar()
        new = rank.join(contrib.hint("shuffle_hash"), "node", "left").select(
            *own,
            (alpha * (F.coalesce(F.col("inflow"), F.lit(0.0)) + dangling * inv_n)
             + (F.lit(1.0) - alpha) * inv_n).alias("rank"),
            F.col("rank").alias("prev"))
        step += 1
        if step % max(cfg.pagerank_checkpoint_every, 1) == 0:
            new = new.checkpoint()
            if cfg.pagerank_iterations is None:
                change, n = new.agg(F.sum(F.abs(F.col("rank") - F.col("prev"))), F.count(F.lit(1))).first()
                if not n or change < n * cfg.pagerank_tol:
                    rank = new.drop("prev")
                    break
        rank = new.drop("prev")
    return rank.select("node", F.col("rank").alias("network_pagerank"))


def _simple_edges(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("src") != F.col("dst")).select("src", "dst").distinct()


def cycle_edges(edges: DataFrame) -> DataFrame:
    """Simple edges without most that lie on no cycle: ``TRIM_ROUNDS`` times, those go whose source no edge enters or
    whose target no edge leaves. A ledger's customers and their counterparties are mostly one or the other."""
    e = stored(_simple_edges(edges))
    for _ in range(TRIM_ROUNDS):
        entered = e.select(F.col("dst").alias("src")).distinct().hint("shuffle_hash")
        left = e.select(F.col("src").alias("dst")).distinct().hint("shuffle_hash")
        e = stored(e.join(entered, "src", "left_semi").join(left, "dst", "left_semi").select("src", "dst"))
    return e


def _ranked_edges(edges: DataFrame) -> DataFrame:
    """``cycle_edges`` with the (degree, id) rank of both ends, stored: ds/dd = total degree among them."""
    e = cycle_edges(edges)
    deg = e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))) \
        .groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    e = e.join(deg.select(F.col("node").alias("src"), F.col("d").alias("ds")).hint("shuffle_hash"), "src")
    return stored(e.join(deg.select(F.col("node").alias("dst"), F.col("d").alias("dd")).hint("shuffle_hash"), "dst"))


def _above(d1, n1, d2, n2):
    """(d1, n1) ranks above (d2, n2): higher degree, ties by id."""
    return (d1 > d2) | ((d1 == d2) & (n1 > n2))


def cycles(edges: DataFrame, length: int, ranked: DataFrame | None = None) -> DataFrame:
    """Directed simple cycles of one length, one row each, as ``members`` (cycle
    order). Self loops are not cycles here.

    Each cycle is enumerated once, from its highest-ranked node v (rank = total
    degree, then id). Every intermediate 2-path is a wedge centred on a node
    ranked below v, so a hub is never the centre of wedges from lower-ranked
    nodes: the 2-path frames stay O(m^1.5) for m edges however skewed the degrees
    (the classic degree-ordering bound), and the final joins emit cycles only."""
    if length == 2:
        e = _simple_edges(edges)
        a = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).filter(F.col("a") < F.col("b"))
        back = e.select(F.col("src").alias("b2"), F.col("dst").alias("a2"))
        c = a.join(back, (F.col("b") == F.col("b2")) & (F.col("a") == F.col("a2")))
        return c.select(F.array("a", "b").alias("members"))
    if length not in (3, 4):
        raise ValueError("cycle length must be 2, 3 or 4")
    r = ranked if ranked is not None else _ranked_edges(edges)
    p1 = _down_paths(r)
    if length == 3:
        close = r.select(F.col("src").alias("w"), F.col("dst").alias("v"))
        c = p1.join(close, ["w", "v"])
        return c.select(F.array("v", "u", "w").alias("members"))
    first, second = _four_cycle_halves(r, p1)
    c = first.join(second, ["v", "w"]).filter(F.col("u") != F.col("x"))
    return c.select(F.array("v", "u", "w", "x").alias("members"))


def _four_cycle_halves(r: DataFrame, p1: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(v, u, w) and (w, x, v): the 2-paths from the highest-ranked node v to w and back."""
    # second half w -> x -> v: a wedge centred on x, ranked below v
    up = r.filter(_above(F.col("dd"), F.col("dst"), F.col("ds"), F.col("src"))) \
        .select(F.col("src").alias("x"), F.col("dst").alias("v"), F.col("dd").alias("dv2"))
    into = r.select(F.col("src").alias("w"), F.col("ds").alias("dw2"), F.col("dst").alias("x"))
    p2 = into.join(up, "x").filter(_above(F.col("dv2"), F.col("v"), F.col("dw2"), F.col("w")))
    return p1.select("v", "u", "w"), p2.select("w", "x", "v")


def _down_paths(r: DataFrame) -> DataFrame:
    """v -> u -> w with v ranked above u and w."""
    down = r.filter(_above(F.col("ds"), F.col("src"), F.col("dd"), F.col("dst"))) \
        .select(F.col("src").alias("v"), F.col("ds").alias("dv"), F.col("dst").alias("u"))
    step = r.select(F.col("src").alias("u"), F.col("dst").alias("w"), F.col("dd").alias("dw"))
    return down.join(step, "u").filter(_above(F.col("dv"), F.col("v"), F.col("dw"), F.col("w")))


def _wedge_rows(r: DataFrame) -> DataFrame:
    """(v, w, c, f, b, e): for each pair with v ranked above w, its centres with flags: f for v -> c -> w, b for
    w -> c -> v; and rows without centre, e = 1, for an edge w -> v. Wedges are built once, here."""
    first, second = _four_cycle_halves(r, _down_paths(r))
    row = lambda df, c, **flags: df.select("v", "w", c.alias("c"), *[F.lit(flags.get(k, 0)).cast("long").alias(k) for k in ("f", "b", "e")])
    back = r.filter(_above(F.col("dd"), F.col("dst"), F.col("ds"), F.col("src"))).select(F.col("dst").alias("v"), F.col("src").alias("w"))
    rows = row(first, F.col("u"), f=1).unionByName(row(second, F.col("x"), b=1)).unionByName(
        row(back, F.lit(None).cast(r.schema["src"].dataType), e=1))
    return rows.groupBy("v", "w", "c").agg(*[F.max(k).alias(k) for k in ("f", "b", "e")])


def _long_cycle_counts(r: DataFrame, lengths: set[int]) -> DataFrame:
    """(node, n): cycles of length 3 and 4 through each node, from one pass over the wedges and without listing one.

    Of a pair (v, w), each centre u of v -> u -> w closes a 3-cycle if w -> v is an edge, and a 4-cycle with each
    centre x of w -> x -> v but itself. The pair's totals join back to its centres; a pair of hubs with very many
    centres is split by adaptive execution, as nothing is gathered per pair.
    """
    rows = _wedge_rows(r)
    pairs = rows.groupBy("v", "w").agg(F.sum("f").alias("na"), F.sum("b").alias("nb"), F.max("e").alias("ne")).filter(
        (F.col("na") > 0) & ((F.col("nb") > 0) | (F.col("ne") > 0)))
    met = rows.filter(F.col("c").isNotNull()).join(pairs, ["v", "w"])
    zero = F.lit(0).cast("long")
    three = F.col("f") * F.col("ne") if 3 in lengths else zero
    # a centre as u, and the same centre as x: itself is no partner
    as_u, as_x = (F.col("f") * (F.col("nb") - F.col("b")), F.col("b") * (F.col("na") - F.col("f"))) if 4 in lengths else (zero, zero)
    parts = F.array(F.struct(F.col("v").alias("node"), (three + as_u).alias("n")), F.struct(F.col("w").alias("node"), (three + as_u).alias("n")),
                    F.struct(F.col("c").alias("node"), (three + as_u + as_x).alias("n")))
    return met.select(F.explode(parts).alias("p")).groupBy("p.node").agg(F.sum("p.n").alias("n")).filter("n > 0")


def _two_cycle_counts(r: DataFrame) -> DataFrame:
    return cycles(r, 2).select(F.explode("members").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))


def cycle_counts(edges: DataFrame, length: int) -> DataFrame:
    """Per node: number of simple cycles of exactly this length through it."""
    if length not in (2, 3, 4):
        raise ValueError("cycle length must be 2, 3 or 4")
    r = _ranked_edges(edges)
    n = _two_cycle_counts(r) if length == 2 else _long_cycle_counts(r, {length})
    return n.select("node", F.col("n").alias("cycles"))


def circular_flow(edges: DataFrame, max_len: int = 4) -> DataFrame:
    """Per node, simple cycles of length 2..max_len through it. The ranked edges are stored once (no more than the
    edge list); wedges are built once for the lengths 3 and 4 together."""
    if not 2 <= max_len <= 4:
        raise ValueError("cycles are counted up to a length of 2, 3 or 4")
    ranked = _ranked_edges(edges)
    total = _two_cycle_counts(ranked)
    if max_len > 2:
        total = total.unionByName(_long_cycle_counts(ranked, set(range(3, max_len + 1))))
    return total.groupBy("node").agg(F.sum("n").alias("circular_flow_count"))


def graph_features(tx: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """A16-A18 keyed by customer_id (nodes that are only counterparties drop out
    at the caller's left join)."""
    # distinct edges are read by PageRank, degrees and the cycle search: stored once
    edges = stored(transfer_edges(tx))
    pr = pagerank(edges, cfg)
    deg = degrees(edges)
    cyc = circular_flow(edges, cfg.cycle_max_len)
    out = pr.join(deg.hint("shuffle_hash"), "node", "left").join(cyc.hint("shuffle_hash"), "node", "left")
    return out.select(F.col("node").alias("customer_id"), "network_pagerank",
                      "network_in_degree", "network_out_degree",
                      F.coalesce("circular_flow_count", F.lit(0)).alias("circular_flow_count"))
