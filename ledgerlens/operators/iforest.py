"""Isolation forest on Spark.

Liu, Ting & Zhou (2008): each tree isolates a subsample of psi rows by random
axis-parallel splits; anomalies have short average path lengths.
Score s(x) = 2 ** (-E[h(x)] / c(psi)).

Spark shape:
1. sampling: every row has one hash, and a tree orders the rows by a linear map of it modulo a prime (JVM
   expressions); rows under an oversampling threshold are exploded to (tree, row) and each tree keeps its psi
   smallest -- an exact without-replacement sample that never moves the feature matrix through one task;
2. training: ``groupBy(tree).applyInPandas`` grows each tree from <= 2 psi rows;
3. model: the node table is bounded by trees * (2 psi - 1) rows regardless of the
   data size (102,200 at the defaults), so it is broadcast to the scorers;
4. scoring: ``mapInPandas`` walks all trees vectorised per Arrow batch.

Every random choice is an integer of an MD5 of (seed, tree, node), and values are single-precision, so that any engine
can grow the same forest; the registered keys have an oracle that grows and walks it in SQL.

Trees are invariant to per-column affine maps (split points are drawn uniformly
between the node's min and max), so D2 scaling is not applied before training.
"""

from __future__ import annotations

import hashlib
import math
import sys
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RiskConfig

try:  # ship this module's helpers inside the task closures (no package install on workers)
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover
    pass

EULER = 0.5772156649015329
NODE_SCHEMA = "tree int, node int, feat int, thr double, left int, right int, size int"


def c_factor(n: np.ndarray | float) -> np.ndarray:
    """Average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[n == 2] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


#: a prime; the order of a tree's rows is (a * hash + b) modulo it
PRIME = 2 ** 31 - 1


def _digits(*key) -> str:
    return hashlib.md5(":".join(map(str, key)).encode()).hexdigest()


def _tree_map(seed: int, tree: int) -> tuple[int, int]:
    return 1 + int(_digits(seed, tree, "a")[:15], 16) % (PRIME - 1), int(_digits(seed, tree, "b")[:15], 16) % PRIME


def _grow(x: np.ndarray, seed: int, tree: int, max_depth: int):
    """Grow one isolation tree; returns node rows (node, feat, thr, left, right, size).

    A node splits the feature and at the fraction that the digits of (seed, tree, place) say; places count as in a
    heap (the children of p are 2 p and 2 p + 1)."""
    nodes = []

    def build(idx: np.ndarray, depth: int, place: int) -> int:
        me = len(nodes)
        nodes.append(None)
        sub = x[idx]
        if depth >= max_depth or len(idx) <= 1:
            nodes[me] = (me, -1, 0.0, -1, -1, len(idx))
            return me
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if cand.size == 0:
            nodes[me] = (me, -1, 0.0, -1, -1, len(idx))
            return me
        key = _digits(seed, tree, place)
        f = int(cand[int(key[:8], 16) % cand.size])
        thr = float(lo[f] + int(key[8:21], 16) / 16 ** 13 * (hi[f] - lo[f]))
        left_mask = sub[:, f] < thr
        left = build(idx[left_mask], depth + 1, 2 * place)
        right = build(idx[~left_mask], depth + 1, 2 * place + 1)
        nodes[me] = (me, f, thr, left, right, len(idx))
        return me

    build(np.arange(x.shape[0]), 0, 1)
    return nodes


def fit_forest(feat: DataFrame, cols: Sequence[str], cfg: RiskConfig = RiskConfig(),
               n: int | None = None) -> DataFrame:
    """Train; returns the node table (tree, node, feat, thr, left, right, size)."""
    n = feat.count() if n is None else n
    psi = min(cfg.forest_sample, max(n, 1))
    trees = cfg.forest_trees
    # oversample 2x (plus slack) so each tree almost surely gets psi candidates
    p = min(1.0, (2.0 * psi + 32.0) / max(n, 1))
    maps = [_tree_map(cfg.forest_seed, t) for t in range(trees)]
    a, b = (F.array(*[F.lit(m[i]).cast("long") for m in maps]) for i in (0, 1))
    own = F.conv(F.substring(F.md5(F.col("customer_id").cast("string")), 1, 15), 16, 10).cast("long") % PRIME
    place = lambda t: (F.col("_own") * F.get(a, t) + F.get(b, t)) % PRIME
    x = F.array(*[F.coalesce(F.col(c).cast("float").cast("double"), F.lit(0.0)) for c in cols])
    drawn = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), place(t).alias("h")))
    cand = feat.select("customer_id", x.alias("x"), own.alias("_own")).select(
        "customer_id", "x", F.explode(F.filter(drawn, lambda d: d["h"] < math.ceil(p * PRIME))).alias("d")).select("customer_id", "x", "d.*")
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    seed = cfg.forest_seed

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "customer_id"]).head(psi)
        t = int(pdf["tree"].iloc[0])
        xs = np.vstack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, len(cols)))
        rows = _grow(xs, seed, t, max_depth)
        out = pd.DataFrame(rows, columns=["node", "feat", "thr", "left", "right", "size"])
        out.insert(0, "tree", t)
        return out.astype({"tree": "int32", "node": "int32", "feat": "int32", "left": "int32",
                           "right": "int32", "size": "int32"})

    return cand.groupBy("tree").applyInPandas(train, NODE_SCHEMA)


def _path_lengths(xs: np.ndarray, model: dict) -> np.ndarray:
    total = np.zeros(xs.shape[0])
    for t, (feat, thr, left, right, size) in model.items():
        node = np.zeros(xs.shape[0], dtype=np.int64)
        depth = np.zeros(xs.shape[0])
        active = feat[node] >= 0
        while active.any():
            f = feat[node[active]]
            go_left = xs[active, f] < thr[node[active]]
            node[active] = np.where(go_left, left[node[active]], right[node[active]])
            depth[active] += 1
            active = feat[node] >= 0
        total += depth + c_factor(size[node])
    return total / max(len(model), 1)


def isolation_forest_scores(feat: DataFrame, cols: Sequence[str], cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """D3 + D4: customer_id, isolation_forest_score in [0, 1] (1 = most anomalous)."""
    spark = feat.sparkSession
    n = feat.count()
    nodes = fit_forest(feat, cols, cfg, n).toPandas()  # bounded: trees * (2 psi - 1) rows
    psi = min(cfg.forest_sample, max(n, 1))
    model = {}
    for t, g in nodes.groupby("tree"):
        g = g.sort_values("node")
        model[int(t)] = (g["feat"].to_numpy(), g["thr"].to_numpy(), g["left"].to_numpy(),
                         g["right"].to_numpy(), g["size"].to_numpy())
    bmodel = spark.sparkContext.broadcast(model)
    cpsi = float(c_factor(np.array([psi]))[0]) or 1.0
    ncols = list(cols)

    def score(batches):
        m = bmodel.value
        for pdf in batches:
            xs = pdf[ncols].astype("float32").astype(float).fillna(0.0).to_numpy()
            e = _path_lengths(xs, m) if len(pdf) else np.zeros(0)
            s = np.power(2.0, -e / cpsi)
            # the mean of path lengths depends on the order of its sum in the last bits only
            yield pd.DataFrame({"customer_id": pdf["customer_id"], "raw": np.round(-s, 12)})

    key_type = dict(feat.dtypes)["customer_id"]
    # persisted: the min/max normalisation and the result read it (recomputable on executor loss)
    raw = feat.select("customer_id", *ncols).mapInPandas(score, f"customer_id {key_type}, raw double").persist()
    from .scoring import minmax_invert
    return minmax_invert(raw, "raw", "isolation_forest_score").select("customer_id", "isolation_forest_score")


def forest_anomalies(scores: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """D5 on the forest: customers whose score lies in the top contamination share."""
    from .scoring import contamination_cut
    inv = scores.select("customer_id", (-F.col("isolation_forest_score")).alias("neg"))
    return contamination_cut(inv, "neg", cfg.contamination)
