"""Distributed exact quantiles equal numpy's linear quantiles for every group size."""

import random

import numpy as np

from ledgerlens.functions.quantiles import exact_quantiles


def test_exact_quantiles_match_numpy(spark):
    rng = random.Random(1)
    rows = []
    for g, n in [("a", 1), ("b", 2), ("c", 5), ("d", 37), ("e", 1000), ("f", 20000)]:
        for _ in range(n):
            rows.append((g, float(rng.choice([rng.randint(0, 50), rng.random() * 1000, 7.0]))))
    df = spark.createDataFrame(rows, "g string, x double")
    qs = [0.0, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    # a deliberately coarse sketch: brackets must still be exact
    out = {r["g"]: [r[f"q_{i}"] for i in range(len(qs))]
           for r in exact_quantiles(df, "x", qs, by=["g"], accuracy=1000).collect()}
    for g, got in out.items():
        ref = np.quantile(np.array([x for gg, x in rows if gg == g]), qs)
        assert np.allclose(got, ref, rtol=1e-12, atol=1e-9), g
    glob = exact_quantiles(df, "x", qs, accuracy=1000).collect()[0]
    assert np.allclose([glob[f"q_{i}"] for i in range(len(qs))], np.quantile([x for _, x in rows], qs))
    assert glob["n"] == len(rows)
