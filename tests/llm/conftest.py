import os
import random

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def workers_find_the_package(spark):
    spark.sparkContext.environment["PYTHONPATH"] = ROOT


@pytest.fixture(scope="session")
def corpus(spark):
    """All documents of the smallest scale, as (doc_id, text) pairs by id."""
    return sorted((r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())


CLASHES = ["line", "lines", "h1", "w", "bucket", "records", "kind", "key", "cls", "size", "pos", "runs", "open", "anchor", "unit", "edges",
           "row", "pieces", "_runs", "_text", "_key", "_ll_id", "kept", "kept_text", "n_removed", "spans", "word", "item_id", "wraps", "guest", "score"]


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows():
    """Nulls, empty and long texts, ties, copies, near copies, repeated rows, negative and null ids."""
    rng = random.Random(7)
    base, other, shared = sentence(rng, 90), sentence(rng, 70), "\n".join(sentence(rng, 12) for _ in range(5))
    near = base.split()
    near[4] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "One TWO"),
            (9, other + "\n" + shared), (10, shared + "\n" + other), (11, shared), (11, shared), (-3, "x" * 150 + "é" * 200 + "\U0001F600" * 40),
            (12, "ab " * 400), (13, "\n" * 9), (14, "\u2581 tab\tx  y"), (15, "a\nb\nc\na\nb\nc\na\nb\nc"), (16, sentence(rng, 4000) + " " + base),
            (17, "mail a.b@c.de, +1 (555) 555-1234 at 10.0.0.1; token = \"abc1234567\" https://x.yz/q."), (None, base), (None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with further columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
