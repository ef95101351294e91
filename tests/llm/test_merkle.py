import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(row):
    out = [row]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i: i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def path(built, i):
    out = []
    for level in built[:-1]:
        out.append((level[i ^ 1] if i ^ 1 < len(level) else None, i & 1))
        i //= 2
    return out


def plain(rows, tampered):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of every row, the long way."""
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([leaf(r) for r in groups[g]]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            way = path(trees[g], i) + path(top, k)
            h = leaf(tampered(r))
            for s, right in way:
                h = sha(h) if s is None else sha(s + h) if right else sha(h + s)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], "".join(s for s, _ in way if s), h, h == top[-1][0]))
    return out


def struck(r):
    odd = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
    return (*r[:3], r[3] + 1, r[4]) if odd else r


def run(spark, rows, **extra):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    df = df.withColumns({c: F.lit("clash") for c in ("tree", "pos", "size", "leaf", "own", "path", "k", "r", "_s0", "_read", "digest")})
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    m = merkle.manifest(df, FIELDS, "doc_id", "lang", {"n_chars": F.col("n_chars") + F.when(hit, 1).otherwise(0)})
    return sorted([(r.id, r.leaf, r.subroot, r.root, r.proof, r.folded_root, r.verified) for r in merkle.check(m).collect()], key=str)


def rows_of(n, lang=lambda i: "en"):
    return [(i, f"src{i % 3}", lang(i), i if i % 11 else None, f"text é {i}" if i % 13 else None) for i in range(n)]


@pytest.mark.parametrize("rows", [
    rows_of(1), rows_of(2), rows_of(3), rows_of(512), rows_of(513), rows_of(130, lambda i: [None, "", "de", "en"][i % 4] if i < 20 else "en"),
    [(None, None, None, None, None), (None, "a", None, 1, ""), (1, "", "", 0, ""), (1, "", "", 0, ""), (1, "", "", 0, "é" * 70000), (-5, "a:", "-", -1, "\n")],
    rows_of(600, lambda i: f"g{i}"),
], ids=["one", "two", "three", "page", "page+1", "groups", "odd", "many-groups"])
def test_proofs_match_the_plain_way(spark, rows):
    assert run(spark, rows) == sorted(plain(rows, struck), key=str)


def test_stored_levels_and_blocks(spark):
    """A hot group of several pages beside a small one: its last page stands above several blocks of leaves."""
    rows = rows_of(4300, lambda i: "de" if i % 22 == 3 else "en")
    assert run(spark, rows) == sorted(plain(rows, struck), key=str)


def test_three_stored_levels(spark, monkeypatch):
    """The same with small pages, so that a group needs several rounds, and more groups than a page."""
    for name, value in (("HEIGHT", 2), ("PAGE", 4), ("BLOCK_BITS", 2), ("BLOCK", 4)):
        monkeypatch.setattr(merkle, name, value)
    monkeypatch.setattr(merkle, "_CLIMB", merkle._CLIMB.replace("shiftright(c.pos, 9)", "shiftright(c.pos, 2)").replace("9 * c.k", "2 * c.k"))
    rows = rows_of(150, lambda i: "en" if i % 2 else f"g{i % 14}")
    assert run(spark, rows) == sorted(plain(rows, struck), key=str)


def test_keys_of_the_climb_stay_small(spark):
    rows = spark.range(5000).select(F.lit("").alias("tree"), F.col("id").alias("pos"), F.lit(5000).cast("long").alias("size"),
                                    F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), F.lit(1).alias("own"))
    start, nodes, _ = merkle._build(rows)
    assert nodes.groupBy("k", "tree", "idx", "block").count().where("count > 1").count() == 0
    shared = start.join(nodes.select("k", F.col("idx").alias("up_idx"), "block").distinct(), F.expr(
        "block = shiftright(idx, 9) and up_idx = shiftright(idx, cast(9 * k as int))")).groupBy("k", "up_idx", "block").count()
    assert shared.agg(F.max("count")).first()[0] <= merkle.BLOCK


def test_repeated_rows_and_empty_table(spark, none):
    same = [(7, "a", "en", 3, "abc")] * 300
    got = run(spark, same)
    assert got == sorted(plain(same, struck), key=str) and len(got) == 300
    m = merkle.manifest(none.withColumn("source", F.lit("x")).withColumn("n_chars", F.lit(1)), FIELDS, "doc_id", "lang")
    assert merkle.check(m).count() == 0 and m.root is None


def test_only_tampered_rows_fail(spark):
    from ledgerlens.llm.queries import QUERIES

    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in QUERIES["op12_merkle_manifest"](spark, "/root/testdata/sf0.001").collect():
        hit = zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and docs[r.doc_id].n_chars is not None
        assert r.verified != hit and (r.folded_root == r.root) == r.verified
