import collections
"""Line, byte and word dedup against plain versions, on the corpus and on odd tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import automaton_dedup, blocks, line_dedup, suffix_dedup
from ledgerlens.llm.automaton_dedup import SuffixAutomaton


def docs_of(rows):
    """Rows that share an id are one document."""
    return sorted({(i is not None, i if i is not None else 0, t or "") for i, t in rows})


def plain_lines(rows):
    seen, gone = {}, {}
    for some, i, t in docs_of(rows):
        own = t.split("\n")
        for k in range(len(own) - 2):
            w = tuple(own[k: k + 3])
            if any(x.strip(" \r\t") for x in w) and seen.setdefault(w, (some, i, k)) != (some, i, k):
                gone.setdefault((some, i), set()).update((k, k + 1, k + 2))
    return lambda i, t: "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone.get((i is not None, i or 0), ()))


def plain_bytes(rows, width):
    seen, gone = {}, {}
    for some, i, t in docs_of(rows):
        b = t.encode()
        for k in range(len(b) - width + 1):
            if seen.setdefault(b[k: k + width], (some, i, k)) != (some, i, k):
                gone.setdefault((some, i), set()).update(range(k, k + width))
    return lambda i, t: bytes(x for k, x in enumerate((t or "").encode()) if k not in gone.get((i is not None, i or 0), ()))


def plain_words(rows, width):
    split = lambda t: [w for w in __import__("re").findall(r"[^\x20\x09-\x0d]+", t or "")]
    at, gone = {}, {}
    for some, i, t in docs_of(rows):
        own = split(t)
        for k in range(len(own) - width + 1):
            at.setdefault(tuple(own[k: k + width]), set()).add((some, i, k))
    for places in at.values():
        if len(places) > 1:
            for some, i, k in places:
                gone.setdefault((some, i), set()).update(range(k, k + width))
    return lambda i, t: " ".join(x for k, x in enumerate(split(t)) if k not in gone.get((i is not None, i or 0), ()))


def same(got, rows, want):
    assert sorted(map(repr, got)) == sorted(repr((i, want(i, t))) for i, t in rows)


def test_lines_odd(odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    out = line_dedup.dedup_lines(odd)
    same([tuple(r) for r in out.select("doc_id", "kept_text").collect()], rows, plain_lines(rows))
    assert set(odd.columns) <= set(out.columns) and line_dedup.dedup_lines(none).count() == 0
    assert out.where("doc_id = 15").first().kept_text == "a\nb\nc"


def test_lines_of_rows_that_share_an_id(spark):
    """Rows without an id, or with the same one, are documents of their own: no unique line goes, one copy stays."""
    rows = [(None, "x1\nx2\nx3\nx4"), (None, "x1\nx2\nx3\nx5"), (None, "u1\nu2\nu3\nu4"), (7, "v1\nv2\nv3\nv4"), (7, "w0\nv2\nv3\nv4"), (7, "w1\nw2\nw3\nw4"),
            (8, "z\nz\nz\nz"), (8, "z\nz\nz\nz")]
    got = collections.Counter((r.doc_id, r.kept_text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[None, "u1\nu2\nu3\nu4"] == got[7, "w1\nw2\nw3\nw4"] == 1 and got[8, "z"] == 2
    nulls = sorted(t for (i, t), n in got.items() if i is None and not t.startswith("u"))
    assert nulls in (["x1\nx2\nx3\nx4", "x5"], ["x1\nx2\nx3\nx5", "x4"])
    assert sorted(t for (i, t), n in got.items() if i == 7 and not t.startswith("w1")) in (["v1", "w0\nv2\nv3\nv4"], ["v1\nv2\nv3\nv4", "w0"])


def test_line_marks_of_many_rows_without_an_id_spread(spark):
    """A third of all rows has no id: what meets in a task by (id, text hash) stays small."""
    rows = spark.range(3000).selectExpr("case when id % 3 = 0 then null else id end as doc_id", "concat('a\nb\nc\nown ', id) as text")
    marks = line_dedup.later_windows(rows)
    assert marks.where("doc_id is null").count() > 900 and marks.groupBy("doc_id", "text_hash").count().where("count > 1").count() == 0
    kept = line_dedup.dedup_lines(rows)
    assert kept.where("n_removed = 0").count() == 1 and kept.where("kept_text like 'own %'").count() == 2999


@pytest.mark.parametrize("hot", [False, True])
def test_bytes_and_words_odd(odd, none, hot, monkeypatch):
    if hot:   # every anchor is hot: all blocks are single windows, results are the same
        monkeypatch.setattr(blocks, "HOT_SAMPLE", 1)
        monkeypatch.setattr(blocks, "HOT_LEAST", 1)
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    same([(r[0], bytes(r[1])) for r in suffix_dedup.remove_repeats(odd, width=40).select("doc_id", "kept").collect()], rows, plain_bytes(rows, 40))
    same([tuple(r) for r in automaton_dedup.remove_repeats(odd, width=12).select("doc_id", "kept_text").collect()], rows, plain_words(rows, 12))
    assert suffix_dedup.remove_repeats(none).count() == automaton_dedup.remove_repeats(none).count() == 0


def test_bytes_corpus(spark, corpus):
    want = plain_bytes(corpus, 100)
    out = suffix_dedup.op6(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in out} == {
        i: (len(t.encode()), len(t.encode()) - len(want(i, t)), hashlib.sha256(want(i, t)).hexdigest()) for i, t in corpus}


def test_maximal_repeats_hold_all_occurrences(spark):
    x, y = "abcdefghijklmnopqrstuvwxyz" * 2, "0123456789" * 5
    rows = [(1, "P" + x + "Q"), (2, "R" + x + "S"), (3, "T" + x[:45] + "U"), (4, y)]
    got = suffix_dedup.repeat_groups(spark.createDataFrame(rows, "doc_id long, text string"), width=40).collect()
    found = {(r.length, tuple(map(tuple, r.occurrences))) for r in got}
    assert any(len(o) == 3 and n >= 40 for n, o in found)       # the part that all three share
    assert all(rows[d - 1][1][s: s + n] == rows[o[0][0] - 1][1][o[0][1]: o[0][1] + n] for n, o in found for d, s in o)


def test_suffix_order_is_the_suffix_array():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 700).astype(np.uint8)
    order, levels = suffix_dedup.suffix_order(data, 1024)
    raw = data.tobytes()
    assert order.tolist() == sorted(range(700), key=lambda i: raw[i:])
    i, j = order[:-1], order[1:]
    lcp = suffix_dedup.common_prefix(i, j, levels)
    for a, b, n in zip(i.tolist(), j.tolist(), lcp.tolist()):
        k = 0
        while max(a, b) + k < 700 and raw[a + k] == raw[b + k]:
            k += 1
        assert n == k


def test_interval_tree():
    lcp = np.array([0, 3, 5, 5, 2, 0, 4])
    assert sorted(suffix_dedup.interval_tree(lcp, 2)) == [(2, 0, 4), (3, 0, 3), (4, 5, 6), (5, 1, 3)]


def test_automaton_counts_and_matches():
    rng = np.random.default_rng(2)
    seqs = [rng.integers(0, 3, rng.integers(1, 40)).tolist() for _ in range(12)]
    auto = SuffixAutomaton()
    for s in seqs:
        auto.add(s, 2)
    auto.close()
    count = lambda w: 2 * sum(s[k: k + len(w)] == w for s in seqs for k in range(len(s)))
    for s in seqs:
        for end, n, times in auto.matching(s, 4):
            assert count(s[end - n: end]) > 0 and times == count(s[end - 4: end])
        assert [e for e, _, _ in auto.matching(s, 4)] == list(range(4, len(s) + 1))


def test_windows_are_in_one_block_each():
    rng = np.random.default_rng(3)
    counts = np.array([0, 50, 3, 200, 9, 10])
    grams = rng.integers(0, 1 << 62, counts.sum()).astype(np.uint64)
    units = blocks.Units(10, 4, None)
    for hot in (None, np.sort(grams[:150])):
        row, first, size, _, _ = blocks.blocks_of(grams, counts, units, hot)
        cells = sorted((int(r), int(f) + k) for r, f, n in zip(row, first, size) for k in range(n))
        assert cells == [(r, k) for r, c in enumerate(counts) for k in range(max(0, c - 9))]
