"""N-gram join, fingerprints, decontamination against plain versions."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, fingerprints, ngram_join


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[k: k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_components(rows):
    order = lambda i: (i is not None, i or 0)
    sets = {}
    for i, t in rows:
        sets.setdefault(order(i), []).append(shingles(t))
    nodes = [(i, s) for i, own in sets.items() for s in own]
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(nodes):
        for j, z in nodes[:a]:
            if s and z and 100 * len(s & z) >= 80 * len(s | z):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in sets}


def test_components_odd(odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect() if r[0] is not None or r[1]]
    want = plain_components(rows)
    out = ngram_join.similar_components(odd.where("doc_id is not null or text is not null")).collect()
    back = lambda k: k[1] if k[0] else None
    assert sorted(map(repr, ((r[0], r[1], r[2]) for r in out))) == sorted(
        repr((i, len(shingles(t)), back(want[(i is not None, i or 0)]))) for i, t in rows)
    assert ngram_join.similar_components(none).count() == 0


def shared_id_rows():
    """Many texts with a null id and many with one shared id, each with a near copy that has an id of its own."""
    import random

    rng = random.Random(11)
    rows = [(None, None), (None, ""), (7, None)]
    for k in range(24):
        own = [f"w{k}x{rng.randrange(10 ** 6)}" for _ in range(70)]
        near = own[:30] + ["changed"] + own[31:]
        rows += [(None if k % 2 else 7, " ".join(own)), (100 + k, " ".join(near))]
    return rows + [(None, rows[5][1]), rows[4]]


def row_components(rows):
    """Every row is a node: (id, text) -> smallest id of its component, and the component's rows."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    return root


def test_rows_that_share_an_id(spark):
    rows = shared_id_rows()
    root = row_components(rows)
    low = lambda r: min((rows[k][0] for k in range(len(rows)) if root[k] == r), key=lambda i: (i is not None, i or 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(repr((r[0], r[1], r[2])) for r in ngram_join.similar_components(docs).collect())
    assert got == sorted(repr((i, len(shingles(t)), low(root[k]))) for k, (i, t) in enumerate(rows))


def test_components_odd_with_the_null_row(odd):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    want = plain_components(rows)
    back = lambda k: k[1] if k[0] else None
    assert sorted(repr(tuple(r)) for r in ngram_join.similar_components(odd).collect()) == sorted(
        repr((i, len(shingles(t)), back(want[(i is not None, i or 0)]))) for i, t in rows)


def test_components_corpus(spark, corpus):
    want = plain_components(corpus)
    out = ngram_join.op5(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == {i: (len(shingles(t)), want[(True, i)][1]) for i, t in corpus}


def test_chains_and_thresholds(spark):
    """A chain of sets that link pairwise at the threshold exactly, and one just below it."""
    word = lambda k: f"w{k}"
    text = lambda a, b: " ".join(word(k) for k in range(a, b))
    rows = [(k, text(5 * k, 5 * k + 49)) for k in range(40)]      # 45 shingles each, 40 shared: exactly 80 %
    rows += [(100, text(1000, 1049)), (101, text(1006, 1055))]    # 39 of 51
    out = {r[0]: r[2] for r in ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[k] == 0 for k in range(40)) and out[100] == 100 and out[101] == 101


def test_prefix_tree_finds_all_links():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    members = []
    for k in range(200):
        keep = base[rng.random(len(base)) < rng.uniform(0.7, 1)]
        members.append((k, np.unique(np.r_[keep, rng.integers(0, 1 << 63, rng.integers(0, 90)).astype(np.uint64)])))
    want = [k for k, m in members if 100 * len(np.intersect1d(m, base)) >= 80 * len(np.union1d(m, base))]
    assert sorted(ngram_join.linked(base, ngram_join.in_tree_order(dict(members)))) == want and 20 < len(want) < 180


def crowd_rows(n, seed=3):
    """Copies of one text with one to six words changed: all sign shingles of it, few link with each other."""
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(n):
        own = list(base)
        for at in rng.choice(len(base), 1 if k % 40 == 0 else int(rng.integers(4, 7)), replace=False):
            own[at] = f"x{k}y{at}"
        rows.append((k, " ".join(own)))
    return rows + [(1000 + k, " ".join([*rows[k][1].split()[:-1], "end"])) for k in range(5, 25)]


@pytest.mark.parametrize("crowd, block", [(64, 512), (8, 16)])
def test_crowds_of_unlinked_near_copies(spark, monkeypatch, crowd, block):
    """op5, pipeline: classes that sign one shingle are not listed as pairs by the square of their number, and no link is lost."""
    monkeypatch.setattr(ngram_join, "CROWD", crowd, raising=False)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows, tried = crowd_rows(160), []
    verify = ngram_join.verify_links
    monkeypatch.setattr(ngram_join, "verify_links", lambda pairs, *a, **k: tried.append(pairs.count()) or verify(pairs, *a, **k))
    want = plain_components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r[0]: r[2] for r in ngram_join.similar_components(docs).collect()} == {i: want[(True, i)][1] for i, _ in rows}
    assert len(set(want.values())) > 100 and tried[-1] <= len(rows)


def rows_made(plan, node):
    """Rows that the nodes of this kind made when the plan ran."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return rows_made(plan.executedPlan(), node)
    if kind.endswith("QueryStageExec"):
        return rows_made(plan.plan(), node)
    own = plan.metrics().apply("pythonNumRowsReceived").value() if node in kind else 0
    return own + sum(rows_made(plan.children().apply(k), node) for k in range(plan.children().size()))


def test_pairs_listed_under_one_shingle(spark):
    """op5, pipeline: what a shingle's group lists is bounded per record; larger groups list what sketches can't tell apart."""
    n, size = 300, 100
    rng = np.random.default_rng(8)
    sets = [(k, rng.integers(1, 1 << 62, size).astype(np.uint64)) for k in range(n)]
    sets[7] = (7, np.r_[sets[6][1][:95], sets[7][1][95:]])
    rows = spark.createDataFrame([(1, k, size, 0, k, 1, n) for k, _ in sets] + [(2, k, size, 0, k, 1, 3) for k in range(3)],
                                 "key long, cls long, size int, pos int, component long, members long, crowd long")
    few = ngram_join.residual_pairs(rows)
    few.collect()
    assert 0 < rows_made(few._jdf.queryExecution().executedPlan(), "FlatMapGroupsInArrow") < 10
    bits = ngram_join.parities(np.concatenate([x for _, x in sets]), np.arange(n + 1) * size)
    sketch = spark.createDataFrame([(k, bytearray(bits[k].tobytes())) for k in range(n)], "cls long, sketch binary")
    assert sorted((r.a, r.b) for r in few.collect()) == [(0, 1), (0, 2), (1, 2)]
    assert [tuple(r) for r in ngram_join.crowd_pairs(ngram_join.crowded(rows), sketch).collect()] == [(6, 7)]


def test_sketches_lose_no_link():
    rng = np.random.default_rng(9)
    for size in (1, 4, 5, 30, 300, 3000):
        base = rng.integers(1, 1 << 62, size).astype(np.uint64)
        for drop in {0, size // 10, size // 9, size // 5}:
            other = np.r_[base[drop:], rng.integers(1, 1 << 62, drop // 2).astype(np.uint64)]
            x, y = ngram_join.parities(np.r_[base, other], np.array([0, size, size + len(other)])).view(np.uint64)
            if 100 * (size - drop) >= 80 * (size + drop // 2):
                assert ngram_join.may_be_near(x[None], y[None], size, len(other)).all()


def plain_likeness(a, b):
    x, y = set((a or "").split("\n")), set((b or "").split("\n"))
    return len(x & y) / len(x | y)


def check_fingerprints(docs, rows):
    rows = sorted(((i is not None, i or 0, t or "") for i, t in rows))
    out = fingerprints.compare_versions(docs).collect()
    got = sorted(((r[0] is not None, r[0] or 0, r.text, r.edited, r.next_text, round(r.near_edited, 12), round(r.near_next, 12)) for r in out))
    want = []
    for k, (some, i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][2]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        want.append((some, i, t, edited, nxt, round(plain_likeness(t, edited), 12), round(plain_likeness(t, nxt), 12)))
    assert got == sorted(want)
    prints = {}
    for r in out:
        assert prints.setdefault(r.text, r.fingerprint) == r.fingerprint
        assert prints.setdefault(r.edited, r.edited_fingerprint) == r.edited_fingerprint


def test_fingerprints_odd(spark, odd, none):
    check_fingerprints(odd, [tuple(r) for r in odd.select("doc_id", "text").collect()])
    assert fingerprints.compare_versions(none).count() == 0
    check_fingerprints(spark.createDataFrame([(5, "a\nb")], "doc_id long, text string"), [(5, "a\nb")])


def test_larger_sketches_are_needed_and_right(spark):
    rows = [(k, "\n".join(f"line {k} {j}" for j in range(900 if k % 2 else 60))) for k in range(8)]
    check_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_fingerprint_plan_runs_no_python(spark):
    plan = fingerprints.op4(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_items_in_documents(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    texts = dict(rows)
    cut = texts[16].split()
    items = [(1, " ".join(cut[100:130]).upper()), (2, texts[1]), (3, ""), (4, None), (5, "one two"), (6, " ".join(cut[10:18] + ["zz"] + cut[2000:2040])),
             (2, texts[1]), (7, "\n".join(cut[3000:3500])), (None, "ab " * 9)]
    want = sorted(repr((i, j, len(shingles(t) & shingles(x)), len(shingles(x)))) for i, t in rows for j, x in set(items)
                  if shingles(x) and 100 * len(shingles(t) & shingles(x)) >= 80 * len(shingles(x)))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_items(odd, table).collect()
    assert sorted(repr(tuple(r)) for r in got) == want
    clean = decontaminate.decontaminate(odd, table)
    hit = {r[0] for r in got}
    assert clean.columns == odd.columns and sorted(map(repr, (r[0] for r in clean.select("doc_id").collect()))) == sorted(
        repr(i) for i, t in rows if not any(100 * len(shingles(t) & shingles(x)) >= 80 * len(shingles(x)) for _, x in items if shingles(x)))
    assert hit and decontaminate.find_items(none, table).count() == 0
    assert decontaminate.find_items(odd, none.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert decontaminate.decontaminate(none, table).count() == 0


def test_item_blocks_give_the_same(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    whole = sorted(map(tuple, decontaminate.op10(spark, sf).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 2500)
    assert sorted(map(tuple, decontaminate.op10(spark, sf).collect())) == whole and whole


@pytest.mark.parametrize("fragments", [1, 2, 5])
def test_scattered_items_are_found(fragments):
    rng = np.random.default_rng(fragments)
    items = [" ".join(f"i{k}x{j}" for j in range(12 + k % 50)) for k in range(300)]
    index = decontaminate.ItemIndex(list(range(300)), items)
    import pyarrow as pa
    from ledgerlens.llm.textops import text_slices

    docs = []
    for item in items:
        w = item.split()
        noise = lambda: [f"n{x}" for x in rng.integers(0, 1 << 40, rng.integers(20, 800))]
        if fragments == 1 or len(w) < 40:
            out = noise() + w + noise()
        else:
            out = noise()
            for part in np.array_split(np.array(w, object), min(2, fragments)):
                out += list(part) + noise()
        docs.append(" ".join(out))
    for i, _, data, offs in text_slices(pa.array(docs)):
        for r, item, _ in index.contained(data, offs, 80):
            docs[i + r] = None if item == i + r else docs[i + r]
    missed = [k for k, d in enumerate(docs) if d is not None and len(shingles(items[k]) & shingles(d)) >= 0.8 * len(shingles(items[k]))]
    assert not missed
