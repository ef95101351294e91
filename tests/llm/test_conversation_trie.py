import random
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import conversation_trie as ct


def plain(convs):
    """{prefix: (smallest id, parent's, members, children, leaves, saved, ends)} of {id: [(role, text)]}, the long way."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    small = lambda ids: min((i for i in ids if i is not None), default=None)
    kids = {p: [q for q in members if q[:-1] == p and q] for p in members} if len(members) < 400 else None
    if kids is None:
        kids = {p: [] for p in members}
        for q in members:
            if q:
                kids[q[:-1]].append(q)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in kids[p]) if kids[p] else 1
        saved[p] = (len(members[p]) - 1) * (len(ct_words(p[-1][1])) if p else 0) + sum(saved[q] for q in kids[p])
    return sorted(((small(m), len(p), small(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                    tuple(sorted((c for c in m if len(convs[c]) == len(p)), key=lambda c: (c is not None, c or 0)))) for p, m in members.items()), key=str)


def ct_words(text):
    import re
    return re.findall("[^\x20\x09-\x0D]+", text)


def rows_of(out):
    ids = {}
    for r in out.ends.collect():
        ids.setdefault((r.d, r.a, r.b), []).append((r.chunk is not None, r.chunk or 0, r.conv_ids))
    whole = {k: tuple(i for _, _, part in sorted(v, key=lambda x: x[:2]) for i in part) for k, v in ids.items()}
    return sorted(((r.conv_id, r.d, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, whole.get((r.d, r.a, r.b), ())) for r in out.nodes.collect()), key=str)


def table(spark, convs):
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    return df.withColumns({c: F.lit("clash") for c in ("pos", "digest", "words", "a", "b", "d", "seq", "names", "size", "first", "j")})


def branching(n, depth, seed):
    rng = random.Random(seed)
    return {c: [("user" if i % 2 else "assistant", rng.choice(["one", "two words", "", "a\tb  c"])) for i in range(rng.randint(1, depth))] for c in range(n)}


@pytest.mark.parametrize("convs", [
    {5: [("user", "hi")]}, branching(60, 3, 1), branching(40, 9, 2),
    {c: [("user", "same")] * 5 for c in range(700)} | {1000 + c: [("user", "same")] * 3 + [("user", f"x {c}")] for c in range(50)},
    {None: [("user", "a"), ("x", "b")], 3: [("user", "a")], -7: [("user", "a"), ("x", "b")], 4: [("usera", "")], 6: [("user", "a"), ("x", "b"), ("", "")]},
], ids=["one", "shallow", "deep", "hot", "odd"])
def test_nodes_match_the_plain_way(spark, convs):
    assert rows_of(ct.prefix_trie(table(spark, convs))) == plain(convs)


def test_long_conversations_over_segments(spark):
    """Shared stretches that end before, at and after the borders of segments."""
    long = [("user", f"turn {i}") for i in range(300)]
    convs = {c: long[:n] + [("user", f"own {c}")] * (c % 2) for c, n in enumerate((63, 64, 65, 127, 128, 129, 200, 256, 257, 300, 300))}
    assert rows_of(ct.prefix_trie(table(spark, convs))) == plain(convs)


def test_nulls_repeats_and_order(spark):
    df = spark.createDataFrame([(1, None, None, None), (1, 2, "user", "b"), (1, 1, "user", None), (2, 0, "", ""), (2, 1, "user", ""), (2, 2, "user", "b"),
                                (3, 0, "u", "x"), (3, 0, "u", "x")], "conv_id long, turn long, role string, text string")
    convs = {1: [("", ""), ("user", ""), ("user", "b")], 2: [("", ""), ("user", ""), ("user", "b")], 3: [("u", "x"), ("u", "x")]}
    assert rows_of(ct.prefix_trie(df)) == plain(convs)
    empty = ct.prefix_trie(df.where("false"))
    assert empty.nodes.count() == 0 and empty.ends.count() == 0


def test_rebuilt_conversations(spark):
    own = branching(70, 6, 3)
    del own[20]
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    assert any(not t for t in convs.values())
    assert rows_of(ct.trie(*ct.rebuilt(ct.turn_digests(table(spark, own))))) == plain(convs)


def test_hot_parents_are_few(spark):
    convs = {c: [("user", "first"), ("user", f"{c}")] for c in range(3000)}
    got = rows_of(ct.prefix_trie(table(spark, convs)))
    assert got == plain(convs)
