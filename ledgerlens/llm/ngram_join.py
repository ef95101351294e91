"""N-gram Jaccard self-join over prefix trees: documents that share at least 80 % of their 5-word shingles.

A document's set holds its distinct five-word shingles (words lower-cased A-Z; fewer words: the whole sequence as
one shingle; none: empty). Documents with equal sets form a *class* and are handled once. Two classes link when
``100 * |A and B| >= threshold * |A or B|``; links chain into components.

1. ``common_shingles`` counts shingles over all documents; the commonest move to the end of one global order, the
   rest are ordered by hash. Any order gives the same links, this one keeps groups small.
2. ``signatures`` emits the first ``n - ceil(0.8 n) + 1`` shingles of each class in that order: linked classes share
   at least one of them, and their first common one lies in both prefixes. Records are packed per bucket.
3. Classes that meet in a shingle are candidates if sizes, remaining lengths and the number of shared signed
   shingles allow it. First every class is tried against one pivot per shingle and size band (linear in the group,
   never all its pairs), and what one tree of candidates holds is connected there; then classes that still lie
   outside a large component meet it as a whole, tree by tree, and only classes of small components meet as pairs.
   A pair is listed only under a shingle that can be its first common one, and by groups of bounded size; larger
   groups are cut into blocks that meet in tasks of their own, which compare parity sketches and list near pairs only.
4. ``verify_links`` stores a pivot's candidates as globally ordered sequences in a prefix tree and walks it once:
   the overlap along a shared path is counted once for all sequences below it, and a subtree ends as soon as
   overlap plus remaining length can't reach what the sizes require.

Classes are keyed by a 64-bit set hash and shingles by 63 bits (about 3 false merges expected in 10**10 sets).

Defined cases: null text is an empty set, linked with nothing; ties in sizes or shingles go by hash; repeated
rows give repeated result rows; rows that share an id (or have none) with different texts are documents of their
own; a null doc_id stays null and counts as the smallest id; an empty table gives an empty result; further columns
are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.sparkops import components, partitions, settle, thinned
from ledgerlens.llm.textops import U, mix, sets_by_row, shingles, text_slices, word_hashes, words

SHINGLE, THRESHOLD = 5, 80
#: the commonest shingles that go last in the order (order only, never results)
COMMON = 1 << 16
#: tokens counted together, and signature records packed together, in a map task
COUNT_TOKENS, FLUSH_RECORDS = 1 << 22, 1 << 20
#: candidates of one pivot that one prefix tree holds; more go to further trees
TREE = 128
#: classes from which on a component meets others as a whole, tree by tree, and classes that meet one tree at once
LARGE, BLOCK = 16, 512
#: classes of small components under one shingle that list their pairs; places of a set's parity sketch, and of the
#: finer one that pairs must pass before whole sets are sent to them
CROWD, SKETCH, FINE = 16, 1024, 8192
RECORD = np.dtype([("key", "<u8"), ("cls", "<i8"), ("size", "<i4"), ("pos", "<i4")])
DOC = np.dtype([("doc", "<i8"), ("cls", "<i8"), ("size", "<i8"), ("sketch", f"V{SKETCH // 8}")])
NULL_ID = -(1 << 63)


def needed(a, b, threshold: int = THRESHOLD):
    """Least overlap of two linked sets of sizes a and b."""
    return -((-threshold * (a + b)) // (100 + threshold))


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, row = words(data, offs)
    tok, at = shingles(word_hashes(data, starts, ends, lower=True), row, SHINGLE)
    return tok >> U(1), at


class Order:
    """The global shingle order: keys of common shingles are above 2**63, rarer of them first."""

    def __init__(self, common: list[int]):
        tok = np.array(common, np.uint64)   # commonest first
        rank = np.arange(len(tok), dtype=U)[::-1]
        o = np.argsort(tok)
        self.tok, self.rank = tok[o], rank[o]

    def keys(self, tok: np.ndarray) -> np.ndarray:
        if not len(self.tok) or not len(tok):
            return tok
        i = np.minimum(np.searchsorted(self.tok, tok), len(self.tok) - 1)
        return np.where(self.tok[i] == tok, U(1 << 63) | self.rank[i], tok)

    def sets(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys ascending within each row, where rows begin, set sizes, set hashes."""
        tok, row = _tokens(data, offs)
        key, row = sets_by_row(self.keys(tok), row)
        at = np.searchsorted(row, np.arange(len(offs)))
        size = np.diff(at)
        total = np.r_[U(0), np.cumsum(mix(key ^ U(0x5851F42D4C957F2D)))]
        return key, at, size, mix((total[at[1:]] - total[at[:-1]]) + size.astype(U)).view(np.int64)


def common_shingles(docs: DataFrame) -> list[int]:
    """The commonest shingles of all documents, commonest first, at most ``COMMON``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            tok, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(tok[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["token", "n"])

        for b in batches:
            for _, _, data, offs in text_slices(b.column(0)):
                held.append(_tokens(data, offs)[0])
                if sum(map(len, held)) >= COUNT_TOKENS:
                    yield flush()
        if held:
            yield flush()

    often = (docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
             .where("n > 3").orderBy(F.desc("n"), "token").limit(COMMON))
    return [r[0] for r in often.select("token").collect()]


def parities(key: np.ndarray, at: np.ndarray, places: int = SKETCH) -> np.ndarray:
    """The packed sketch of each set (its keys from ``at`` on): whether an odd number of them falls on each of ``places``."""
    place = (mix(key ^ U(0x2545F4914F6CDD1D)) % U(places)).astype(np.int64)
    out = np.zeros((len(at) - 1, places // 8), np.uint8)
    for i in range(0, len(out), 512):
        j = min(i + 512, len(out))
        row = np.repeat(np.arange(j - i), np.diff(at[i: j + 1]))
        odd = np.bincount(row * places + place[at[i]: at[j]], minlength=(j - i) * places) & 1
        out[i:j] = np.packbits(odd.astype(np.uint8)).reshape(j - i, -1)
    return out


def signatures(docs: DataFrame, order, buckets: int, threshold: int = THRESHOLD) -> DataFrame:
    """(bucket, records, docs): packed prefix records per bucket of shingles; ``docs`` has each document's class and sketch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        members: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rec = np.concatenate(held)
            bucket = (mix(rec["key"]) % U(buckets)).astype(np.int32)
            o = np.lexsort((rec["cls"], rec["key"], bucket))
            rec, bucket = rec[o], bucket[o]
            new = np.r_[True, (rec["key"][1:] != rec["key"][:-1]) | (rec["cls"][1:] != rec["cls"][:-1])][: len(rec)]
            rec, bucket = rec[new], bucket[new]
            edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])[: len(rec)]
            packed = [rec[a:b].tobytes() for a, b in zip(edge, np.r_[edge[1:], len(rec)])]
            ids = bucket[edge].tolist()
            own = np.concatenate(members)
            held.clear()
            members.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array([*ids, int(own["doc"][0] % buckets) if len(own) else 0], pa.int32()),
                 pa.array([*packed, None], pa.binary()), pa.array([None] * len(ids) + [own.tobytes()], pa.binary())], names=["bucket", "records", "docs"])

        for b in batches:
            ids = b.column(0).to_numpy()
            for i, j, data, offs in text_slices(b.column(1)):
                key, at, size, cls = order.value.sets(data, offs)
                own = np.empty(j - i, DOC)
                own["doc"], own["cls"], own["size"], own["sketch"] = ids[i:j], cls, size, parities(key, at).view(DOC["sketch"])[:, 0]
                members.append(own)
                first = np.flatnonzero(size > 0)
                _, once = np.unique(cls[first], return_index=True)   # copies in the slice sign once
                first = np.sort(first[once])
                take = prefix(size[first], threshold)
                row = np.repeat(first, take)
                pos = np.arange(int(take.sum())) - np.repeat(np.cumsum(take) - take, take)
                rec = np.empty(len(row), RECORD)
                rec["key"], rec["cls"], rec["size"], rec["pos"] = key[at[row] + pos], cls[row], size[row], pos
                held.append(rec)
                if sum(map(len, held)) >= FLUSH_RECORDS:
                    yield from flush()
        if held:
            yield from flush()

    return docs.mapInArrow(scan, "bucket int, records binary, docs binary")


def prefix(size, threshold: int = THRESHOLD):
    """How many shingles of a set are signed."""
    return size - (threshold * size + 99) // 100 + 1


def _may_link(size_a, pos_a, size_b, pos_b, threshold: int):
    """Could two sets link whose first common shingle is at these positions?"""
    return np.minimum(size_a - pos_a, size_b - pos_b) >= needed(size_a, size_b, threshold)


def _shared(pairs: DataFrame, threshold: int) -> DataFrame:
    """(a, b, n, least): signed shingles that two classes share, and how many of them a link takes at least.

    Every common shingle up to the lower of the two last signed ones is signed in both sets; at most the unsigned
    rest of one set can be common beyond it.
    """
    size = lambda c: F.min(f"size_{c}").cast("long")
    total = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), size("a").alias("size_a"), size("b").alias("size_b"))
    rest = lambda c: F.floor((threshold * F.col(f"size_{c}") + 99) / 100) - 1
    need = F.ceil(threshold * (F.col("size_a") + F.col("size_b")) / (100 + threshold))
    return total.select("a", "b", "n", F.greatest(F.lit(1), need - F.greatest(rest("a"), rest("b"))).alias("least"))


def star_pairs(pairs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): for each class b the pivot a that it shares most signed shingles with, if that may be a near copy."""
    best = _shared(pairs, threshold).where("2 * n >= least").groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("low"), "a")).alias("x"))
    return best.select(F.col("x.a").alias("a"), "b")


def _distinct_pairs(a, b, size_a, size_b) -> dict[str, np.ndarray]:
    """Columns (a, b, n, size_a, size_b): each pair once, with the number of shingles it was found under."""
    o = np.lexsort((b, a))
    a, b, size_a, size_b = a[o], b[o], size_a[o], size_b[o]
    at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
    n = np.diff(np.r_[at, len(a)])
    return {"a": a[at], "b": b[at], "n": n.astype(np.int32), "size_a": size_a[at].astype(np.int32), "size_b": size_b[at].astype(np.int32)}


_PAIRS = "a long, b long, n int, size_a int, size_b int"


def meet(packed: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(kind, a, b, n, size_a, size_b, sketch): document a of class b (0; size_a its size), candidate of pivot a (1),
    class b under the shared shingle a (2; size_b its size, n the position)."""

    def group(key, table):
        rec = [np.frombuffer(x, RECORD) for x in table.column("records").to_pylist() if x]
        docs = [np.frombuffer(x, DOC) for x in table.column("docs").to_pylist() if x]
        docs = np.concatenate(docs) if docs else np.zeros(0, DOC)
        rec = np.concatenate(rec) if rec else np.zeros(0, RECORD)
        rec = rec[np.lexsort((rec["cls"], rec["size"], rec["key"]))]
        if len(rec):
            rec = rec[np.r_[True, (rec["key"][1:] != rec["key"][:-1]) | (rec["cls"][1:] != rec["cls"][:-1])]]
            edge = np.r_[np.flatnonzero(np.r_[True, rec["key"][1:] != rec["key"][:-1]]), len(rec)]
            rec = rec[np.repeat(np.diff(edge) > 1, np.diff(edge))]
        # a pivot per shingle and size band: the smallest class
        band = np.floor(np.log(np.maximum(rec["size"], 1)) / np.log(100 / threshold)).astype(np.int64)
        edge = np.flatnonzero(np.r_[True, (rec["key"][1:] != rec["key"][:-1]) | (band[1:] != band[:-1])])[: len(rec)]
        star = _distinct_pairs(*(np.zeros(0, np.int64),) * 4)
        if len(rec):
            lengths = np.diff(np.r_[edge, len(rec)])
            low = np.repeat(np.minimum.reduceat(rec["cls"], edge), lengths)
            pivot = rec[np.repeat(np.flatnonzero(rec["cls"] == low), lengths)]   # a class is once in a group
            far = rec["cls"] != low
            rec_, pivot = rec[far], pivot[far]
            star = _distinct_pairs(pivot["cls"], rec_["cls"], pivot["size"], rec_["size"])
        n, k, m = len(docs), len(star["a"]), len(rec)
        zero = lambda x: np.zeros(x, np.int32)
        return pa.table({
            "kind": np.repeat(np.array([0, 1, 2], np.int8), [n, k, m]), "a": np.r_[docs["doc"], star["a"], rec["key"].view(np.int64)],
            "b": np.r_[docs["cls"], star["b"], rec["cls"]], "n": np.r_[zero(n), star["n"], rec["pos"]],
            "size_a": np.r_[docs["size"].astype(np.int32), star["size_a"], zero(m)], "size_b": np.r_[zero(n), star["size_b"], rec["size"]],
            "sketch": pa.array([x.tobytes() for x in docs["sketch"]] + [None] * (k + m), pa.binary())})

    return packed.groupBy("bucket").applyInArrow(group, f"kind tinyint, {_PAIRS}, sketch binary")


def in_tree_order(members: dict[int, np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """Classes and their ordered sets as a prefix tree lists them."""
    return sorted(members.items(), key=lambda m: m[1].astype(">u8").tobytes())


def linked(pivot: np.ndarray, members: list[tuple[int, np.ndarray]], threshold: int = THRESHOLD) -> list[int]:
    """Classes among ``members`` (in tree order) whose sets link with the ordered set ``pivot``: one walk over the tree.

    The tree is kept as the sequences in order with their common prefixes; ``seen[d]`` is the overlap along the
    current path down to depth d, so a shared path is counted once.
    """
    out = []
    path, seen, depth = np.zeros(0, U), np.zeros(1, np.int64), 0
    for cls, own in members:
        if 100 * min(len(own), len(pivot)) < threshold * max(len(own), len(pivot)):
            continue
        n = min(depth, len(own))
        differ = np.flatnonzero(path[:n] != own[:n])
        shared = int(differ[0]) if len(differ) else n
        need = needed(len(own), len(pivot), threshold)
        grown, at, got = [seen[: shared + 1]], shared, int(seen[shared])
        step = 64
        alive = got + len(own) - at >= need
        while alive and at < len(own):
            part = own[at: at + step]
            i = np.searchsorted(pivot, part)
            hit = pivot[np.minimum(i, len(pivot) - 1)] == part
            grown.append(got + np.cumsum(hit))
            at += len(part)
            got = int(grown[-1][-1])
            step *= 2
            left = len(pivot) - int(np.searchsorted(pivot, part[-1], "right"))
            alive = got + min(len(own) - at, left) >= need   # remaining-length bound
        path, seen, depth = own, np.concatenate(grown), at
        if at == len(own) and got >= need:
            out.append(cls)
    return out


def local_links(sets: dict[int, np.ndarray], threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Edges that connect what is linked among the sets of one tree: each class walks those it isn't connected to."""
    root = {c: c for c in sets}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges, tree, first = [], in_tree_order(sets), min(sets, default=0)
    for own in sorted(sets):
        home = find(own)
        if own != first and home == find(first):
            continue
        for other in linked(sets[own], [m for m in tree if find(m[0]) != home], threshold):
            if find(other) != find(own):
                root[find(other)] = find(own)
                edges.append((own, other))
    return edges


def with_class(rows: DataFrame, order) -> DataFrame:
    """``rows`` (with a column text) and each row's own class hash ``cls``."""
    at = rows.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in text_slices(b.column(at)):
                _, _, _, cls = order.value.sets(data, offs)
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cls)], names=[*part.schema.names, "cls"])

    return rows.mapInArrow(scan, T.StructType([*rows.schema.fields, T.StructField("cls", T.LongType())]))


def class_sets(docs: DataFrame, classes: DataFrame, order) -> DataFrame:
    """(cls, keys): the ordered set (packed 64-bit keys) of each class; ``classes`` has cls and a doc_id of it.

    A row counts by its own class hash, as rows of other classes may share its id; one row a class is read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in text_slices(b.column(1)):
                key, at, _, _ = order.value.sets(data, offs)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([key[at[k]: at[k + 1]].tobytes() for k in range(j - i)], pa.binary())], names=["cls", "keys"])

    own = thinned(with_class(thinned(docs, classes), order), classes, "cls")
    one = own.dropDuplicates(["doc_id", "cls"]).join(classes, ["doc_id", "cls"])
    return one.select("cls", "text").mapInArrow(scan, "cls long, keys binary")


def sets_of(wanted: DataFrame, docs: DataFrame, members: DataFrame, order) -> DataFrame:
    """``class_sets`` of every class in the arrays ``c``."""
    active = wanted.select(F.explode("c").alias("cls")).distinct()
    return class_sets(docs, settle(members.groupBy("cls").agg(F.min("doc_id").alias("doc_id")).join(active, "cls").select("doc_id", "cls")), order)


def _unpack(table: pa.Table) -> dict[int, np.ndarray]:
    return dict(zip(table.column("cls").to_pylist(), (np.frombuffer(x, U) for x in table.column("keys").to_pylist())))


def _edges(edges: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in edges], pa.int64()), "b": pa.array([x for _, x in edges], pa.int64())})


def verify_links(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD, local: bool = False) -> DataFrame:
    """The pairs (a, b) of classes that link, by prefix trees of each a's candidates b.

    ``local``: edges between any classes of a tree that connect all that is linked in it.
    """
    load = pairs.groupBy("a").agg(F.ceil(F.count("*") / TREE).alias("trees"))
    cut = pairs.join(load, "a").withColumn("tree", F.pmod(F.xxhash64("b"), F.col("trees")))
    each = (cut.join(sets, cut["b"] == sets["cls"]).select("a", "tree", "cls", "keys")
            .unionByName(load.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("trees") - 1)).alias("tree"))
                         .join(sets, F.col("a") == sets["cls"]).select("a", "tree", "cls", "keys")))

    def walk(key, table):
        a, own = key[0].as_py(), _unpack(table)
        return _edges(local_links(own, threshold) if local else [(a, b) for b in linked(own.pop(a), in_tree_order(own), threshold)])

    return each.groupBy("a", "tree").applyInArrow(walk, "a long, b long")


def labelled(shared: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, cls, size, pos, component, members, crowd): classes under the shingles that several components share;
    ``members`` is the number of classes in the component, ``crowd`` that of small components under the shingle."""
    sizes = comp.groupBy("component").agg(F.count("*").alias("members"))
    own = comp.join(sizes, "component").select(F.col("node").alias("cls"), "component", "members")
    rows = shared.join(own, "cls", "left").withColumns({"component": F.coalesce("component", "cls"), "members": F.coalesce("members", F.lit(1))})
    mixed = rows.groupBy("key").agg((F.min("component") != F.max("component")).alias("mixed"),
                                    F.count_if(F.col("members") < LARGE).alias("crowd")).where("mixed").select("key", "crowd")
    return rows.join(mixed, "key").select("key", "cls", "size", "pos", "component", "members", "crowd")


def block_pairs(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """(component, tree, part, cls, member): each class that shares a shingle with a large component meets all of its
    classes, tree by tree; one row per class and tree instead of one per pair."""
    large = rows.where(F.col("members") >= LARGE)
    there = large.select("key", F.col("component").alias("large"), "members").distinct()
    near = (rows.select("key", "cls", "component").join(there, "key").where("component <> large")
            .select(F.col("large").alias("component"), "cls", "members").distinct())
    trees = F.ceil(F.col("members") / TREE)
    parts = near.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    ours = (comp.select("component", F.col("node").alias("cls")).join(near.select("component", "members").distinct(), "component").join(parts, "component")
            .select("component", F.pmod(F.xxhash64("cls"), trees).alias("tree"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
                    "cls", F.lit(True).alias("member")))
    theirs = near.join(parts, "component").select(
        "component", F.explode(F.sequence(F.lit(0).cast("long"), trees - 1)).alias("tree"), F.pmod(F.xxhash64(F.lit("part"), "cls"), F.col("parts")).alias("part"),
        "cls", F.lit(False).alias("member"))
    return ours.unionByName(theirs)


def block_links(blocks: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): one link of each class to the block's component, where there is any."""

    def walk(key, table):
        member = np.array(table.column("member").to_pylist(), bool)
        own = _unpack(table.filter(pa.array(member)).select(["cls", "keys"]))
        tree = in_tree_order(own)
        edges = []
        for cls, keys in _unpack(table.filter(pa.array(~member)).select(["cls", "keys"])).items():
            edges += [(cls, b) for b in linked(keys, tree, threshold)[:1]]
        return _edges(edges)

    return (blocks.join(sets, "cls").select("component", "tree", "part", "cls", "member", "keys")
            .groupBy("component", "tree", "part").applyInArrow(walk, "a long, b long"))


def residual_pairs(rows: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b, size_a, size_b): pairs of classes of different, small components under shingles that up to ``CROWD`` of
    them share, where the shingle may be the first common one of a link: half a ``CROWD`` of them a record at most."""
    buckets = 8 * partitions(rows.sparkSession)

    def group(key, table):
        col = {c: table.column(c).to_numpy() for c in ("key", "cls", "size", "pos", "component")}
        o = np.lexsort((col["cls"], col["size"], col["key"]))
        col = {c: v[o] for c, v in col.items()}
        edge = np.flatnonzero(np.r_[True, col["key"][1:] != col["key"][:-1]])
        end = np.repeat(np.r_[edge[1:], len(o)], np.diff(np.r_[edge, len(o)]))
        # each record meets the later ones of its group whose size still allows a link, one distance at a time
        found, at, gap = [np.zeros((0, 2), np.int64)], np.arange(len(o)), 1
        while len(at):
            at = at[at + gap < end[at]]
            at = at[threshold * col["size"][at + gap] <= 100 * col["size"][at]]
            x, y = at, at + gap
            keep = (col["component"][x] != col["component"][y]) & _may_link(col["size"][x], col["pos"][x], col["size"][y], col["pos"][y], threshold)
            x, y = x[keep], y[keep]
            swap = col["cls"][x] > col["cls"][y]
            found.append(np.stack([np.where(swap, y, x), np.where(swap, x, y)], 1))
            gap += 1
        x, y = np.concatenate(found).T
        out = _distinct_pairs(col["cls"][x], col["cls"][y], col["size"][x], col["size"][y])
        return pa.table({c: out[c] for c in ("a", "b", "size_a", "size_b")})

    met = rows.where((F.col("members") < LARGE) & F.col("crowd").between(2, CROWD)).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return met.groupBy("bucket").applyInArrow(group, "a long, b long, size_a int, size_b int").distinct()


def crowded(rows: DataFrame) -> DataFrame:
    """The rows of small components under shingles that more than ``CROWD`` of their classes share."""
    return rows.where((F.col("members") < LARGE) & (F.col("crowd") > CROWD))


def fine_sketches(sets: DataFrame) -> DataFrame:
    """(cls, size, sketch): the size and the finer sketch of each set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, BLOCK):
                b = whole.slice(k, BLOCK)
                own = [np.frombuffer(x, U) for x in b.column("keys").to_pylist()]
                size = np.array([len(x) for x in own], np.int32)
                bits = parities(np.concatenate(own), np.r_[0, np.cumsum(size)], FINE)
                yield pa.RecordBatch.from_arrays([b.column("cls"), pa.array(size), pa.array([x.tobytes() for x in bits], pa.binary())], names=["cls", "size", "sketch"])

    return sets.select("cls", "keys").mapInArrow(scan, "cls long, size int, sketch binary")


def _words(sketch) -> np.ndarray:
    own = sketch.to_pylist()
    return np.frombuffer(b"".join(own), U).reshape(len(own), -1 if own else 0)


def may_be_near(x, y, size_x, size_y, threshold: int = THRESHOLD):
    """Could sets with these sketches link? Sketches differ in no more places than the sets in shingles."""
    return np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= size_x + size_y - 2 * needed(size_x, size_y, threshold)


def near_pairs(pairs: DataFrame, sketch: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose sketches allow a link."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, k in ((b, k) for b in batches for k in range(0, b.num_rows, BLOCK)):
            b = whole.slice(k, BLOCK)
            size = [b.column(c).to_numpy().astype(np.int64) for c in ("size_a", "size_b")]
            yield b.select(["a", "b"]).filter(pa.array(may_be_near(_words(b.column("x")), _words(b.column("y")), *size, threshold)))

    of = lambda c, to: sketch.select(F.col("cls").alias(c), F.col("sketch").alias(to))
    met = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "size_a", "size_b", "x", "y")
    return met.mapInArrow(scan, "a long, b long")


def crowd_pairs(rows: DataFrame, sketch: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (a, b) of classes of different components among ``crowded`` rows whose sketches allow a link.

    A crowd is cut into blocks of about ``BLOCK`` classes, and every two blocks meet in a task of their own.
    """
    blocks = F.ceil(F.col("crowd") / BLOCK)
    each = (rows.withColumns({"mine": F.pmod(F.xxhash64("cls"), blocks), "other": F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))})
            .withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")}).join(sketch, "cls"))

    def group(key, table):
        col = {c: table.column(c).to_numpy() for c in ("cls", "size", "pos", "component", "mine")}
        col["size"], col["pos"] = col["size"].astype(np.int64), col["pos"].astype(np.int64)
        bits = _words(table.column("sketch"))
        mine, theirs = (np.flatnonzero(col["mine"] == k.as_py()) for k in key[1:])
        found = [np.zeros((0, 2), np.int64)]
        for k in range(0, len(mine), 64):
            x, y = mine[k: k + 64, None], theirs[None]
            size = [col["size"][x], col["size"][y]]
            met = ((col["component"][x] != col["component"][y]) & (threshold * size[0] <= 100 * size[1]) & (threshold * size[1] <= 100 * size[0])
                   & _may_link(size[0], col["pos"][x], size[1], col["pos"][y], threshold))
            i, j = np.nonzero(met if key[1] != key[2] else met & (x < y))
            i, j = mine[k + i], theirs[j]
            near = may_be_near(bits[i], bits[j], col["size"][i], col["size"][j], threshold)
            found.append(np.stack([i[near], j[near]], 1))
        x, y = col["cls"][np.concatenate(found).T]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return each.groupBy("key", "low", "high").applyInArrow(group, "a long, b long").distinct()


def class_components(own: DataFrame, threshold: int = THRESHOLD):
    """The order, (doc_id, cls, size) per row of ``own`` (doc_id long, text), (cls, component, component_id)."""
    spark = own.sparkSession
    order = spark.sparkContext.broadcast(Order(common_shingles(own)))
    met = settle(meet(signatures(own, order, 8 * partitions(spark), threshold), threshold))
    members = met.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("cls"), F.col("size_a").alias("size"))
    shared = met.where("kind = 2").select(F.col("a").alias("key"), F.col("b").alias("cls"), F.col("size_b").alias("size"), F.col("n").alias("pos"))
    star = settle(star_pairs(met.where("kind = 1"), threshold))
    filled = members.where("size > 0")
    links = settle(verify_links(star, settle(sets_of(star.select(F.array("a", "b").alias("c")), own, filled, order)), threshold, local=True))
    comp = settle(components(links))
    rows = settle(labelled(shared, comp))
    blocks = settle(block_pairs(rows, comp))
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    few, many = settle(residual_pairs(rows, threshold).join(tried, ["a", "b"], "left_anti")), crowded(rows)
    met_again = few.select(F.explode(F.array("a", "b")).alias("cls")).unionByName(many.select("cls")).distinct()
    sketch = settle(met.where("kind = 0").select(F.col("b").alias("cls"), "sketch").join(met_again, "cls").dropDuplicates(["cls"]))
    rest = settle(near_pairs(few, sketch, threshold).unionByName(crowd_pairs(many, sketch, threshold).join(tried, ["a", "b"], "left_anti")).distinct())
    wanted = blocks.select(F.array("cls").alias("c")).unionByName(rest.select(F.array("a", "b").alias("c")))
    sets = settle(sets_of(wanted, own, filled, order))
    fine = settle(fine_sketches(sets.join(rest.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "cls", "left_semi")))
    of = lambda c: fine.select(F.col("cls").alias(c), F.col("size").alias(f"size_{c}"))
    rest = settle(near_pairs(rest.join(of("a"), "a").join(of("b"), "b"), fine, threshold))
    more = block_links(blocks, sets, threshold).unionByName(verify_links(rest, sets, threshold))
    comp = settle(components(links.unionByName(more)))
    root = filled.groupBy("cls").agg(F.min("doc_id").alias("low")).join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    low = settle(root.groupBy("component").agg(F.min("low").alias("component_id")))
    return order, members, settle(root.select("cls", "component").join(low, "component").select("cls", "component", "component_id"))


def _long_id(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of ``docs``."""
    kind = dict(docs.dtypes)[id_col]
    _, members, by_class = class_components(docs.select(_long_id(id_col), F.col(text_col).alias("text")), threshold)
    out = members.join(by_class, "cls", "left").select(
        F.nullif("doc_id", F.lit(NULL_ID)).cast(kind).alias("doc_id"), F.col("size").cast("long").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("component_id", F.nullif("component_id", F.lit(NULL_ID)).cast(kind))


def smallest_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The row of the smallest (doc_id, text) of each component, nulls first; columns as they were.

    Texts without a word are linked with nothing; of rows equal in id and text one stays. All choices are
    aggregates that combine map-side, so rows that share an id or a class never gather in one task.
    """
    rows = docs.select(_long_id(id_col), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    order, members, by_class = class_components(rows.select("doc_id", "text"), threshold)
    first = settle(members.join(by_class, "cls").where("doc_id = component_id").select("doc_id", "cls", "component").distinct())
    has_word = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    own = thinned(with_class(thinned(rows.where(has_word), first), order), first, "cls")
    best = own.groupBy("doc_id", "cls").agg(F.min_by("row", "text").alias("row"), F.min("text").alias("text")).join(first, ["doc_id", "cls"])
    stay = best.groupBy("component").agg(F.min_by("row", "text").alias("row")).select("row")
    wordless = rows.where(~has_word).groupBy("doc_id", "text").agg(F.first("row").alias("row")).select("row")
    return stay.unionByName(wordless).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op5(spark, sf_dir: str) -> DataFrame:
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
