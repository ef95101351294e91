"""Equal windows across a corpus, without shuffling the corpus: anchored blocks.

A window is ``width`` consecutive units (bytes or words) of one text. Its anchor is the smallest gram hash in it
(leftmost on ties), so equal windows have equal anchors at equal places. Consecutive windows of a text with the
same anchor form a *block*: every window lies in exactly one block, and windows can only be equal if their
blocks' anchors are. ``anchor_blocks`` emits one small record per block, packed per bucket of anchors;
``group_blocks`` meets equal anchors and separates

* ``settled`` blocks: an identical block occurred before (same anchor, same content hash);
* ``open`` blocks: the first of its content, but another content shares its anchor, so single windows may be
  equal. Only these blocks' own text is fetched, and an operator's own method decides on their windows.

A block that nothing shares an anchor with leaves no trace. Identical blocks collapse inside a map task first, so
a passage that a third of all documents hold reaches its bucket once per task, not once per document.
Hashes are 64-bit anchors plus 64-bit contents: two different blocks would have to agree in both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.sparkops import partitions, thinned
from ledgerlens.llm.textops import U, mix, text_slices

#: a map task hands over its packed records whenever it holds so many
FLUSH_RECORDS = 1 << 20
#: bytes of text whose derived arrays are held at once (or the longest single text)
SLICE = 1 << 20
#: hot anchors: one document in HOT_SAMPLE is looked at, HOT_LEAST different blocks there make an anchor hot
HOT_SAMPLE, HOT_LEAST, HOT_MOST = 64, 16, 1 << 16
_ODD = U(0xBF58476D1CE4E5B9)
_ODD_INVERSE = U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
RECORD = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("first", "<i4"), ("windows", "<i2"), ("count", "<i2")])
SETTLED = np.dtype([("doc", "<i8"), ("first", "<i4"), ("windows", "<i4")])


@dataclass(frozen=True)
class Units:
    """How a text is cut: ``read(data, offs)`` gives a hash of the gram at each unit and the unit counts per row."""

    width: int
    gram: int
    read: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]

    @property
    def reach(self) -> int:
        """Grams in a window."""
        return self.width - self.gram + 1


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64 (kept between slices)."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U)
        have[0] = 1
        _POWERS[int(base)] = have = np.multiply.accumulate(have)
    return have[:n]


def blocks_of(grams: np.ndarray, counts: np.ndarray, units: Units, hot: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Row, first window (unit index in its row), number of windows, anchor hash, content hash of every block.

    A block whose anchor is in ``hot`` (ascending) is cut into single windows, each its own anchor.
    """
    bounds = np.r_[0, np.cumsum(counts)]
    n, reach = int(bounds[-1]), units.reach
    each = np.maximum(0, counts - units.width + 1)
    total = int(each.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(U), none.astype(U)
    row = np.repeat(np.arange(len(counts)), each)
    valid = np.arange(total) + np.repeat(bounds[:-1] - (np.cumsum(each) - each), each)
    place_bits = U(int(n).bit_length())
    low = (grams >> place_bits << place_bits) | np.arange(n, dtype=U)
    span = 1
    while span < reach:   # minimum over `reach` grams by doubling
        step = min(span, reach - span)
        low = np.minimum(low[: len(low) - step], low[step:])
        span += step
    place = (low[valid] & ((U(1) << place_bits) - U(1))).astype(np.int64)
    at = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])])
    size = np.diff(np.r_[at, total])
    begin, row, anchor = valid[at], row[at], grams[place[at]]
    prefix = np.r_[U(0), np.cumsum(grams[:n] * _powers(_ODD, n))]

    def content(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix((prefix[begin + size - 1 + reach] - prefix[begin]) * _powers(_ODD_INVERSE, n)[begin] + size.astype(U))

    if hot is not None and len(hot):
        i = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
        cut = hot[i] == anchor
        if cut.any():
            k = size[cut]
            single = np.repeat(begin[cut], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            ones = np.ones(len(single), np.int64)
            own = content(single, ones)
            begin, size = np.r_[begin[~cut], single], np.r_[size[~cut], ones]
            row = np.r_[row[~cut], np.repeat(row[cut], k)]
            anchor = np.r_[anchor[~cut], mix(own ^ np.repeat(anchor[cut], k))]
    return row, begin - bounds[row], size, anchor, content(begin, size)


def _pack(rec: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    key = ((rec["anchor"] >> U(20)) % U(buckets)).astype(np.int32)
    o = np.argsort(key, kind="stable")
    rec, key = rec[o], key[o]
    ends = np.flatnonzero(np.r_[key[1:] != key[:-1], True]) + 1
    begin = 0
    for end in ends:
        yield int(key[begin]), rec[begin:end].tobytes()
        begin = end


def _collapse(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first record of each (anchor, content), with counts up to 2; and the others.

    The same place twice (a repeated row) is one occurrence.
    """
    if not len(rec):
        return rec, rec
    rec = rec[np.lexsort((-rec["count"], rec["first"], rec["doc"], rec["content"], rec["anchor"]))]
    new = np.r_[True, (rec["anchor"][1:] != rec["anchor"][:-1]) | (rec["content"][1:] != rec["content"][:-1])]
    place = new | np.r_[True, (rec["doc"][1:] != rec["doc"][:-1]) | (rec["first"][1:] != rec["first"][:-1])]
    rec, new = rec[place], new[place]
    at = np.flatnonzero(new)
    heads = rec[at].copy()
    heads["count"] = np.minimum(2, np.add.reduceat(rec["count"].astype(np.int64), at))
    return heads, rec[~new]


def _settled(rec: np.ndarray) -> np.ndarray:
    out = np.empty(len(rec), SETTLED)
    out["doc"], out["first"], out["windows"] = rec["doc"], rec["first"], rec["windows"]
    return out


def hot_anchors(docs: DataFrame, units: Units) -> np.ndarray:
    """Anchors that very many different blocks share (the edges of common passages), ascending.

    Counted on one document in ``HOT_SAMPLE``, at most ``HOT_MOST`` of them. The list only decides how finely
    their blocks are cut, everywhere alike; any list gives the same result, this one keeps buckets small.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offs in text_slices(b.column(0), SLICE):
                _, _, _, anchor, content = blocks_of(*units.read(data, offs), units)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))], names=["anchor", "content"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_SAMPLE)) == 0).select("text")
    often = (sample.mapInArrow(scan, "anchor long, content long").groupBy("anchor").agg(F.approx_count_distinct("content", 0.2).alias("n"))
             .where(F.col("n") >= HOT_LEAST).orderBy(F.desc("n"), "anchor").limit(HOT_MOST).select("anchor").collect())
    return np.sort(np.array([r[0] for r in often], np.int64).view(U))


def anchor_blocks(docs: DataFrame, units: Units, buckets: int) -> DataFrame:
    """(bucket, records, settled): packed block records per anchor bucket; ``settled`` rides in any bucket.

    ``docs`` has columns doc_id (long, not null) and text. Record counts saturate at 2.
    """
    hot = docs.sparkSession.sparkContext.broadcast(hot_anchors(docs, units))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            heads, others = _collapse(np.concatenate(held))
            held.clear()
            if len(heads):
                ids, packed = zip(*_pack(heads, buckets))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(packed, pa.binary()), pa.nulls(len(ids), pa.binary())], names=names)
            for i in range(0, len(others), 1 << 15):   # spread over buckets by where they lie
                part = _settled(others[i: i + (1 << 15)])
                yield pa.RecordBatch.from_arrays([pa.array([int(part["doc"][0] * 31 + i) % buckets], pa.int32()), pa.array([None], pa.binary()),
                                                  pa.array([part.tobytes()], pa.binary())], names=names)

        names = ["bucket", "records", "settled"]
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, offs in text_slices(b.column(1), SLICE):
                row, first, size, anchor, content = blocks_of(*units.read(data, offs), units, hot.value)
                rec = np.empty(len(row), RECORD)
                rec["anchor"], rec["content"], rec["doc"] = anchor, content, ids[i + row]
                rec["first"], rec["windows"], rec["count"] = first, size, 1
                held.append(rec)
                if sum(map(len, held)) >= FLUSH_RECORDS:
                    yield from flush()
        if held:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(scan, "bucket int, records binary, settled binary")


def group_blocks(packed: DataFrame, repeats_settle_first: bool) -> DataFrame:
    """(kind, doc_id, first, windows, anchor, count) of the blocks that matter.

    kind 0: settled, every window is a repeat. kind 1: open, with the number of its copies (1 or 2+).
    ``repeats_settle_first``: a block with copies is itself all repeats (any other occurrence counts, not only
    earlier ones); it is settled then, and stays open as evidence for its anchor's other contents.
    """

    def meet(key, table):
        parts = [np.frombuffer(x, RECORD) for x in table.column("records").to_pylist() if x]
        heads, others = _collapse(np.concatenate(parts) if parts else np.zeros(0, RECORD))
        done = [_settled(others)] + [np.frombuffer(x, SETTLED) for x in table.column("settled").to_pylist() if x]
        if repeats_settle_first:
            done.append(_settled(heads[heads["count"] > 1]))
        done = np.concatenate(done)
        a = heads["anchor"]
        shared = np.zeros(len(heads), bool)
        if len(heads) > 1:
            same = a[1:] == a[:-1]
            shared[1:] |= same
            shared[:-1] |= same
        rest = heads[shared]
        n, k = len(done), len(rest)
        return pa.table({
            "kind": np.r_[np.zeros(n, np.int8), np.ones(k, np.int8)], "doc_id": np.r_[done["doc"], rest["doc"]],
            "first": np.r_[done["first"], rest["first"]].astype(np.int32), "windows": np.r_[done["windows"], rest["windows"].astype(np.int32)].astype(np.int32),
            "anchor": np.r_[np.zeros(n, np.int64), rest["anchor"].view(np.int64)], "count": np.r_[np.full(n, 2, np.int16), rest["count"]]})

    return packed.groupBy("bucket").applyInArrow(meet, "kind tinyint, doc_id long, first int, windows int, anchor long, count smallint")


def bucket_count(spark) -> int:
    """Buckets follow the cluster's shuffle partitions, a few each, so that one bucket stays small."""
    return 8 * partitions(spark)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id long, text string) for the scan; a null id is the smallest long."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def open_texts(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, text, open array<struct<first, windows, anchor, count>>) of the documents that hold open blocks."""
    own = blocks.where("kind = 1").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first", "windows", "anchor", "count"))).alias("open"))
    return thinned(docs, own).join(own, "doc_id")


def with_runs(docs: DataFrame, marks: DataFrame, id_col: str) -> DataFrame:
    """``docs`` with ``_runs``: per document the ascending array of struct(first, windows), null if none."""
    runs = marks.groupBy(F.col("doc_id").alias("_key")).agg(F.sort_array(F.collect_list(F.struct("first", "windows"))).alias("_runs"))
    return docs.join(runs, F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))) == F.col("_key"), "left").drop("_key")


def covered_spans(first: np.ndarray, windows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge runs of windows (ascending by first) into maximal covered unit spans: starts and ends."""
    if not len(first):
        none = np.zeros(0, np.int64)
        return none, none
    first = first.astype(np.int64)
    end = np.maximum.accumulate(first + windows + width - 1)
    new = np.r_[True, first[1:] > end[:-1]]
    at = np.flatnonzero(new)
    return first[at], end[np.r_[at[1:] - 1, len(end) - 1]]
