"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item is found in a document if at least ``threshold`` percent of its distinct five-word shingles (words
lower-cased A-Z) are among the document's. Items are partitioned by size (powers of two). For each partition a
document is cut into overlapping windows of at most four times its smallest item size, so that a short item fills a good part of the window
it lies in however long the document is; a window is a candidate for an item if any of ``PERMUTATIONS`` MinHash
values agree. Windows of coarser partitions reuse the finer ones' minima. Every candidate (document, item) is
verified with the exact sets of the whole document, so nothing false is ever returned.

Recall: an item of q shingles, 80 % of them in one window of at most 4 q, agrees in one permutation with
probability about 0.2 or more, and is missed by all 96 with less than 1e-9; spread over several windows the chance
is about the same, as each window adds its share.

Items are broadcast in blocks of bounded text (``BLOCK_CHARS``), one scan of the documents per block. No shuffle.

Defined cases: null texts are empty; an item or document of fewer than five words has its whole sequence as one
shingle; an item without words is found nowhere; repeated rows of documents give repeated result rows, repeated
item rows count once; null ids pass through; empty tables give empty results; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.textops import U, sets_by_row, shingles, text_slices, word_hashes, words

SHINGLE, THRESHOLD = 5, 80
PERMUTATIONS = 96
#: characters of item texts that one broadcast holds
BLOCK_CHARS = 1 << 24
_SEED = 7


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, row = words(data, offs)
    return shingles(word_hashes(data, starts, ends, lower=True), row, SHINGLE)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    return rng.integers(0, 2**32, PERMUTATIONS, np.uint32) | np.uint32(1), rng.integers(0, 2**32, PERMUTATIONS, np.uint32)


def _short(tok: np.ndarray) -> np.ndarray:
    return (tok >> U(32)).astype(np.uint32)


class ItemIndex:
    """MinHash signatures of a block of items, partitioned by size, and their exact sets."""

    def __init__(self, ids: list, texts: list[str]):
        data, offs = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        tok, row = np.zeros(0, U), np.zeros(0, np.int64)
        for i, _, data, offs in text_slices(pa.array(texts, pa.string()), 1 << 40):
            tok, row = sets_by_row(*_tokens(data, offs))
        at = np.searchsorted(row, np.arange(len(ids) + 1))
        self.ids, self.sets = ids, [tok[at[i]: at[i + 1]] for i in range(len(ids))]
        size = np.diff(at)
        self.mul, self.add = _permutations()
        low = _short(tok)
        part = np.floor(np.log2(np.maximum(size, 1))).astype(int)
        self.parts: dict[int, list] = {}
        for p in sorted(set(part[size > 0].tolist())):
            own = np.flatnonzero((part == p) & (size > 0))
            rows = np.concatenate([np.arange(at[i], at[i + 1]) for i in own])
            heads = np.cumsum(size[own]) - size[own]
            bits = max(12, int(64 * len(own)).bit_length())
            tables = []
            for m, a in zip(self.mul, self.add):
                sig = np.minimum.reduceat(low[rows] * m + a, heads)
                o = np.argsort(sig, kind="stable")
                known = np.zeros(1 << bits, bool)
                known[self._slot(sig, bits)] = True
                tables.append((sig[o], own[o], known))
            self.parts[p] = [bits, tables]

    @staticmethod
    def _slot(sig: np.ndarray, bits: int) -> np.ndarray:
        return (sig * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)

    def candidates(self, tok: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
        """Distinct (row, item) pairs of which some window agrees in some permutation; tokens in text order."""
        if not len(tok) or not self.parts:
            return np.zeros((0, 2), np.int64)
        low = _short(tok)
        finest = min(self.parts)
        # block starts per level: blocks of 2 ** (finest + 1) shingles of one row, then pairs of blocks
        count = np.bincount(row, minlength=n_rows)
        begin = np.cumsum(count) - count
        levels, step, size, base = [], 1 << (finest + 1), count, begin
        for p in range(finest, max(self.parts) + 1):
            blocks = -(-size // step)
            of = np.repeat(np.arange(n_rows), blocks)
            first = np.cumsum(blocks) - blocks
            levels.append((p, np.repeat(base, blocks) + step * (np.arange(len(of)) - np.repeat(first, blocks)), of))
            step, size, base = 2, blocks, first
        found = []
        for k, (m, a) in enumerate(zip(self.mul, self.add)):
            least = low * m + a
            for p, starts, of in levels:
                least = np.minimum.reduceat(least, starts)
                if p not in self.parts:
                    continue
                window = least.copy()
                same = of[1:] == of[:-1]
                window[:-1][same] = np.minimum(least[:-1][same], least[1:][same])
                bits, tables = self.parts[p]
                sig, items, known = tables[k]
                hit = np.flatnonzero(known[self._slot(window, bits)])
                lo, hi = np.searchsorted(sig, window[hit], "left"), np.searchsorted(sig, window[hit], "right")
                n = hi - lo
                if n.any():
                    i = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    found.append(np.stack([np.repeat(of[hit], n), items[i]], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def contained(self, data: np.ndarray, offs: np.ndarray, threshold: int) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) of every item that a row contains."""
        tok, row = _tokens(data, offs)
        bounds = np.searchsorted(row, np.arange(len(offs)))
        last, own = -1, None
        for r, item in self.candidates(tok, row, len(offs) - 1).tolist():
            if r != last:
                last, own = r, np.unique(tok[bounds[r]: bounds[r + 1]])
            want = self.sets[item]
            shared = int(np.isin(want, own, assume_unique=True).sum())
            if 100 * shared >= threshold * len(want):
                yield r, item, shared


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[ItemIndex]:
    """Indexes of bounded size that together hold all items."""
    own = items.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    chars = own.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = -(-chars // BLOCK_CHARS)
    for k in range(n):
        rows = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        if rows:
            yield ItemIndex([r[0] for r in rows], [r[1] for r in rows])


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
               item_text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): every item that a document contains."""
    sc = docs.sparkSession.sparkContext
    kinds = dict(docs.dtypes)[id_col], dict(items.dtypes)[item_id]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, n_shared long, n_item long"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(items, item_id, item_text):
        index = sc.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            for b in batches:
                for i, _, data, offs in text_slices(b.column(1)):
                    hits = list(own.contained(data, offs, threshold))
                    if hits:
                        rows, which, shared = zip(*hits)
                        yield pa.RecordBatch.from_arrays([
                            b.column(0).take(pa.array([i + r for r in rows])), pa.array([own.ids[x] for x in which]),
                            pa.array(shared, pa.int64()), pa.array([len(own.sets[x]) for x in which], pa.int64())], names=["doc_id", "item_id", "n_shared", "n_item"])

        out = out.unionByName(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(scan, schema))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                  threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that contain an item; all columns as they were, no shuffle."""
    at = docs.columns.index(text_col)
    for block in item_blocks(items, item_id, item_text):
        index = docs.sparkSession.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for i, _, data, offs in text_slices(b.column(at)):
                    for r, _, _ in index.value.contained(data, offs, threshold):
                        keep[i + r] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs


def op10(spark, sf_dir: str) -> DataFrame:
    return find_items(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL = rf"""
WITH w AS (SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents
           UNION ALL SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') FROM benchmark),
s AS (SELECT DISTINCT side, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))
             ELSE [array_to_string(w, ' ')] END) AS k FROM w WHERE len(w) > 0),
n AS (SELECT id, count(*) AS n FROM s WHERE side = 1 GROUP BY id),
h AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM s d JOIN s b ON d.k = b.k WHERE d.side = 0 AND b.side = 1 GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n AS n_item FROM h JOIN n ON n.id = h.item_id WHERE 100 * n_shared >= 80 * n
"""
