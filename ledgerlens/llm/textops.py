"""Vectorised text work inside Arrow batches: slices, words, hashes, shingle sets.

A task never holds more than one slice of derived arrays: ``text_slices`` cuts a batch into runs of whole
texts of about ``SLICE_BYTES``, so memory is bounded by that or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 1 << 21
#: words are runs of bytes other than space and \t \n \v \f \r
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LOW_BYTES = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U(31))
    x = x * U(0x9E3779B97F4A7C15)
    x = x ^ (x >> U(29))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def text_slices(texts, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets of the rows in them) for runs of whole texts; null reads as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    arr = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(arr):
        return
    _, offsets, body = arr.buffers()
    offs = np.frombuffer(offsets, np.int64)[arr.offset: arr.offset + len(arr) + 1]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(arr):
        j = min(len(arr), max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1))
        yield i, j, data[offs[i]: offs[j]], offs[i: j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; no word crosses rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    blank = BLANK[data]
    inside = ~blank
    first = inside.copy()
    first[1:] &= blank[:-1]
    at = offs[:-1][offs[:-1] < len(data)]
    first[at] = inside[at]
    last = inside.copy()
    last[:-1] &= blank[1:]
    at = offs[1:][offs[1:] > 0] - 1
    last[at] = inside[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one integer (zeros after the end)."""
    x = np.zeros(len(data) + 8, U)
    x[: len(data)] = data
    x[:-1] |= x[1:] << U(8)
    x[:-2] |= x[2:] << U(16)
    x[:-4] |= x[4:] << U(32)
    return x


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z lower-cased first if asked)."""
    x = lanes(LOWER[data] if lower else data)
    n = ends - starts
    h = n.astype(U) * U(0xA24BAED4963EE407)
    rows, at = np.arange(len(n)), 0
    while len(rows):
        left = n[rows] - at
        h[rows] = mix(h[rows] ^ (x[starts[rows] + at] & _LOW_BYTES[np.minimum(left, 8)]))
        rows, at = rows[left > 8], at + 8
    return h


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k consecutive units; crossing rows is the caller's business."""
    m = max(0, len(h) - k + 1)
    acc = h[:m].copy()
    for j in range(1, k):
        acc = acc * U(0xC2B2AE3D27D4EB4F) + h[j: m + j]
        acc ^= acc >> U(29)
    return mix(acc)


def shingles(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every k-word shingle, in order; a row of fewer than k words has its whole sequence as one."""
    g = grams(h, k)
    ok = row[: len(g)] == row[k - 1:] if len(g) else np.zeros(0, bool)
    out, at = [g[ok]], [row[: len(g)][ok]]
    if len(row):
        heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        counts = np.diff(np.r_[heads, len(row)])
        for n in range(1, k):
            f = heads[counts == n]
            if len(f):
                acc = h[f].copy()
                for j in range(1, n):
                    acc = acc * U(0xC2B2AE3D27D4EB4F) + h[f + j]
                    acc ^= acc >> U(29)
                out.append(mix(acc + U(n)))
                at.append(row[f])
        if len(out) > 1:
            tok, at = np.concatenate(out), np.concatenate(at)
            o = np.argsort(at, kind="stable")
            return tok[o], at[o]
    return out[0], at[0]


def sets_by_row(tok: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of each row, ascending within the row (rows ascending)."""
    o = np.lexsort((tok, row))
    tok, row = tok[o], row[o]
    if not len(tok):
        return tok, row
    new = np.r_[True, (tok[1:] != tok[:-1]) | (row[1:] != row[:-1])]
    return tok[new], row[new]


def row_bounds(row: np.ndarray, n_rows: int) -> np.ndarray:
    """Where each row's entries begin (n_rows + 1 values), for ascending rows."""
    return np.searchsorted(row, np.arange(n_rows + 1))
