"""Word-level substring dedup with suffix automata of reference shards.

Words are runs of characters other than blanks, unchanged. Every word covered by a run of ``width`` consecutive
words whose sequence also starts anywhere else (same document included) goes; runs are judged on the input.

``blocks`` brings together the places where equal runs can lie and ships each distinct block's words once, with
its number of copies. Those blocks are the reference; it is cut into shards between anchors, one suffix automaton
each (bounded in words), and every block is streamed through its shard's automaton for matching statistics: the
state of the longest match is shortened along suffix links to the shallowest one that still holds ``width``
words, and that state's occurrence count decides. Shards meet their blocks by a shuffle on the anchor instead of
a broadcast of every shard to every task: equal runs have equal anchors, so no other shard can match, and no
broadcast grows with the corpus.

Defined cases: null text has no words; texts shorter than ``width`` words stay; rows that share a doc_id are one
document (a repeated row is the same occurrence, and marks apply to each row); a null doc_id is an id of its own;
an empty table gives an empty result; further columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import blocks as B
from ledgerlens.llm.sparkops import settle
from ledgerlens.llm.textops import U, grams, text_slices, word_hashes, words

WIDTH = 35
GRAM = 8
#: words in one automaton (about 500 bytes of memory each); a larger single anchor gets one of its own
AUTOMATON_WORDS = 1 << 16


def read_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the 8 words from each word on (runs past a row's end are never used), and words per row."""
    starts, ends, row = words(data, offs)
    h = word_hashes(data, starts, ends, lower=False)
    g = np.zeros(len(h), U)
    own = grams(h, GRAM)
    g[: len(own)] = own
    return g, np.bincount(row, minlength=len(offs) - 1)


UNITS = B.Units(WIDTH, GRAM, read_words)


class SuffixAutomaton:
    """Suffix automaton of several weighted sequences; ``count`` is the weighted number of end positions."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.length) - 1

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(c)
        if q is not None and length[q] == length[last] + 1:
            return q
        if q is not None:
            return self._split(last, q, c)
        cur = self._state(length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, c)
        return cur

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int], weight: int) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)
            self.count[last] += weight

    def close(self) -> None:
        """Hand each state's count on to its suffixes, longest first."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]

    def matching(self, sequence: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(end, match length, occurrences of the last ``least`` words) where at least that many words match."""
        s, n = 0, 0
        for end, c in enumerate(sequence, 1):
            while s and c not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if c in self.next[s]:
                s, n = self.next[s][c], n + 1
            if n >= least:
                while self.length[self.link[s]] >= least:
                    s = self.link[s]
                    n = self.length[s]
                yield end, n, self.count[s]


def open_sequences(docs: DataFrame, blocks: DataFrame, width: int = WIDTH) -> DataFrame:
    """(shard, anchor, doc_id, first, count, body): word hashes (packed 64-bit) of the open blocks, by shard."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = b.column(2)
            for i, j, data, offs in text_slices(b.column(1)):
                starts, ends, row = words(data, offs)
                h = word_hashes(data, starts, ends, lower=False)
                at = np.searchsorted(row, np.arange(j - i + 1))
                rows = []
                for k in range(j - i):
                    own = h[at[k]: at[k + 1]]
                    doc = b.column(0)[i + k].as_py()
                    rows += [(r["anchor"], doc, r["first"], r["count"], own[r["first"]: r["first"] + r["windows"] + width - 1].tobytes())
                             for r in runs[i + k].as_py() if r["first"] + r["windows"] + width - 1 <= len(own)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.binary()))],
                                                     names=["anchor", "doc_id", "first", "count", "body"])

    found = B.open_texts(docs, blocks).select("doc_id", "text", "open").mapInArrow(cut, "anchor long, doc_id long, first int, count smallint, body binary")
    return found.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(B.bucket_count(docs.sparkSession))))


def repeated_windows(sequences: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, first, windows): runs of windows that also start elsewhere, by matching statistics."""

    def solve(key, table):
        anchor = table.column("anchor").to_numpy()
        order = np.argsort(anchor, kind="stable")
        seqs = [np.frombuffer(x, U).tolist() for x in table.column("body").take(pa.array(order)).to_pylist()]
        anchor = anchor[order]
        doc, first, count = (table.column(c).to_numpy()[order].tolist() for c in ("doc_id", "first", "count"))
        out: list[tuple[int, int, int]] = []
        begin, held = 0, 0
        for i in range(len(seqs)):
            held += len(seqs[i])
            if i + 1 < len(seqs) and (anchor[i + 1] == anchor[i] or held < AUTOMATON_WORDS):
                continue
            auto = SuffixAutomaton()
            for x in range(begin, i + 1):
                auto.add(seqs[x], count[x])
            auto.close()
            for x in range(begin, i + 1):
                run = None
                for end, _, n in auto.matching(seqs[x], width):
                    at = first[x] + end - width
                    if n > 1 and run and run[0] + run[1] == at:
                        run[1] += 1
                    elif n > 1:
                        run = [at, 1]
                        out.append((doc[x], run))
            begin, held = i + 1, 0
        return pa.table({"doc_id": pa.array([d for d, _ in out], pa.int64()), "first": pa.array([r[0] for _, r in out], pa.int32()),
                         "windows": pa.array([r[1] for _, r in out], pa.int32())})

    return sequences.groupBy("shard").applyInArrow(solve, "doc_id long, first int, windows int")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, kept_text, n_words, n_removed, spans): kept words joined by one space; spans of removed words."""
    own = B.keyed(docs, id_col, text_col)
    units = B.Units(width, GRAM, read_words)
    found = settle(B.group_blocks(B.anchor_blocks(own, units, B.bucket_count(docs.sparkSession)), True))
    marks = found.where("kind = 0").select("doc_id", "first", "windows").unionByName(repeated_windows(open_sequences(own, found, width), width))
    joined = B.with_runs(docs.select(F.col(id_col), F.col(text_col).alias("_text")), marks, id_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = b.column(2)
            for i, j, data, offs in text_slices(b.column(1)):
                starts, ends, row = words(data, offs)
                at = np.searchsorted(row, np.arange(j - i + 1))
                raw = data.tobytes()
                kept, gone, spans = [], [], []
                for k in range(j - i):
                    n = int(at[k + 1] - at[k])
                    run = runs[i + k].values
                    stay = np.ones(n, bool)
                    s = e = np.zeros(0, np.int64)
                    if run is not None and len(run):
                        s, e = B.covered_spans(run.field(0).to_numpy(), run.field(1).to_numpy(), width)
                        s, e = np.minimum(s, n), np.minimum(e, n)
                        for x, y in zip(s, e):
                            stay[x:y] = False
                    a, z = starts[at[k]: at[k + 1]][stay].tolist(), ends[at[k]: at[k + 1]][stay].tolist()
                    kept.append(b" ".join([raw[p:q] for p, q in zip(a, z)]))
                    gone.append(n - len(a))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(s, e)])
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(i, j - i), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(np.diff(at), pa.int64()), pa.array(gone, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=["doc_id", "kept_text", "n_words", "n_removed", "spans"])

    kind = dict(docs.dtypes)[id_col]
    return joined.select(F.col(id_col).alias("doc_id"), "_text", "_runs").mapInArrow(
        cut, f"doc_id {kind}, kept_text string, n_words long, n_removed long, spans array<struct<start:bigint,end:bigint>>")


def op8(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, list_slice(w, i, i + 34) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM t WHERE len(w) >= 35)),
h AS (SELECT doc_id, i, md5(array_to_string(k, ' ')) AS k FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM h) WHERE n > 1),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM t),
m AS (SELECT p.doc_id, p.i, p.word, max(r.i) OVER (PARTITION BY p.doc_id ORDER BY p.i) AS last
      FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.i = r.i),
k AS (SELECT doc_id, i, word, last IS NOT NULL AND i - last < 35 AS gone FROM m),
a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
             coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM k GROUP BY doc_id)
SELECT t.doc_id, coalesce(a.n_words, 0) AS n_words, coalesce(a.n_removed, 0) AS n_removed, sha256(coalesce(a.kept, '')) AS kept_sha256
FROM t LEFT JOIN a ON t.doc_id = a.doc_id
"""
