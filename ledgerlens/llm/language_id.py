"""Language identification of mixed-language text: script ranges, per-word scores, Viterbi with a switching penalty.

Words are runs of letters (Unicode category L, lower-cased, with the marks that follow them); digits, punctuation and
symbols of any script are blanks. ``train`` counts hashed byte trigrams
(word boundaries included) and letters per script for each language of a labelled sample of at most about
``TRAIN_DOCS`` documents a language. A word's script leaves only languages that write at least ``SCRIPT_SHARE`` of
their letters in it; each remaining language scores the word by its trigrams' log-likelihood. Viterbi over the words of the text, with
``SWITCH`` nats for each change of language, gives spans; the text's label is the language with most letters, its
score the letter-weighted mean posterior of that label (0 where another language was labelled).

Defined cases: null text, empty text or text without a letter: no spans, label ``und``, score 0; ties go to the
language that sorts first; without labelled rows everything is ``und``; repeated rows give repeated rows; null
ids pass through; an empty table gives an empty result; further columns are never read. No shuffle but the
sample's counts; the model (65,536 numbers a language) is broadcast.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.textops import U, text_slices, words

UND = "und"
#: bound of the labelled sample: expected documents per language
TRAIN_DOCS = 3000
SLOTS = 1 << 16
SWITCH = 12.0
SCRIPT_SHARE = 0.01
#: a text below this score is rejected by ``identified``
MIN_SCORE = 0.2
#: bytes of text whose derived arrays a task holds at once (or one longer text)
SLICE = 1 << 19

#: fixed values: first code points of script blocks (a block reaches to the next), Unicode
SCRIPTS = [("latin", 0x41), ("greek", 0x370), ("cyrillic", 0x400), ("armenian", 0x530), ("hebrew", 0x590), ("arabic", 0x600),
           ("indic", 0x900), ("thai", 0xE00), ("lao_tibetan", 0xE80), ("georgian", 0x10A0), ("hangul_jamo", 0x1100), ("ethiopic", 0x1200),
           ("latin_extended", 0x1E00), ("symbols", 0x2000), ("kana", 0x3040), ("han", 0x3400), ("hangul", 0xAC00), ("other", 0xD7B0)]
_SAME = {"latin_extended": "latin", "hangul_jamo": "hangul"}
_NAMES = [_SAME.get(n, n) for n, _ in SCRIPTS]
_SCRIPT_IDS = np.array([sorted(set(_NAMES)).index(n) for n in _NAMES])
_SCRIPT_FROM = np.array([c for _, c in SCRIPTS])
N_SCRIPTS = len(set(_NAMES))
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True


def held_out(id_col: Column) -> Column:
    """Rows kept out of training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(4)) == 2, F.lit(False))


@functools.cache
def _unicode() -> tuple[np.ndarray, np.ndarray]:
    """By code point: is it a letter, is it a mark?"""
    kind = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(0x110000)).encode(), np.uint8)
    return kind == ord("L"), kind == ord("M")


def _letters(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Per byte: does it belong to a letter, or to a mark in a run of marks right after a letter of its row?"""
    keep = _LETTER[data]
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return keep
    size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
    b = [data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) & (0x3F if k else 0xFF) for k in range(4)]
    code = np.where(size == 2, (b[0] & 0x1F) << 6 | b[1], np.where(size == 3, (b[0] & 0xF) << 12 | b[1] << 6 | b[2], (b[0] & 7) << 18 | b[1] << 12 | b[2] << 6 | b[3]))
    letter, mark = (table[code] for table in _unicode())
    for k in range(4):
        keep[(lead + k)[letter & (size > k)]] = True
    at, n = lead[mark], size[mark]
    if len(at):
        first = np.isin(at, offs)
        head = np.flatnonzero(np.r_[True, (at[1:] != (at + n)[:-1]) | first[1:]])
        after = ~first[head] & keep[at[head] - 1]
        ok = np.repeat(after, np.diff(np.r_[head, len(at)]))
        for k in range(4):
            keep[(at + k)[ok & (n > k)]] = True
    return keep


def _words(data: np.ndarray, offs: np.ndarray):
    """Cleaned bytes (non-letters blank), word starts, ends, rows, and letters (code points) per word."""
    clean = np.where(_letters(data, offs), data, 32).astype(np.uint8)
    starts, ends, row = words(clean, offs)
    heads = np.r_[0, np.cumsum((clean & 0xC0) != 0x80)]   # bytes that start a code point
    return clean, starts, ends, row, heads[ends] - heads[starts]


def _scripts(clean: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Script of each word's first letter."""
    b = [np.where(starts + k < len(clean), clean[np.minimum(starts + k, len(clean) - 1)], 0).astype(np.int64) for k in range(3)]
    code = np.where(b[0] < 0x80, b[0], np.where(b[0] < 0xE0, (b[0] & 0x1F) << 6 | (b[1] & 0x3F),
                    np.where(b[0] < 0xF0, (b[0] & 0xF) << 12 | (b[1] & 0x3F) << 6 | (b[2] & 0x3F), 0xFFFF)))
    return _SCRIPT_IDS[np.maximum(np.searchsorted(_SCRIPT_FROM, code, "right") - 1, 0)]


def _trigrams(clean: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot of every trigram that touches a word (from the blank before it to the blank after), and where words begin in it."""
    n = ends - starts   # trigrams centred on each byte of the word
    heads = np.cumsum(n) - n
    mid = np.repeat(starts - heads, n) + np.arange(int(n.sum()))
    before = np.where(mid > np.repeat(starts, n), clean[np.maximum(mid - 1, 0)], 32).astype(U)
    after = np.where(mid + 1 < np.repeat(ends, n), clean[np.minimum(mid + 1, len(clean) - 1)], 32).astype(U)
    g = before | clean[mid].astype(U) << U(8) | after << U(16)
    return ((g * U(0x9E3779B97F4A7C15)) >> U(48)).astype(np.int64), heads


def _lower_slices(texts) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, lower-cased UTF-8 bytes, offsets of the rows in them); no batch is copied whole."""
    for i, j, _, _ in text_slices(texts, SLICE):
        low = pc.utf8_lower(pc.fill_null(texts.slice(i, j - i).cast(pa.large_string()), ""))
        yield from ((i, j, data, offs) for _, _, data, offs in text_slices(low, 1 << 62))


class Model:
    """Log-likelihoods of trigram slots per language, and which languages write a script."""

    def __init__(self, langs: list[str], slots: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        total = slots.sum(1, keepdims=True)
        self.log = np.log((slots + 0.5) / (total + 0.5 * SLOTS)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        self.writes = share >= SCRIPT_SHARE

    def word_scores(self, clean, starts, ends) -> np.ndarray:
        """[languages, words]: log-likelihood relative to the best; a language that doesn't write the script is out."""
        slot, heads = _trigrams(clean, starts, ends)
        score = np.stack([np.add.reduceat(row[slot], heads) for row in self.log])
        open_ = self.writes[:, _scripts(clean, starts, ends)]
        score = np.where(open_ | ~open_.any(0), score, np.float32(-1e4))
        return score - score.max(0)

    def viterbi(self, score: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Best language per word; ``counts`` words per text, texts one after another. Texts advance side by side."""
        texts = np.argsort(-counts, kind="stable")
        counts_down = counts[texts]
        begin = (np.cumsum(counts) - counts)[texts]
        steps = int(counts_down[0]) if len(counts_down) else 0
        active = np.searchsorted(-counts_down, -np.arange(steps), "left")   # texts with more than t words
        score = np.ascontiguousarray(score.T)
        stayed = np.zeros(score.shape, bool)
        best_before = np.zeros(len(score), np.int16)
        v = np.zeros((len(texts), score.shape[1]), np.float32)
        for t in range(steps):
            k = active[t]
            at = begin[:k] + t
            w = v[:k]
            top = w.argmax(1)
            jump = w[np.arange(k), top][:, None] - np.float32(SWITCH if t else 0)
            stay = w >= jump
            stayed[at] = stay
            best_before[at] = top
            v[:k] = np.where(stay, w, jump) + score[at]
        out = np.zeros(len(score), np.int16)
        now = v.argmax(1).astype(np.int16)
        for t in range(steps - 1, -1, -1):
            k = active[t]
            at = begin[:k] + t
            own = now[:k]
            out[at] = own
            now[:k] = np.where(stayed[at, own], own, best_before[at])
        return out

    def label(self, data: np.ndarray, offs: np.ndarray):
        """Per row: language index (-1: none) and score; and the words' starts, ends, rows and languages."""
        n = len(offs) - 1
        clean, starts, ends, row, letters = _words(data, offs)
        if not len(starts) or not self.langs:
            return np.full(n, -1), np.zeros(n), (starts[:0], ends[:0], row[:0], row[:0])
        score = self.word_scores(clean, starts, ends)
        lang = self.viterbi(score, np.bincount(row, minlength=n))
        posterior = 1 / np.exp(score - score[lang, np.arange(len(lang))]).sum(0)
        k = len(self.langs)
        per = np.bincount(row * k + lang, letters, n * k).reshape(n, k)
        sure = np.bincount(row * k + lang, letters * posterior, n * k).reshape(n, k)
        total = per.sum(1)
        top = per.argmax(1)
        return np.where(total > 0, top, -1), np.where(total > 0, sure[np.arange(n), top] / np.maximum(total, 1), 0.0), (starts, ends, row, lang)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = TRAIN_DOCS) -> Model:
    """Counts over a hash-chosen sample of the labelled rows, about ``docs_per_lang`` of each language."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = spark.createDataFrame(own.groupBy("lang").count().collect(), "lang string, n long")   # one row a language
    chosen = (own.join(F.broadcast(sizes), "lang")
              .where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) * F.col("n") < F.lit(docs_per_lang << 30)).select("lang", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, which = np.unique(np.array(b.column(0).to_pylist(), object).astype(str), return_inverse=True)
            total: dict[tuple[int, int], int] = {}
            for i, j, data, offs in _lower_slices(b.column(1)):
                clean, starts, ends, row, letters = _words(data, offs)
                if not len(starts):
                    continue
                lang = which[i + row]
                slot, _ = _trigrams(clean, starts, ends)
                key = np.r_[np.repeat(lang, ends - starts) * (SLOTS + N_SCRIPTS) + slot, lang * (SLOTS + N_SCRIPTS) + SLOTS + _scripts(clean, starts, ends)]
                n = np.bincount(key, np.r_[np.ones(len(slot)), letters]).astype(np.int64)
                for x in np.flatnonzero(n).tolist():
                    total[x] = total.get(x, 0) + int(n[x])
            if total:
                keys = np.fromiter(total, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names[keys // (SLOTS + N_SCRIPTS)].tolist(), pa.string()), pa.array(keys % (SLOTS + N_SCRIPTS)),
                                                  pa.array(list(total.values()), pa.int64())], names=["lang", "slot", "n"])

    table = chosen.mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table["lang"].unique())
    n = np.zeros((len(langs), SLOTS + N_SCRIPTS))
    n[np.searchsorted(langs, table["lang"].to_numpy(str)) if langs else [], table["slot"].to_numpy(int)] = table["n"].to_numpy()
    return Model(langs, n[:, :SLOTS], n[:, SLOTS:])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, spans array<struct<lang, start, end>>); spans in UTF-8 bytes of the lower-cased text."""
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = [*m.langs, UND]
        span = pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for b in batches:
            for i, j, data, offs in _lower_slices(b.column(1)):
                top, score, (starts, ends, row, lang) = m.label(data, offs)
                at = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (lang[1:] != lang[:-1])]) if len(row) else np.zeros(0, int)
                last = np.r_[at[1:], len(row)][: len(at)] - 1
                spans = pa.StructArray.from_arrays([pa.array([names[x] for x in lang[at]], pa.string()), pa.array(starts[at] - offs[row[at]], pa.int64()),
                                                    pa.array(ends[last] - offs[row[at]], pa.int64())], fields=list(span))
                heads = np.searchsorted(row[at], np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(i, j - i), pa.array([names[x] for x in top], pa.string()), pa.array(np.clip(score, 0, 1)),
                    pa.ListArray.from_arrays(pa.array(heads, pa.int32()), spans)], names=["doc_id", "lang_pred", "score", "spans"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        scan, f"doc_id {kind}, lang_pred string, score double, spans array<struct<lang:string,start:bigint,end:bigint>>")


def identified(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without the rows that have no language (``und``) or none above ``min_score``; columns as they were."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, j, data, offs in _lower_slices(b.column(at)):
                top, score, _ = shared.value.label(data, offs)
                keep[i:j] = (top >= 0) & (score >= min_score)
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(scan, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id")))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, train(training_rows(docs)))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
