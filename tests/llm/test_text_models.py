"""Language identification, SentencePiece, and the pipeline."""

import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import language_id, line_dedup, sentencepieces
from test_dedup import plain_lines
from test_similarity import plain_components, row_components, shared_id_rows, shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return language_id.train(language_id.training_rows(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    out = language_id.op7(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert len(held) > 150 and np.mean([r.lang == r.lang_pred for r in held]) >= 0.98


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    m = language_id.Model(["a", "b", "c"], np.ones((3, language_id.SLOTS)), np.ones((3, language_id.N_SCRIPTS)))
    counts = np.array([7, 0, 3, 8, 1])
    score = rng.normal(0, 9, (3, counts.sum())).astype(np.float32)
    got = m.viterbi(score, counts)
    import itertools

    at = 0
    for n in counts.tolist():
        own = score[:, at: at + n]
        value = lambda p: sum(own[l, t] for t, l in enumerate(p)) - language_id.SWITCH * sum(x != y for x, y in zip(p, p[1:]))
        best = max(map(value, itertools.product(range(3), repeat=n))) if n else 0
        assert value(got[at: at + n].tolist()) == pytest.approx(best, abs=1e-3)
        at += n


def test_mixed_text_gives_spans(spark, model):
    docs = {r.lang: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) between 900 and 4000").collect()}
    a, b = docs["de"][:600], docs["es"][:300]
    r = language_id.predict(spark.createDataFrame([(1, a + " " + b)], "doc_id long, text string"), model).first()
    assert r.lang_pred == "de" and [s.lang for s in r.spans] == ["de", "es"] and 0.4 < r.score < 0.9
    assert abs(r.spans[0].end - len(a.lower().encode())) < 40


def test_scripts_narrow(spark):
    rows = [(k, t, lang) for k in range(40) for t, lang in (("сегодня хорошая погода", "ru"), ("good weather today", "en"), ("σήμερα καλός καιρός", "el"))]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    out = language_id.predict(spark.createDataFrame([(1, "погода good погода good"), (2, "zzzz"), (3, "καλός")], "doc_id long, text string"), model)
    got = {r.doc_id: r for r in out.collect()}
    assert got[2].lang_pred == "en" and got[3].lang_pred == "el" and {s.lang for s in got[1].spans} <= {"ru", "en"}


def test_language_odd(spark, odd, none, model):
    out = language_id.predict(odd, model)
    assert out.count() == odd.count()
    und = {r.doc_id for r in out.where("lang_pred = 'und'").collect()}
    assert und == {4, 5, 6, 13, None} - {None} | ({None} if None in und else set())
    assert all(r.score == 0 and not r.spans for r in out.where("lang_pred = 'und'").collect())
    kept = language_id.identified(odd, model)
    assert kept.columns == odd.columns and not {4, 5, 6, 13} & {r.doc_id for r in kept.select("doc_id").collect()}
    assert language_id.predict(none, model).count() == 0
    blank = language_id.train(none)
    assert {r.lang_pred for r in language_id.predict(odd, blank).collect()} == {"und"} and language_id.identified(odd, blank).count() == 0


def test_symbols_are_no_letters(spark, model):
    """Dashes, quotes, currency signs, emoji with variation selectors, digits of other scripts: no language."""
    symbols = ["\u2014\u2013 \u2014", "\u201c\u201d\u2018\u2019", "\u20ac\u20ac \u00a3", "\U0001F600\U0001F680 \u2764\ufe0f", "\uff11\uff12\uff13", "\u2026\u2022\u2192", "\u0301\u0301"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(symbols)] + [(50, "the house"), (51, "\u0301")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 and not got[k].spans for k in got if k != 50) and got[50].lang_pred == "en"
    assert [r.doc_id for r in language_id.identified(docs, model).select("doc_id").collect()] == [50]


def test_letters_are_those_of_unicode():
    """Against a plain definition, code point by code point, on two rows."""
    import unicodedata

    rng = np.random.default_rng(6)
    some = "ab Z9\u00e9\u0301\u0308\u4e2d\u2014\uff11\U0001F600\ufe0f\U00010400\u0e01\u0e31\n"
    for _ in range(300):
        rows = ["".join(rng.choice(list(some), rng.integers(0, 12))).lower() for _ in range(3)]
        want = []
        for t in rows:
            before = False
            for c in t:
                kind = unicodedata.category(c)[0]
                before = kind == "L" or kind == "M" and before
                want += [before] * len(c.encode())
        data = np.frombuffer("".join(rows).encode(), np.uint8)
        offs = np.r_[0, np.cumsum([len(t.encode()) for t in rows])]
        assert language_id._letters(data, offs).tolist() == want


def plain_ids(pieces, text):
    known = {p: i for i, p in pieces.text.items()}
    out = []
    for unit in re.findall(sentencepieces._UNIT, " " + text) if text else []:
        for k in range(0, len(unit), sentencepieces.LONGEST):
            u = unit[k: k + sentencepieces.LONGEST]
            best = [(0.0, 0, -1)]
            for e in range(1, len(u) + 1):
                into = [(best[e - 1][0] + pieces.byte_cost, e - 1, -1)]
                into += [(best[s][0] + pieces.score[known[u[s:e]]], s, known[u[s:e]]) for s in range(max(0, e - pieces.longest), e) if u[s:e] in known]
                best.append(max(into))
            own, e = [], len(u)
            while e:
                _, s, i = best[e]
                own[:0] = [i] if i >= 0 else [pieces.byte_ids[b] for b in u[s:e].encode()]
                e = s
            out += own
    return out


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_pieces_odd(spark, odd, none, broadcast):
    pieces = sentencepieces.Pieces()
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()] + [(70, " " * 600 + "\t\n  \n" + "q" * 700 + "\u2581\u2581\r"),
                                                                                 (71, "é.è,÷a×b1é2«x».\u0250a!\u024f?Ü-Z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("unit", F.lit("clash")).withColumn("ids", F.lit("clash"))
    out = sentencepieces.encode_documents(docs, pieces, broadcast_units=broadcast)
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr((i, plain_ids(pieces, t or ""))) for i, t in rows)
    back = sentencepieces.decode_documents(out, pieces).collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(repr((i, t or "")) for i, t in rows)
    assert sentencepieces.encode_documents(none, pieces, broadcast_units=broadcast).count() == 0


def test_long_runs_are_split(spark):
    """100,000 characters without a space, inside a task: letters, signs, and letters that are neither."""
    rows = [(1, "q" * 100_000), (2, "a1" * 50_000), (3, "\u6f22" * 100_000), (4, " " * 100_000 + "x")]
    out = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).select("doc_id", sentencepieces.units(F.col("text")).alias("u"))
    got = {r.doc_id: r.u for r in out.collect()}
    for i, t in rows:
        assert "".join(got[i]) == " " + t
    whole = [u for u in got[2] if u.strip()]
    assert len(whole) == 100_000 and set(whole) == {" a", "a", "1"}


def uncut_ids(pieces, unit):
    """Best segmentation of one whole unit, no position left out."""
    known = {p: i for i, p in pieces.text.items()}
    best = [(0.0, 0, -1)]
    for e in range(1, len(unit) + 1):
        best.append(max([(best[e - 1][0] + pieces.byte_cost, e - 1, -1)] + [
            (best[s][0] + pieces.score[known[unit[s:e]]], s, known[unit[s:e]]) for s in range(max(0, e - pieces.longest), e) if unit[s:e] in known]))
    ids, e = [], len(unit)
    while e:
        _, s, i = best[e]
        ids[:0] = [i] if i >= 0 else [pieces.byte_ids[b] for b in unit[s:e].encode()]
        e = s
    return ids


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_long_units_are_not_cut(spark, broadcast):
    """Pieces that cross any multiple of 256, in units on both sides of the lattice's bound."""
    pieces = sentencepieces.Pieces()
    texts = ["international" * 40, "x" * 255, "x" * 256 + "thing", "\u6f22\u5b57" * 700, "information" * 7000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in sentencepieces.encode_documents(docs, pieces, broadcast_units=broadcast).collect()}
    assert [got[k] for k in range(5)] == [uncut_ids(pieces, " " + t) for t in texts]
    cut = [i for u in (" " + texts[0],) for k in range(0, len(u), 256) for i in uncut_ids(pieces, u[k: k + 256])]
    assert got[0] != cut


def test_lattices_are_built_in_small_tasks(spark, odd, monkeypatch):
    """However few shuffle partitions there are, a task's lattices are those of about ``PART`` code points; same ids."""
    pieces = sentencepieces.Pieces()
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    monkeypatch.setattr(sentencepieces, "PART", 500, raising=False)
    widths = []
    build = sentencepieces.lattice

    def lattice(words, pieces):
        own = words.select(F.spark_partition_id().alias("p"), F.length("unit").alias("n")).groupBy("p").sum("n").collect()
        widths.extend(r[1] for r in own)
        return build(words, pieces)

    monkeypatch.setattr(sentencepieces, "lattice", lattice)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sentencepieces.encode_documents(docs, pieces)
    assert sum(widths) > 15_000 and max(widths) < 4 * 500
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr((i, plain_ids(pieces, t or ""))) for i, t in rows)


def shuffled(plan):
    """Bytes that the exchanges of an executed plan have written, each exchange once."""
    seen, left, n = set(), [plan], 0
    while left:
        p = left.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
            left.append(p.plan() if "Stage" in kind else p.executedPlan())
            continue
        if kind == "ShuffleExchangeExec" and p.id() not in seen:
            seen.add(p.id())
            n += p.metrics().apply("shuffleBytesWritten").value()
        left += [p.children().apply(k) for k in range(p.children().size())]
    return n


def test_many_units_move_less_than_the_texts(spark, tmp_path):
    """Beyond the broadcast, neither a row of each unit of each document nor the texts as they are go through a shuffle."""
    rng = random.Random(3)
    known = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(4000)]
    rows = [(k, " ".join(rng.choices(known, k=1500))) for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(str(tmp_path / "docs"))
    pieces = sentencepieces.Pieces()
    out = sentencepieces.encode_documents(spark.read.parquet(str(tmp_path / "docs")), pieces, broadcast_units=0)
    got = {r.doc_id: list(r.ids) for r in out.collect()}
    own = sum(len(t) for _, t in rows)
    moved = shuffled(out._jdf.queryExecution().executedPlan())
    assert 0 < moved < 0.8 * own, (moved, own)
    for i, t in rows[::41]:
        assert got[i] == plain_ids(pieces, t)


def test_shuffle_files_of_the_lattice_go(spark, tmp_path):
    """When the units are encoded, the shuffle files of the way there are gone; those of two sums of one row may stay."""
    spark.createDataFrame([(k, f"some words of {k}") for k in range(500)], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        found = [found.apply(k) for k in range(found.size())]
        return {f.getName(): f.length() for f in found if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}

    before = files()
    sentencepieces.encode_documents(spark.read.parquet(str(tmp_path / "docs")), broadcast_units=0)
    for _ in range(50):
        left = sum(n for f, n in files().items() if f not in before)
        if left < 500:
            break
        time.sleep(0.1)
    assert left < 500, left


def test_small_blocks_and_shards(spark, odd, monkeypatch):
    """Many blocks that each ask many shards, in the order of their hashes; equal texts stand in several blocks."""
    pieces = sentencepieces.Pieces()
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()] * 3
    for name, n in (("BLOCK", 3000), ("SLICE", 1000), ("SHARD", 64)):
        monkeypatch.setattr(sentencepieces, name, n, raising=False)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sentencepieces.encode_documents(docs, pieces, broadcast_units=0)
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr((i, plain_ids(pieces, t or ""))) for i, t in rows)
    few = sentencepieces.encode_documents(docs, pieces, broadcast_units=0, digest=True).collect()
    many = sentencepieces.encode_documents(docs, pieces, digest=True).collect()
    assert sorted(map(repr, few)) == sorted(map(repr, many)) and len(few) == len(rows)


def test_units_that_share_a_hash(monkeypatch):
    """Units of one hash are told apart by their bytes; a unit that nobody has encoded is an error."""
    import pyarrow as pa

    pieces, real = sentencepieces.Pieces(), sentencepieces.word_hashes
    monkeypatch.setattr(sentencepieces, "word_hashes", lambda *a, **b: real(*a, **b) & np.uint64(0xE000000000000007))
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(60)) + " tail" for _ in range(5)] + ["", "tail tail"]
    units = sorted({u for t in texts if t for u in re.findall(sentencepieces._UNIT, " " + t)})
    ids = pa.array([plain_ids(pieces, u[1:]) if u[0] == " " else uncut_ids(pieces, u) for u in units], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    parts = pa.chunked_array([pa.array([sentencepieces._pressed(batch.slice(0, 3)), sentencepieces._pressed(batch.slice(3))])])
    asked = sentencepieces._asked(parts)
    where = lambda h: sentencepieces._shard(h, 5)
    hashes = np.array([sentencepieces.word_hashes(np.frombuffer(u.encode(), np.uint8), np.array([0]), np.array([len(u.encode())]), lower=False)[0] for u in units])
    assert len(asked) < len(units) / 2
    replies = []
    for s in np.unique(where(asked)):
        own = np.flatnonzero(where(hashes) == s)
        shard = sentencepieces.Shard([(pa.array([units[k] for k in own[x]]), ids.take(pa.array(own[x]))) for x in (slice(0, 3), slice(3, None))], np.uint16)
        replies.append(pa.scalar(shard.reply(asked[where(asked) == s]), pa.binary()))
    got = pa.Table.from_batches(sentencepieces._encode_block(parts, replies, pieces, False, np.uint16)).to_pylist()
    assert [r["ids"] for r in got] == [plain_ids(pieces, t) for t in texts]
    with pytest.raises(RuntimeError):
        shard.reply(np.array([12345], np.uint64))


def test_bytes_that_cost_less_than_a_piece(spark):
    """A piece of one code point below the bytes' cost is spelled; one at the same cost is taken."""
    pieces = sentencepieces.Pieces()
    known = {p: i for i, p in pieces.text.items()}
    pieces.score[known["q"]], pieces.score[known["z"]] = pieces.byte_cost - 1, pieces.byte_cost
    text = "qz zq\u2581q z\u0e01"
    (got,) = sentencepieces.encode_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), pieces).collect()
    assert list(got.ids) == plain_ids(pieces, text)
    assert pieces.byte_ids[ord("q")] in got.ids and known["z"] in got.ids


def test_piece_digests_of_the_query(spark, odd, tmp_path):
    import hashlib

    sha = lambda x: hashlib.sha256(x).hexdigest()
    pieces = sentencepieces.Pieces()
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    out = sentencepieces.op9(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for i, t in rows:
        ids = plain_ids(pieces, t or "")
        want.append((i, len(ids), sha(np.array(ids, "<i4").tobytes()), sha((t or "").encode())))
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))


def test_pipeline_against_a_plain_version(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "sentencepiece"]
    stages, now = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        stages[name] = {r.doc_id: r.text for r in now.collect()}
    assert set(own) - set(stages["language_id"]) == {i for i, t in own.items() if not any(c.isalpha() for c in t)}
    cut = plain_lines(list(stages["language_id"].items()))
    want = {i: cut(i, t) for i, t in stages["language_id"].items()}
    assert stages["line_dedup"] == {i: t for i, t in want.items() if t}
    groups = plain_components(list(stages["line_dedup"].items()))
    assert set(stages["ngram_jaccard_join"]) == {i for i in stages["line_dedup"] if groups[(True, i)][1] == i}
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(stages["benchmark_decontamination"]) == {
        i for i, t in stages["ngram_jaccard_join"].items() if not any(100 * len(s & shingles(t)) >= 80 * len(s) for s in items)}
    pieces = sentencepieces.Pieces()
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(stages["benchmark_decontamination"])
    for i in sorted(got)[::17]:
        assert got[i] == plain_ids(pieces, stages["benchmark_decontamination"][i])


def test_pipeline_odd(spark, odd, tmp_path):
    """Odd rows pass every stage without a crash, further columns stay, repeated ids become one document."""
    own = odd.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    now = own
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == own.columns
    ids = [r.doc_id for r in now.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and corpus_pipeline.STAGES[-1][1](spark, now, SF).count() == len(ids)


def test_one_row_of_each_group(spark):
    """Rows that share an id or have none are documents of their own; equal rows are one; further columns stay."""
    rows = shared_id_rows()
    root = row_components(rows)
    rank = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    want = {min((rows[k] for k in range(len(rows)) if root[k] == g), key=rank) for g in root}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("r")).withColumn("cls", F.lit("c")).repartition(3)
    out = corpus_pipeline.one_of_each_group(spark, docs, SF)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_pipeline_empty(spark):
    now = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    assert now.count() == 0
