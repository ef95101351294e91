"""SentencePiece encoding and decoding as a relational lattice.

A text gets one space in front; its *units* are runs of spaces with the word after them, cut between letters and
ASCII signs or digits, single line feeds, and runs of spaces before one; no piece of the table may cross a unit
(checked), so units are encoded one by one, each distinct unit once:

1. the distinct units of all documents;
2. explode the substrings of up to the longest piece's length, and equi-join them (by hash, then compared) to the
   piece table (its size is that of the model file): the lattice's edges;
3. group the edges by unit, in tasks of ``PART`` code points; 4. fold Viterbi over the edges with Spark's higher-order
   ``aggregate``.

The segmentation has the highest sum of piece scores; ties go to the shorter last piece, then the larger id. A
code point that no piece covers becomes its UTF-8 byte pieces at a fixed cost. For a model that was trained by
merges this is the best segmentation under its scores, which may differ from replaying the merges. No unit is
cut: units longer than ``LATTICE`` code points (text without spaces) are folded the same way, with the same sums and
ties, by a scan that is linear in their length (``long_paths``) instead of the relational lattice, whose rows would
each carry the whole unit. Decoding joins the pieces' bytes and drops the first space; it restores every text exactly
(the model's own space mark is byte-encoded when it occurs in a text).

``encode_documents`` hands the encoded units back to the documents: as a broadcast dictionary while their number,
which is counted first, is within ``BROADCAST_UNITS``. Beyond it blocks of documents ask for their distinct units:
the compressed texts move once, a request is the 64-bit hash of a unit in a block and the reply its ids (``_encode_by_blocks``).

Defined cases: null and empty texts have no pieces; repeated rows and null ids each give their row; an empty table
gives an empty result; further columns are never read, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import re
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.sparkops import drop_settled, settle
from ledgerlens.llm.textops import U, text_slices, word_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: the longest unit that is encoded as a whole: there is no bound
LONGEST = sys.maxsize
#: units up to this length meet the piece table in the lattice, longer ones in ``long_paths``; the ids are the same
LATTICE = 256
#: code points of units whose lattices are built in one task (some 250 bytes of edges each), so that none is spilled
PART = 1 << 17
#: units in a broadcast dictionary (some 20 bytes each)
BROADCAST_UNITS = 1 << 23
#: beyond it: bytes of text that ask for their units together (no more than a task reads), units that meet the requests in a group
BLOCK, SHARD = 1 << 26, 1 << 18
#: letters (ASCII and Latin up to U+024F) and ASCII signs and digits: a unit is cut where one follows the other
_LETTER, _SIGN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!-@\[-`{-~"
#: one reluctant run up to a border: Java repeats a character class in a loop, but a group by recursion per character
_UNIT = rf" *[^ \n]+?(?:(?<=[{_LETTER}])(?=[{_SIGN}])|(?<=[{_SIGN}])(?=[{_LETTER}])|(?![^ \n]))| +|\n"
SLICE = 1 << 21


class Pieces:
    """A piece table read from a model file on the driver."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.byte_ids = [0] * 256
        self.text: dict[int, str] = {}
        self.score: dict[int, float] = {}
        for i in ids:
            if model.is_byte(i):
                self.byte_ids[int(model.id_to_piece(i)[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.text[i] = model.id_to_piece(i).replace(MARK, " ")
                self.score[i] = model.get_score(i)
        crossing = [p for p in self.text.values() if re.findall(_UNIT, p) != [p]]
        if crossing:
            raise ValueError(f"pieces cross units: {crossing[:5]}")
        self.longest = max(map(len, self.text.values()), default=1)
        self.byte_cost = min((s for s in self.score.values() if s > -1e8), default=0.0) - 10.0
        self.bytes = np.empty(len(ids), object)
        self.bytes[:] = b""
        for i, p in self.text.items():
            self.bytes[i] = p.encode()
        for b, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes([b])

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, score)."""
        rows = [(p, i, self.score[i]) for i, p in self.text.items()]
        return spark.createDataFrame(rows, "piece string, id int, score double")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.bytes[ids].tolist())


def coarse_units(text: Column) -> Column:
    """Runs of spaces with what follows up to the next space, line feeds, runs of spaces before one, in order."""
    parts = F.regexp_extract_all(F.concat(F.lit(" "), text), F.lit(r"( *[^ \n]+| +|\n)"), F.lit(1))
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, parts).otherwise(F.expr("cast(array() as array<string>)"))


def fine_units(coarse: Column) -> Column:
    """The units of one coarse unit."""
    return F.regexp_extract_all(coarse, F.lit(f"({_UNIT})"), F.lit(1))


def units(text: Column) -> Column:
    """The units of a text, in order."""
    return F.flatten(F.transform(coarse_units(text), fine_units))


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, edges array<struct<e, s, id, score>>): all pieces in each unit, from position s to e, in this order.

    Pieces are met by a 64-bit hash and compared. Every position has the edge of one code point: its bytes (id -1) where no
    piece covers it or the bytes cost less.
    """
    ends = words.select("unit", F.explode(F.sequence(F.lit(1), F.length("unit"))).alias("e"))
    subs = (ends.select("unit", "e", F.explode(F.sequence(F.least(F.lit(pieces.longest), F.col("e")), F.lit(1), F.lit(-1))).alias("n"))
            .withColumn("s", F.col("e") - F.col("n")).withColumn("part", F.col("unit").substr(F.col("s") + 1, F.col("n"))).withColumn("hash", F.xxhash64("part")))
    table = pieces.table(words.sparkSession).withColumn("hash", F.xxhash64("piece"))
    met = subs.join(F.broadcast(table), "hash", "left").withColumn("id", F.when(F.col("part").eqNullSafe(F.col("piece")), F.col("id"))).where("n = 1 or id is not null")
    spelled = F.col("id").isNull() | ((F.col("n") == 1) & (F.col("score") < pieces.byte_cost))
    return met.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct(
        "e", "s", F.when(spelled, -1).otherwise(F.col("id")).alias("id"), F.when(spelled, pieces.byte_cost).otherwise(F.col("score")).alias("score")))).alias("edges"))


def best_paths(edges: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, ids): the best segmentations, by a fold over the edges and the walk back."""
    unit, best = F.col("unit"), F.col("best")

    def forward(done: Column, x: Column) -> Column:
        """``done`` holds the best score of every position up to the last edge's end."""
        score = F.get(done, x["s"]) + x["score"]
        better = F.concat(F.slice(done, F.lit(1), x["e"]), F.array(score))
        return F.when((x["e"] >= F.size(done)) | (score > F.get(done, x["e"])), better).otherwise(done)

    scored = edges.select("unit", "edges", F.aggregate("edges", F.array(F.lit(0.0)), forward).alias("best"))
    to_ids = F.array(*[F.lit(i) for i in pieces.byte_ids])
    hexes = lambda s: F.hex(F.encode(unit.substr(s + F.lit(1), F.lit(1)), "UTF-8"))
    spelled = lambda s: F.transform(F.sequence(F.lit(0), F.floor(F.length(hexes(s)) / 2).cast("int") - F.lit(1)), lambda k: F.get(
        to_ids, F.conv(F.substring(hexes(s), k * F.lit(2) + F.lit(1), F.lit(2)), 16, 10).cast("int")))

    def back(state: Column, x: Column) -> Column:
        """Of the edges that give a position its best score, the one that comes last: shorter, then larger id."""
        taken = (x["e"] == state["at"]) & (F.get(best, x["s"]) + x["score"] == F.get(best, x["e"]))
        ids = F.when(x["id"] >= 0, F.array(x["id"])).otherwise(spelled(x["s"]))
        return F.when(taken, F.struct(x["s"].alias("at"), F.concat(ids, state["ids"]).alias("ids"))).otherwise(state)

    start = F.struct(F.length(unit).alias("at"), F.expr("cast(array() as array<int>)").alias("ids"))
    return scored.select("unit", F.aggregate(F.reverse("edges"), start, back, lambda state: state["ids"]).alias("ids"))


def long_path(unit: str, pieces: Pieces, known: dict[str, int]) -> np.ndarray:
    """``best_path`` of one unit of any length: only the last ``longest`` nodes reach a position."""
    n = len(unit)
    score, back, by = np.zeros(n + 1), np.zeros(n + 1, np.int64), np.full(n + 1, -1, np.int32)
    near = [0.0]   # scores of the last positions, this one's predecessor last
    for e in range(1, n + 1):
        best = (near[-1] + pieces.byte_cost, e - 1, -1)
        for k in range(1, len(near) + 1):
            i = known.get(unit[e - k: e])
            if i is not None:
                best = max(best, (near[-k] + pieces.score[i], e - k, i))
        score[e], back[e], by[e] = best
        near.append(best[0])
        if len(near) > pieces.longest:
            del near[0]
    ids, e = [], n
    while e:
        s, i = int(back[e]), int(by[e])
        ids += [i] if i >= 0 else [pieces.byte_ids[b] for b in reversed(unit[s:e].encode())]
        e = s
    return np.array(ids[::-1], np.int32)


def long_paths(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, ids) of long units."""
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for b in batches:
            known = known or {p: i for i, p in shared.value.text.items()}
            for u in b.column(0):
                ids = pa.array([long_path(u.as_py(), shared.value, known)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([u.as_py()], pa.string()), ids], names=["unit", "ids"])

    return words.select("unit").mapInArrow(scan, "unit string, ids array<int>")


def encode_units(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, ids) for distinct, non-empty units."""
    words = settle(words, free=True)
    short, long = words.where(F.length("unit") <= LATTICE), words.where(F.length("unit") > LATTICE)
    parts = -(-(short.agg(F.sum(F.length("unit"))).first()[0] or 1) // PART)
    # the grouping of the edges keeps this partitioning
    done = settle(best_paths(lattice(short.repartition(parts, "unit"), pieces), pieces), free=True)
    done = done.unionByName(settle(long_paths(long, pieces)))
    drop_settled(words)
    return done


def lexicon(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, ids) of all units of ``docs`` (column text); the finer cut is only made once per coarse unit."""
    coarse = docs.select(F.explode(F.array_distinct(coarse_units(F.col("text")))).alias("coarse")).distinct()
    return encode_units(coarse.select(F.explode(fine_units(F.col("coarse"))).alias("unit")).distinct(), pieces)


_CLASS = np.zeros(256, np.uint8)   # 1 letter, 2 sign or digit, by byte
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[[*range(33, 65), *range(91, 97), *range(123, 127)]] = 2


def _unit_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the units of texts that begin with their space; the same cuts as ``units``."""
    feed, space = data == 10, data == 32
    kind = _CLASS[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC9))   # two-byte letters, but for the two signs among them
    tail = data[lead + 1]
    lead = lead[~((data[lead] == 0xC3) & ((tail == 0x97) | (tail == 0xB7))) & ~((data[lead] == 0xC9) & (tail > 0x8F))]
    kind[lead] = kind[lead + 1] = 1
    start = feed.copy()
    start[1:] |= feed[:-1] | (space[1:] & ~space[:-1]) | (kind[1:] * kind[:-1] == 2)
    start[offs[:-1][offs[:-1] < len(data)]] = True
    at = np.flatnonzero(start)
    end = np.r_[at[1:], len(data)][: len(at)]
    return at, end


def _unit_slices(texts) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets of the rows in them, starts, ends and hashes of their units) for runs of whole texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
    for i, j, data, offs in text_slices(texts, SLICE):
        at, end = _unit_bounds(data, offs)
        yield i, j, data, offs, at, end, word_hashes(data, at, end, lower=False)


def _places(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where each hash is among the known ones; each distinct one is looked up once."""
    some, which = np.unique(h, return_inverse=True)
    return np.searchsorted(known, some)[which]


def _ids_of(k: np.ndarray, begin: np.ndarray, count: np.ndarray, flat: np.ndarray, at: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the units ``k`` one after the other, and where each text's begin."""
    n = count[k].astype(np.int64)
    place = np.repeat(begin[k] - (np.cumsum(n) - n), n)
    return flat[place + np.arange(len(place))], np.r_[0, np.cumsum(n)][np.searchsorted(at, offs)]


def _dictionary(words: DataFrame, n_pieces: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit hashes ascending, where their ids begin, how many, ids: packed by tasks, fetched partition by partition."""
    small = np.uint16 if n_pieces <= 1 << 16 else np.int32

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(1)
            for i, j, data, offs in text_slices(b.column(0), 1 << 40):
                h = word_hashes(data, offs[:-1], offs[1:], lower=False)
                part = ids.slice(i, j - i)
                n = pc.list_value_length(part).to_numpy().astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (h, n, part.flatten().to_numpy().astype(small))], names=["h", "n", "ids"])

    parts = [tuple(r) for r in words.select("unit", "ids").mapInArrow(pack, "h binary, n binary, ids binary").toLocalIterator()]
    h, n, ids = (np.concatenate([np.frombuffer(p[k], t) for p in parts] or [np.zeros(0, t)]) for k, t in enumerate((U, np.uint32, small)))
    del parts
    o = np.argsort(h)
    return h[o], (np.cumsum(n, dtype=np.int64) - n)[o], n[o], ids


def encode_documents(docs: DataFrame, pieces: Pieces | None = None, id_col: str = "doc_id", text_col: str = "text",
                     broadcast_units: int = BROADCAST_UNITS, digest: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) per row of ``docs``.

    ``digest``: (doc_id, n_tokens, ids_sha256, decoded_sha256) instead, of the ids as little-endian 32-bit
    integers and of the text that they decode to.
    """
    pieces = pieces or Pieces()
    kind = dict(docs.dtypes)[id_col]
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"doc_id {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>")
    words = lexicon(own, pieces)
    n_units = words.count()
    if n_units > broadcast_units:
        return _encode_by_blocks(own, words, n_units, pieces, schema, digest)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((_dictionary(words, len(pieces.bytes)), pieces))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, begin, count, flat), p = shared.value
        for b in batches:
            for i, j, _, offs, at, _, h in _unit_slices(b.column(1)):
                ids, bounds = _ids_of(_places(known, h), begin, count, flat, at, offs)
                yield from _rows(b.column(0).slice(i, j - i), ids, bounds, p, digest)

    return own.mapInArrow(scan, schema)


def _rows(doc_ids, ids: np.ndarray, bounds: np.ndarray, pieces: Pieces, digest: bool) -> Iterator[pa.RecordBatch]:
    if not digest:
        yield pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])
        return
    sha = lambda x: hashlib.sha256(x).hexdigest()
    parts = [ids[a:b].astype("<i4") for a, b in zip(bounds[:-1], bounds[1:])]
    yield pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(bounds), pa.int64()), pa.array([sha(x.tobytes()) for x in parts], pa.string()),
                                      pa.array([sha(pieces.decode(x)[1:]) for x in parts], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _pressed(b: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
        w.write_batch(b)
    return sink.getvalue().to_pybytes()


def _opened(cell: pa.BinaryScalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(cell.as_buffer()).read_next_batch()


def _asked(parts: pa.ChunkedArray) -> np.ndarray:
    """The distinct hashes of the units of a block, ascending."""
    some = [np.unique(h) for x in parts for *_, h in _unit_slices(_opened(x).column(1))]
    return np.unique(np.concatenate(some or [np.zeros(0, U)]))


def _sum(h: np.ndarray) -> bytes:
    return np.bitwise_xor.reduce(h, initial=U(0)).tobytes()


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    """The group of each hash: ranges of hashes, in their order."""
    return ((h >> U(32)) * U(shards) >> U(32)).astype(np.int64)


class Shard:
    """The units of one range of hashes, from chunks of (units, ids)."""

    def __init__(self, chunks: list[tuple[pa.Array, pa.Array]], small: type):
        units = pa.concat_arrays([u.cast(pa.large_string()) for u, _ in chunks] or [pa.array([], pa.large_string())])
        ids = pa.concat_arrays([x for _, x in chunks] or [pa.array([], pa.list_(pa.int32()))])
        h = np.concatenate([word_hashes(data, offs[:-1], offs[1:], lower=False) for _, _, data, offs in text_slices(units, 1 << 40)] or [np.zeros(0, U)])
        n = pc.list_value_length(ids).to_numpy().astype(np.uint32)
        o = np.argsort(h)
        self.flat, self.begin = ids.flatten().to_numpy().astype(small), (np.cumsum(n, dtype=np.int64) - n)[o]
        self.hash, self.count = h[o], n[o]
        same = np.r_[False, self.hash[1:] == self.hash[:-1]]
        self.shared: dict[int, dict[bytes, np.ndarray]] = {}   # units that share a hash, told apart by their bytes
        for k in np.flatnonzero(same | np.r_[same[1:], False]):
            self.shared.setdefault(int(self.hash[k]), {})[units[int(o[k])].as_py().encode()] = self.flat[self.begin[k]: self.begin[k] + n[o[k]]]

    def reply(self, asked: np.ndarray) -> bytes:
        """How many ids each asked unit has (0: it shares its hash), the ids, and the units that share one with their ids."""
        k = np.minimum(np.searchsorted(self.hash, asked), len(self.hash) - 1)
        if not len(self.hash) or (self.hash[k] != asked).any():
            raise RuntimeError("a unit of the documents is not among the encoded ones")
        shared = [x for x in self.shared if x in asked]
        n = np.where(np.isin(asked, np.array(shared, U)), 0, self.count[k]).astype(np.uint32)
        place = np.repeat(self.begin[k] - (np.cumsum(n, dtype=np.int64) - n), n)
        cells = (n.tobytes(), self.flat[place + np.arange(len(place))].tobytes(), pickle.dumps({u: ids for x in shared for u, ids in self.shared[x].items()}), _sum(asked))
        return _pressed(pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in cells], names=["n", "ids", "shared", "sum"]))


def _encode_block(parts: pa.ChunkedArray, replies: list[pa.BinaryScalar], pieces: Pieces, digest: bool, small: type) -> Iterator[pa.RecordBatch]:
    """The rows of a block, from its parts and the replies in the order of their shards."""
    known, got = _asked(parts), [_opened(x) for x in replies]
    count, flat = (np.concatenate([np.frombuffer(b.column(c)[0].as_buffer(), t) for b in got] or [np.zeros(0, t)]) for c, t in (("n", np.uint32), ("ids", small)))
    sums = np.frombuffer(b"".join(b.column("sum")[0].as_py() for b in got), U)
    if len(known) != len(count) or _sum(known) != _sum(sums):
        raise RuntimeError("the documents changed while they were encoded")
    shared = {u: ids for b in got for u, ids in pickle.loads(b.column("shared")[0].as_py()).items()}
    number = {u: len(known) + k for k, u in enumerate(shared)}
    count, flat = np.r_[count, np.array([len(x) for x in shared.values()], np.uint32)], np.concatenate([flat, *shared.values()])
    begin = np.cumsum(count, dtype=np.int64) - count
    for x in parts:
        b = _opened(x)
        for i, j, data, offs, at, end, h in _unit_slices(b.column(1)):
            k = _places(known, h)
            for p in np.flatnonzero(count[k] == 0) if shared else ():
                k[p] = number[data[at[p]: end[p]].tobytes()]
            yield from _rows(b.column(0).slice(i, j - i), *_ids_of(k, begin, count, flat, at, offs), pieces, digest)


def _encode_by_blocks(own: DataFrame, words: DataFrame, n_units: int, pieces: Pieces, schema: str, digest: bool) -> DataFrame:
    """The way without a broadcast: blocks of documents ask shards of the units for the ids of their distinct units.

    The blocks' exchange is one for requests and replies (Spark reuses it). Should a lost task make other blocks of
    the same documents, the replies do not fit and the query fails rather than return other ids.
    """
    shards, small = -(-n_units // SHARD), np.uint16 if len(pieces.bytes) <= 1 << 16 else np.int32
    shared = own.sparkSession.sparkContext.broadcast(pieces)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 33, 0
        for b in batches:
            for i, j, data, _ in text_slices(b.column(1), SLICE):
                if size and size + len(data) > BLOCK:
                    block, size = block + 1, 0
                size += len(data)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([_pressed(b.slice(i, j - i))], pa.binary())], names=["block", "part"])

    def ask(docs: pa.Table) -> pa.Table:
        h = _asked(docs["part"])
        shard = _shard(h, shards)
        own_shards, first = np.unique(shard, return_index=True)
        cells = [h[a:b].tobytes() for a, b in zip(first, np.r_[first[1:], len(h)])]
        return pa.table({"shard": pa.array(own_shards, pa.int64()), "block": pa.array([docs["block"][0].as_py()] * len(cells), pa.int64()), "asked": pa.array(cells, pa.binary())})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [word_hashes(data, offs[:-1], offs[1:], lower=False) for _, _, data, offs in text_slices(b.column(0), 1 << 40)]
            yield pa.RecordBatch.from_arrays([pa.array(_shard(np.concatenate(h or [np.zeros(0, U)]), shards)), b.column(0), b.column(1)], names=["shard", "unit", "ids"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by shard, its units (without a block) before the requests."""
        now, chunks, units = None, [], None
        for b in batches:
            shard, is_unit = b.column("shard").to_numpy(), b.column("block").is_null().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (is_unit[1:] != is_unit[:-1])]) if len(shard) else []
            for x, y in zip(cuts, [*cuts[1:], len(shard)]):
                if shard[x] != now:
                    now, chunks, units = shard[x], [], None
                if is_unit[x]:
                    chunks.append((b.column("unit").slice(x, y - x), b.column("ids").slice(x, y - x)))
                    continue
                units, chunks = units or Shard(chunks, small), []
                replies = [units.reply(np.frombuffer(c.as_buffer(), U)) for c in b.column("asked").slice(x, y - x)]
                yield pa.RecordBatch.from_arrays([b.column("block").slice(x, y - x), b.column("shard").slice(x, y - x), pa.array(replies, pa.binary())], names=["block", "shard", "reply"])

    def encode(docs: pa.Table, replies: pa.Table) -> pa.Table:
        order = np.argsort(replies["shard"].to_numpy())
        return pa.Table.from_batches(_encode_block(docs["part"], [replies["reply"][int(k)] for k in order], shared.value, digest, small))

    blocks = own.mapInArrow(pack, "block long, part binary").groupBy("block")
    asked = blocks.applyInArrow(ask, "shard long, block long, asked binary")
    meet = words.select("unit", "ids").mapInArrow(spread, "shard long, unit string, ids array<int>").unionByName(asked, allowMissingColumns=True)
    replies = meet.repartition("shard").sortWithinPartitions("shard", F.col("block").asc_nulls_first()).mapInArrow(answer, "block long, shard long, reply binary")
    return blocks.cogroup(replies.groupBy("block")).applyInArrow(encode, schema)


def decode_documents(encoded: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the pieces' bytes in order, without the space in front."""
    shared = encoded.sparkSession.sparkContext.broadcast(pieces or Pieces())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [shared.value.decode(np.array(x or [], np.int32))[1:].decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(scan, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def op9(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), digest=True)
