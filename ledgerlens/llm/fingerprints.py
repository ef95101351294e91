"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests (DataFrame functions only).

A paragraph is a line of the text; its digest a 64-bit hash; a text's set holds its distinct digests. The sketch
has ``TABLES`` tables of ``CELLS`` cells; each digest goes into one cell of each table (count, xor of digests, xor
of check hashes). Subtracting two sketches leaves only digests that one side has; peeling cells that hold a single
digest recovers them. If peeling gets stuck, larger sketches are made of both texts, a section of the digest range
each, and only sections that are stuck again are cut further, with other cells each time (``TIERS`` times; what is
left then, about one pair in 10**9, is compared digest by digest). From the recovered number d of differing
digests and the set sizes a, b: likeness = (a + b - d) / (a + b + d), the Jaccard similarity of the sets.

Defined cases: null text reads as empty (one empty paragraph); equal texts have equal fingerprints; repeated rows
and ties in the id are ordered by text, so each is the other's next document; a null id comes first; a single
document is its own next one; an empty table gives an empty result; further columns are never read.

Scale: texts shuffle once, to buckets of neighbouring ids (as many as twice the shuffle partitions, cut at
approximate quantiles). Each bucket also gets the first document after it, so no window spans the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.sparkops import partitions

TABLES, CELLS, TIERS = 3, 8, 4
#: expected differing digests in a section of the first larger sketch, and how much finer each further one is
SECTION, FINER = 6, 8
_ROUNDS = 12
_LEAST_ID = -(1 << 63)


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def digests(text: Column) -> Column:
    """The distinct paragraph digests of a text, ascending."""
    return F.sort_array(F.array_distinct(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.xxhash64(x))))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check")).bitwiseAND(_long(0xFFFFFFFF))


def _elements(keys: Column) -> Column:
    """Digest, check hash and cell positions (three bits per table and tier)."""
    return F.transform(keys, lambda k: F.struct(k.alias("k"), _check(k).alias("c"), F.xxhash64(k, F.lit("cells")).alias("p")))


def _cell_of(places: Column, cell: Column, tier: int) -> Column:
    """Does an element with these positions lie in this cell?"""
    table = F.floor(cell / F.lit(CELLS)).cast("int")
    bits = F.call_function("shiftrightunsigned", places, table * F.lit(3) + F.lit(9 * tier))
    return bits.bitwiseAND(_long(CELLS - 1)) == (cell % F.lit(CELLS))


def _cell(n: Column, k: Column, c: Column) -> Column:
    return F.struct(n.alias("n"), k.alias("k"), c.alias("c"))


def sketch(elements: Column, tier: int = 0) -> Column:
    """array<struct<n, k, c>>: the cells of an array of elements."""
    return F.transform(F.sequence(F.lit(0), F.lit(TABLES * CELLS - 1)), lambda cell: F.aggregate(
        F.filter(elements, lambda e: _cell_of(e["p"], cell, tier)), _cell(_long(0), _long(0), _long(0)),
        lambda a, e: _cell(a["n"] + _long(1), a["k"].bitwiseXOR(e["k"]), a["c"].bitwiseXOR(e["c"]))))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["c"].bitwiseXOR(y["c"])))


def peel(cells: Column, tier: int = 0) -> Column:
    """array<struct<n, k, c, p>>: the digests that only one side has (n: 1 or -1), null if peeling got stuck."""
    empty = F.expr("cast(array() as array<struct<n:bigint,k:bigint,c:bigint,p:bigint>>)")

    def single(cells: Column) -> Column:
        pure = F.filter(cells, lambda x: (F.abs(x["n"]) == 1) & (_check(x["k"]) == x["c"]))
        return F.array_distinct(F.transform(pure, lambda x: F.struct(
            x["n"].alias("n"), x["k"].alias("k"), x["c"].alias("c"), F.xxhash64(x["k"], F.lit("cells")).alias("p"))))

    def without(state: Column, out: Column) -> Column:
        cells = F.transform(state["cells"], lambda cell, i: F.aggregate(
            F.filter(out, lambda e: _cell_of(e["p"], i, tier)), cell,
            lambda a, e: _cell(a["n"] - e["n"], a["k"].bitwiseXOR(e["k"]), a["c"].bitwiseXOR(e["c"]))))
        return F.struct(cells.alias("cells"), F.concat(state["got"], out).alias("got"))

    def step(state: Column, _: Column) -> Column:
        # the one-element array binds the peeled digests once
        nxt = F.transform(F.array(single(state["cells"])), lambda out: F.when(F.size(out) == 0, state).otherwise(without(state, out)))
        return F.get(nxt, F.lit(0))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), F.struct(cells.alias("cells"), empty.alias("got")), step)
    clean = lambda s: ~F.exists(s["cells"], lambda x: (x["n"] != 0) | (x["k"] != 0) | (x["c"] != 0))
    return F.get(F.transform(F.array(end), lambda s: F.when(clean(s), s["got"])), F.lit(0))


def _section(key: Column, sections: Column) -> Column:
    """Which of ``sections`` equal parts of the digest range a digest lies in (ascending with the digest)."""
    top = F.shiftright(key, 32) + _long(1 << 31)
    return F.shiftright(top * sections, 32)


def _below(elements: Column, section: Column, sections: Column) -> Column:
    """How many elements (ascending) lie in lower sections: a binary search."""
    def step(at: Column, j: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1), j)
        more = at + width
        last = F.get(elements, more - F.lit(1))
        return F.when((more <= F.size(elements)) & (_section(last["k"], sections) < section), more).otherwise(at)

    return F.aggregate(F.sequence(F.ceil(F.log2(F.size(elements) + F.lit(1))).cast("int"), F.lit(0)), F.lit(0), step)


def _part(elements: Column, section: Column, sections: Column) -> Column:
    low, high = _below(elements, section, sections), _below(elements, section + _long(1), sections)
    return F.get(F.transform(F.array(F.struct(low.alias("a"), high.alias("b"))), lambda s: F.slice(elements, s["a"] + F.lit(1), s["b"] - s["a"])), F.lit(0))


def likeness(df: DataFrame, a: str, b: str, cells_a: str, cells_b: str, out: str) -> DataFrame:
    """Adds ``out``: the likeness of two texts by their element arrays (columns a, b) and base sketches."""
    number = lambda got: F.coalesce(F.size(got), F.lit(-1))
    first = number(peel(subtract(F.col(cells_a), F.col(cells_b))))
    df = df.withColumn("_got", first).withColumn("_stuck", F.when(F.col("_got") >= 0, F.expr("cast(array() as array<bigint>)")).otherwise(
        F.sequence(_long(0), F.ceil((F.size(a) + F.size(b)) / SECTION) - 1)))
    df = df.withColumn("_sections", F.ceil((F.size(a) + F.size(b)) / SECTION)).withColumn("_d", F.greatest(F.col("_got"), F.lit(0)).cast("long"))

    def differing(tier: int) -> Column:
        part = lambda side, s: _part(F.col(side), s, F.col("_sections"))
        return F.transform("_stuck", lambda s: F.struct(s.alias("s"), number(peel(subtract(
            sketch(part(a, s), tier), sketch(part(b, s), tier)), tier)).alias("n")))

    for tier in range(1, TIERS + 1):
        df = df.withColumn("_found", differing(tier))
        left = F.transform(F.filter("_found", lambda x: x["n"] < 0), lambda x: x["s"])
        df = (df.withColumn("_d", F.col("_d") + F.aggregate("_found", _long(0), lambda t, x: t + F.greatest(x["n"], F.lit(0))))
              .withColumn("_stuck", left if tier == TIERS else F.flatten(F.transform(left, lambda s: F.sequence(s * _long(FINER), s * _long(FINER) + _long(FINER - 1)))))
              .withColumn("_sections", F.col("_sections") * (1 if tier == TIERS else FINER)))
    keys = lambda side, s: F.transform(_part(F.col(side), s, F.col("_sections")), lambda e: e["k"])
    rest = F.aggregate(F.transform("_stuck", lambda s: (F.size(F.array_except(keys(a, s), keys(b, s))) + F.size(F.array_except(keys(b, s), keys(a, s)))).cast("long")),
                       _long(0), lambda t, x: t + x)
    total = F.size(a) + F.size(b)
    return (df.withColumn("_d", F.col("_d") + rest).withColumn(out, (total - F.col("_d")) / (total + F.col("_d")))
            .drop("_got", "_stuck", "_sections", "_d", "_found"))


def fingerprint(cells: Column) -> Column:
    """The sketch as text: per cell the count, the xor of digests and the xor of checks, in hex."""
    return F.array_join(F.transform(cells, lambda x: F.concat(
        F.lpad(F.lower(F.hex(x["n"])), 4, "0"), F.lpad(F.lower(F.hex(x["k"])), 16, "0"), F.lpad(F.lower(F.hex(x["c"])), 8, "0"))), "")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, next_text): each document with the text of the next one by ascending id (the last: the first)."""
    spark = docs.sparkSession
    n = 2 * partitions(spark)
    key = F.coalesce(F.col(id_col).cast("long"), _long(_LEAST_ID))
    own = docs.select(key.alias("key"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = own.agg(F.percentile_approx("key", [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0] or []
    cuts = sorted(set(cuts))
    bounds = F.array(*[_long(c) for c in cuts]) if cuts else F.expr("cast(array() as array<bigint>)")
    steps = F.sequence(F.lit(len(cuts).bit_length()), F.lit(0))

    def step(at: Column, j: Column) -> Column:
        more = at + F.call_function("shiftleft", F.lit(1), j)
        return F.when((more <= F.lit(len(cuts))) & (F.get(bounds, more - F.lit(1)) < F.col("key")), more).otherwise(at)

    own = own.withColumn("bucket", F.aggregate(steps, F.lit(0), step))
    heads = sorted(own.groupBy("bucket").agg(F.min("key")).collect())   # a row per bucket
    if not heads:
        return own.select("doc_id", "text", F.col("text").alias("next_text"))
    before = [(heads[i][1], heads[i - 1][0], i == 0) for i in range(len(heads))]
    ends = F.broadcast(spark.createDataFrame(before, "key long, to_bucket int, wraps boolean"))
    lead_in = own.join(ends, "key").select(F.col("to_bucket").alias("bucket"), "wraps", F.lit(True).alias("guest"), "key", "doc_id", "text")
    everyone = own.select("bucket", F.lit(False).alias("wraps"), F.lit(False).alias("guest"), "key", "doc_id", "text").unionByName(lead_in)
    order = Window.partitionBy("bucket").orderBy("wraps", "key", "text")
    return everyone.withColumn("next_text", F.lead("text").over(order)).where(~F.col("guest")).select("doc_id", "text", "next_text")


def compare_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, edited, next_text, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last half replaced by the beginning of the next document.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    df = with_next(docs, id_col, text_col).withColumn("edited", F.concat(
        F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    for name, side in (("own", "text"), ("new", "edited"), ("nxt", "next_text")):
        df = df.withColumn(f"_{name}", _elements(digests(F.col(side))))
        df = df.withColumn(f"_{name}_cells", sketch(F.col(f"_{name}")))
    df = likeness(df, "_own", "_new", "_own_cells", "_new_cells", "near_edited")
    df = likeness(df, "_own", "_nxt", "_own_cells", "_nxt_cells", "near_next")
    return df.select("doc_id", "text", "edited", "next_text", fingerprint(F.col("_own_cells")).alias("fingerprint"),
                     fingerprint(F.col("_new_cells")).alias("edited_fingerprint"), "near_edited", "near_next")


def op4(spark, sf_dir: str) -> DataFrame:
    out = compare_versions(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                      "fingerprint", "edited_fingerprint", "near_edited", "near_next")
