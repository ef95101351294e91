"""Line dedup by overlapping three-line windows (DataFrame functions only).

Every three consecutive lines of a text form a window with a 128-bit hash. A window that occurs more than once
anywhere keeps its first occurrence (smallest doc_id, then text hash, then line); each later occurrence covers its three
lines; covered positions are merged and those lines go.

Defined cases: null text reads as empty; a text of fewer than three lines has no window and stays as it is;
a window of three blank lines counts for nothing; rows equal in doc_id and text are one document (their equal positions
are one occurrence, and all of them get its marks), rows that only share a doc_id, or have none, are documents of their
own; a null doc_id sorts first; an empty table gives an empty result; further columns pass through untouched.

Scale: windows shuffle as (hash, hash, doc_id, text hash, line) rows, marks return by (doc_id, text hash), so that many
rows without an id spread over the cluster; counts combine map-side, so a window that a third of
all documents share is one row per task; the join back is a plain shuffled join that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _text_hash(text: Column) -> Column:
    """Tells rows of one doc_id apart; beside the id, 64 bits are plenty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, line, h1, h2): every window that has a non-blank line."""
    rows = docs.select(F.col(id_col).alias("doc_id"), _text_hash(F.col(text_col)).alias("text_hash"),
                       _lines(F.col(text_col)).alias("lines")).where(F.size("lines") >= WINDOW)

    def window(i: Column) -> Column:
        three = [F.get("lines", i + F.lit(j)) for j in range(WINDOW)]
        full = F.lit(False)
        for x in three:
            full = full | (F.trim(F.translate(x, "\r\t", "  ")) != "")
        return F.struct(i.alias("line"), F.xxhash64(*three).alias("h1"), F.xxhash64(F.lit("second"), *three).alias("h2"), full.alias("full"))

    each = rows.select("doc_id", "text_hash", F.explode(F.transform(F.sequence(F.lit(0), F.size("lines") - WINDOW), window)).alias("w"))
    return each.where("w.full").select("doc_id", "text_hash", "w.line", "w.h1", "w.h2")


def later_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, starts): ascending first lines of the windows that occurred before."""
    w = windows(docs, id_col, text_col)
    first = (w.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_hash", "line")).alias("f"), F.count("*").alias("n"))
             .where("n > 1").select("h1", "h2", F.col("f.doc_id").alias("d0"), F.col("f.text_hash").alias("t0"), F.col("f.line").alias("l0")))
    late = w.join(first, ["h1", "h2"]).where(~(F.col("doc_id").eqNullSafe(F.col("d0")) & (F.col("text_hash") == F.col("t0")) & (F.col("line") == F.col("l0"))))
    return late.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line")).alias("starts"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines``, ``n_removed`` (appended, or replaced where ``docs`` has such a column)."""
    # own columns travel in one struct, so that none of them can clash with a name used here
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), _text_hash(F.col(text_col)).alias("th"),
                      _lines(F.col(text_col)).alias("lines"))
    late = later_windows(docs, id_col, text_col).select(F.col("doc_id").alias("late_id"), F.col("text_hash").alias("late_th"), "starts")
    lines, marks = F.col("lines"), F.col("marks")
    marked = own.join(late, F.col("id").eqNullSafe(F.col("late_id")) & (F.col("th") == F.col("late_th")), "left").withColumn("marks", F.concat(
        F.array(F.lit(-WINDOW)), F.coalesce("starts", F.expr("cast(array() as array<int>)")), F.array(F.size(lines))))
    # the kept runs lie between one covered window's end and the next one's start
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(marks) - 2), lambda j: F.slice(
        lines, F.get(marks, j) + F.lit(WINDOW + 1), F.greatest(F.lit(0), F.get(marks, j + 1) - F.get(marks, j) - F.lit(WINDOW)))))
    out = marked.withColumn("kept", kept)
    new = {"kept_text": F.concat_ws("\n", "kept"), "n_lines": F.size("lines").cast("long"), "n_removed": (F.size("lines") - F.size("kept")).cast("long")}
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in new], *[x.alias(c) for c, x in new.items()])


def op3(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = """
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT doc_id, i, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS k
      FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM t WHERE len(l) >= 3)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM w
      WHERE trim(translate(k, chr(10) || chr(13) || chr(9), '   ')) <> ''),
c AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM r WHERE nth > 1),
p AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM t)
SELECT p.doc_id, count(*) AS n_lines, count(c.i) AS n_removed,
       sha256(coalesce(string_agg(p.line, chr(10) ORDER BY p.i) FILTER (WHERE c.i IS NULL), '')) AS kept_sha256
FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY p.doc_id
"""
