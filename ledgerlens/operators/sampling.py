"""Stratified sampling.

Row selection is by a seeded hash of the row key, so it is deterministic, independent of the number of partitions
and needs no driver-side sampling. "The k rows with the lowest hashes" is exact for any k without a global top-k:
rows are counted per hash bucket, the buckets below the cut-off one are kept whole and only the cut-off bucket's
rows (1/65,536 of the table) are ordered.
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import attach


def positive_mask(df: DataFrame) -> Optional[Column]:
    """M3 column choice: ground_truth_pattern <> 'none' (NULL counts as a pattern),
    else ground_truth_flag, else no positives."""
    if "ground_truth_pattern" in df.columns:
        return ~F.col("ground_truth_pattern").eqNullSafe("none")
    if "ground_truth_flag" in df.columns:
        return F.coalesce(F.col("ground_truth_flag"), F.lit(False))
    return None


_BUCKET_SHIFT = 44   # 60 hash bits, 16 of them number the bucket


def _hash(key: Column, seed: int) -> Column:
    """60 bits of an MD5 of key and seed (the same in any SQL engine)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key, F.lit(seed))), 1, 15), 16, 10).cast("bigint")


def _key_text(df: DataFrame, key: str) -> Column:
    """What a row is hashed by: its key, or all its columns where the key is null, so that such rows differ too."""
    return F.coalesce(F.col(key).cast("string"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))


def take_lowest(df: DataFrame, k: Column, key: str, seed: int) -> DataFrame:
    """The ``k`` rows with the lowest (hash, key); all rows if there are fewer. Rows without a key go by all their columns."""
    rows = df.withColumn("_by", _key_text(df, key)).withColumn("_h", _hash(F.col("_by"), seed)).withColumn("_bucket", F.shiftright("_h", _BUCKET_SHIFT))
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"))   # 65,536 rows at most
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("_bucket"))).withColumn("k", k)
    cut = upto.select(F.struct(F.coalesce(F.min(F.when(F.col("upto") >= F.col("k"), F.col("_bucket"))), F.lit(1 << 60)).alias("bucket"),
                               F.coalesce(F.max(F.when(F.col("upto") < F.col("k"), F.col("upto"))), F.lit(0)).alias("below"), F.max("k").alias("k")))
    marked = attach(rows, "_cut", cut.scalar())
    whole = marked.filter(F.col("_bucket") < F.col("_cut.bucket"))
    nth = F.row_number().over(Window.orderBy("_h", key, "_by"))
    part = marked.filter(F.col("_bucket") == F.col("_cut.bucket")).withColumn("_nth", nth) \
        .filter(F.col("_nth") <= F.col("_cut.k") - F.col("_cut.below")).drop("_nth")
    return whole.unionByName(part).drop("_by", "_h", "_bucket", "_cut")


def stratified_sample(df: DataFrame, target: int, seed: int = 42, key: str = "transaction_id",
                      shuffle: bool = False) -> DataFrame:
    """M1/M2/M3: keep every positive, fill with hash-chosen normals up to ``target``;
    too few normals -> all of them; fewer slots than positives -> hash-chosen
    positives only. ``shuffle`` (M4) orders the result by a second hash."""
    mask = positive_mask(df)
    if mask is None:
        out = take_lowest(df, F.lit(target), key, seed)
    else:
        pos, normal = df.filter(mask), df.filter(~mask)
        n_pos = pos.select(F.count(F.lit(1))).scalar()
        out = take_lowest(pos, F.lit(target), key, seed).unionByName(
            take_lowest(normal, F.greatest(F.lit(target) - n_pos, F.lit(0)), key, seed))
    if shuffle:
        out = out.orderBy(_hash(_key_text(out, key), seed + 1), F.col(key))
    return out


def fraction_sample(df: DataFrame, fraction: float, seed: int = 42, key: str = "transaction_id") -> DataFrame:
    """Hash-threshold Bernoulli sample: no shuffle, no ordering, any size."""
    u = _hash(_key_text(df, key), seed) / F.lit(float(1 << 60))
    return df.filter(u < fraction)


def sample_class_counts(sample: DataFrame) -> DataFrame:
    mask = positive_mask(sample)
    cls = F.when(mask, "positive").otherwise("normal") if mask is not None else F.lit("normal")
    return sample.groupBy(cls.alias("class")).agg(F.count(F.lit(1)).alias("rows"))
