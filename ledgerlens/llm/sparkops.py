"""Spark helpers of this subpackage: cut lineage, filter by a bounded bitmap, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import ensure_checkpoint_dir

#: bits of the bitmap that thins out a scan before an exact join (4 MB, whatever the input)
BITMAP_BITS = 1 << 25
_PAGE_BITS = 1 << 15
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def settle(df: DataFrame, free: bool = False) -> DataFrame:
    """Write to the cluster's shared checkpoint folder and read back: no lineage, nothing lost with an executor.

    ``free``: the shuffle files of the write go when it ends, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledgerlens-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE, "false")
    try:
        if free:
            spark.conf.set(_FREE, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if free:
            spark.conf.set(_FREE, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._ledgerlens_path = path
    return out


def drop_settled(df: DataFrame) -> None:
    """Delete a table of ``settle`` that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "_ledgerlens_path", None)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def thinned(df: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among ``keys``: no row of a listed key is lost, few others stay.

    A fixed-size bitmap of key hashes is broadcast (``BITMAP_BITS``); an exact join must follow. It only keeps
    long texts that nobody asked for out of the join's shuffle.
    """
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(BITMAP_BITS))
    spot = {"_page": F.shiftright(place, 15), "_bit": place.bitwiseAND(F.lit(_PAGE_BITS - 1))}
    pages = keys.select(*[c.alias(n) for n, c in spot.items()]).groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright("_bit", 3) + F.lit(1), F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, F.col("_bit").bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) != 0
    return df.withColumns(spot).join(F.broadcast(pages), "_page").where(is_set).drop("_page", "_bit", "_bits")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (columns a, b, undirected), for every node in it.

    Alternates large-star and small-star steps, each two aggregations with map-side combine and a join that
    adaptive execution can split; no node's neighbours are ever gathered. Ends when a step changes nothing.
    """
    cur = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        nxt = settle(small)
        drop_settled(cur)
        cur = nxt
        now = cur.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError("connected components did not settle")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
