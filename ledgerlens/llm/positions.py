"""Places of rows in an order, by range partitions and their counts; no window ever holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm.sparkops import partitions, settle

_IN_PART = (1 << 33) - 1


def ranked(df: DataFrame, group: list[str], order: list[str], pos: str = "pos", size: str = "size") -> DataFrame:
    """``df`` with the 0-based place of each row in its group (nulls first, as Spark sorts) and the group's size.

    Rows are dealt out by ranges of (group, order) and written, so that places cannot change when a task runs again;
    a row's place is its place in its partition, less the first of its group there, plus the group's rows in earlier
    partitions. A group with a third of all rows is spread over a third of the partitions. Rows equal in group and
    order are told apart by where they were read. Null groups are groups.
    """
    spark = df.sparkSession
    keys = [*group, *order, "_read"]
    # a written table gives every reader the same row numbers, also the sampling of the ranges
    dealt = settle(df).withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    rows = settle(dealt.drop("_read").withColumn("_at", F.monotonically_increasing_id())).withColumns(
        {"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit(_IN_PART))})
    parts = rows.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # at most one row per partition in each of these windows
    before = Window.partitionBy(*group).orderBy("_part")
    parts = parts.select("_part", *group, "_first", (F.sum("_n").over(before) - F.col("_n")).alias("_before"),
                         F.sum("_n").over(Window.partitionBy(*group)).alias(size))
    names = {c: f"_g{i}" for i, c in enumerate(group)}
    parts = parts.withColumnsRenamed({**names, "_part": "_p"})
    same = F.col("_part") == F.col("_p")
    for c, g in names.items():
        same = same & F.col(c).eqNullSafe(F.col(g))
    return rows.join(parts, same).withColumn(pos, F.col("_at") - F.col("_first") + F.col("_before")).select(*df.columns, pos, size)
