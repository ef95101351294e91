"""Counting pairs of points by two comparisons without listing a pair.

In a unit, an OUT point is counted by an AFTER point when it lies later on x, by a BEFORE point when it lies not later,
and in both cases only when its y is at least theirs. Points are ranked by x; two points differ first in one bit of
their ranks, so each such pair meets in exactly one block of one level, where the x comparison is already decided and
a running count along falling y finishes it. Rows are n log2(n) for a unit of n points.

``strict_x`` and ``strict_y`` leave out pairs with equal x or equal y (coordinates that are slab numbers).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OUT, AFTER, BEFORE = 0, 1, 2


def count_pairs(points: DataFrame, unit: list[str], key: str, strict_x: bool = False, strict_y: bool = False) -> DataFrame:
    """(key, pairs) from points (unit columns with ``key`` among them, x, y, kind, w); w is a number of equal points."""
    kind = F.col("kind")
    # equal x: an OUT comes before those who ask, or between them when equal x does not count
    x_tie = F.when(kind == OUT, 1).when(kind == AFTER, 2).otherwise(0 if strict_x else 2)
    y_tie = F.when(kind == OUT, 1).otherwise(0 if strict_y else 2)
    whole = Window.partitionBy(*unit)
    ranked = points.withColumns({"_i": F.row_number().over(whole.orderBy("x", x_tie)) - 1, "_n": F.count(F.lit(1)).over(whole),
                                 "_outs": F.count_if(kind == OUT).over(whole)}).where("_outs > 0 and _outs < _n")
    i = F.col("_i")

    def block(level):
        node = F.call_function("shiftright", i, level)
        odd = node.bitwiseAND(F.lit(1))
        # an OUT in the right half is later than the left half's AFTER points, one in the left half not later than the right's BEFORE
        meets = F.when(kind == OUT, True).when(kind == AFTER, odd == 0).otherwise(odd == 1)
        later = F.when(kind == OUT, odd).when(kind == AFTER, 1).otherwise(0)
        return F.when(meets, F.struct(level.alias("level"), F.call_function("shiftright", node, F.lit(1)).alias("pair"), later.alias("later")))

    levels = F.sequence(F.lit(0), F.length(F.bin((F.col("_n") - 1).cast("long"))) - 1)
    met = ranked.select(*unit, "y", "kind", "w", y_tie.alias("_tie"), F.explode(F.array_compact(F.transform(levels, block))).alias("b")).select(
        *unit, "y", "kind", "w", "_tie", "b.*")
    falling = Window.partitionBy(*unit, "level", "pair", "later").orderBy(F.desc("y"), "_tie").rowsBetween(Window.unboundedPreceding, 0)
    run = met.withColumn("_run", F.sum(F.when(kind == OUT, F.col("w")).otherwise(0)).over(falling))
    return run.where(kind != OUT).groupBy(key).agg(F.sum(F.col("_run") * F.col("w")).alias("pairs"))
