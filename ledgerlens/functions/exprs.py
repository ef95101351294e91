"""Column-expression helpers. All built-in Spark functions: they stay inside
whole-stage codegen; no Python runs per row."""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LEVEL_ACTIONS, RISK_LEVELS, RiskConfig


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """numpy-style clip that keeps NULL as NULL (``greatest``/``least`` would skip it)."""
    out = c
    if lo is not None:
        out = F.when(c.isNull(), None).otherwise(F.greatest(out, F.lit(lo)))
    if hi is not None:
        out = F.when(c.isNull(), None).otherwise(F.least(out, F.lit(hi)))
    return out


def attach(df: DataFrame, name: str, scalar: Column) -> DataFrame:
    """``df`` with a scalar subquery as column ``name``, planned once however often the column is read.

    A plain projection would be copied into every expression that reads a field of it, each copy a subquery of its
    own; a generator of one row is no projection. No join, no collect.
    """
    return df.select("*", F.explode(F.array(scalar)).alias(name))


def attach_scalars(df: DataFrame, agg_of: DataFrame, name: str, *aggs: Column) -> DataFrame:
    """Attach one-row aggregates of ``agg_of`` to every row of ``df`` as struct column ``name``: one scalar subquery."""
    return attach(df, name, agg_of.select(F.struct(*aggs)).scalar())


def known_number(c: Column) -> Column:
    """NaN counts as missing: pandas skips it, Spark's aggregates and comparisons do not."""
    return F.when(~F.isnan(c.cast("double")), c)


def hours_between(a: Column, b: Column) -> Column:
    """(b - a) in fractional hours, exact to the microsecond; works on NTZ timestamps."""
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(3.6e9)


def days_between(a: Column, b: Column) -> Column:
    """(b - a) in fractional days."""
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(86400e6)


def whole_days(a: Column, b: Column) -> Column:
    """pandas ``Timedelta.days`` of (b - a): floor of the day count."""
    return F.floor(days_between(a, b))


def is_high_risk(df: DataFrame, cfg: RiskConfig, country_col: str = "counterparty_country",
                 out: str = "_high_risk") -> DataFrame:
    """Add boolean ``out``: counterparty country in the configured high-risk set.

    The set is either a literal list (default) or a one-column ``country`` frame
    (e.g. nations of a region). A frame is a country dimension -- bounded by the
    number of jurisdictions -- so Spark broadcasts it when its measured size allows.
    """
    hr = cfg.high_risk_countries
    if isinstance(hr, DataFrame):
        dim = hr.select(F.col("country").alias("_hr_country")).distinct().withColumn("_hr_hit", F.lit(True))
        j = df.join(dim, F.col(country_col) == F.col("_hr_country"), "left")
        return j.withColumn(out, F.coalesce(F.col("_hr_hit"), F.lit(False))).drop("_hr_country", "_hr_hit")
    return df.withColumn(out, F.coalesce(F.col(country_col).isin(list(hr)), F.lit(False)))


def level_of(score: Column, cfg: RiskConfig) -> Column:
    return (F.when(score <= cfg.risk_low_upper, "low")
            .when(score <= cfg.risk_medium_upper, "medium")
            .when(score <= cfg.risk_high_upper, "high")
            .otherwise("critical"))


def action_of(level: Column) -> Column:
    out = None
    for lv, act in LEVEL_ACTIONS:
        out = F.when(level == lv, act) if out is None else out.when(level == lv, act)
    return out


def level_rank(level: Column) -> Column:
    """critical=0 ... low=3: lower is more severe."""
    out = None
    for i, lv in enumerate(reversed(RISK_LEVELS)):
        out = F.when(level == lv, i) if out is None else out.when(level == lv, i)
    return out


def levels_frame(spark, column: str = "risk_level"):
    """Literal frame of the four levels in fixed display order (critical first)."""
    rows = [(lv, i) for i, lv in enumerate(reversed(RISK_LEVELS))]
    return spark.createDataFrame(rows, f"{column} string, level_order int")


def actions_frame(spark):
    rows = [(act, i) for i, (_, act) in enumerate(reversed(LEVEL_ACTIONS))]
    return spark.createDataFrame(rows, "escalation_action string, action_order int")


def encode(c: Column, mapping: Sequence[tuple[str, int]], default: int = 0) -> Column:
    out = None
    for k, v in mapping:
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(default)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Schema inspection only (driver metadata, no data)."""
    ex = set(exclude)
    num = ("int", "bigint", "double", "float", "smallint", "tinyint", "decimal")
    return [n for n, t in df.dtypes if n not in ex and t.split("(")[0] in num]
