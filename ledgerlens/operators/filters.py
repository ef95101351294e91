"""Row filters. Plain ``filter`` calls: Catalyst merges them
and pushes them into the Parquet scan."""

from __future__ import annotations

import datetime as dt
from typing import Optional, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FilterSpec, RiskConfig
from ..functions.exprs import attach_scalars


def by_customers(df: DataFrame, ids: Sequence | DataFrame | None) -> DataFrame:
    """keep listed customers; empty list = no filter. Ids, listed or in a frame, are
    a left-semi join of any size (Spark broadcasts when the measured size allows)."""
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias("customer_id")), "customer_id", "left_semi")
    ids = list(ids)
    if not ids:
        return df
    kind = df.schema["customer_id"].dataType.simpleString()
    listed = df.sparkSession.createDataFrame([(str(i),) for i in ids if i is not None], "customer_id string")
    return df.join(listed.select(F.col("customer_id").try_cast(kind).alias("customer_id")), "customer_id", "left_semi")


def _is_date_only(text: str) -> bool:
    """Does the text name a day without a time of day?"""
    try:
        dt.datetime.strptime(text.strip(), "%Y-%m-%d")
    except ValueError:
        return False
    return True


def by_dates(df: DataFrame, start: Optional[str] = None, end: Optional[str] = None,
             end_of_day: bool = True) -> DataFrame:
    """both ends inclusive. A date-only end covers the whole day unless
    ``end_of_day=False`` (then it means midnight, as in the reference)."""
    ts = F.col("timestamp")
    if start:
        df = df.filter(ts >= F.lit(start).cast("timestamp_ntz"))
    if end:
        if end_of_day and _is_date_only(end):
            df = df.filter(ts < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
        else:
            df = df.filter(ts <= F.lit(end).cast("timestamp_ntz"))
    return df


def by_amount(df: DataFrame, lo: Optional[float] = None, hi: Optional[float] = None) -> DataFrame:
    """min/max amount, both inclusive, each optional. A NaN amount is missing: no bound keeps it."""
    if lo is not None:   # Spark sorts NaN above every number
        df = df.filter((F.col("amount") >= lo) & ~F.isnan(F.col("amount").cast("double")))
    if hi is not None:
        df = df.filter(F.col("amount") <= hi)
    return df


def by_types(df: DataFrame, types: Sequence[str] | None) -> DataFrame:
    """F4."""
    return df.filter(F.col("transaction_type").isin(list(types))) if types else df


def by_countries(df: DataFrame, countries: Sequence[str] | None) -> DataFrame:
    """skipped when the column is absent."""
    if not countries or "counterparty_country" not in df.columns:
        return df
    return df.filter(F.col("counterparty_country").isin(list(countries)))


def by_channels(df: DataFrame, channels: Sequence[str] | None) -> DataFrame:
    """declared by the reference's filter spec; applied here."""
    if not channels or "channel" not in df.columns:
        return df
    return df.filter(F.col("channel").isin(list(channels)))


def last_n(df: DataFrame, n: int, unit: str = "days") -> DataFrame:
    """"last N days/weeks/months (30 d)" anchored on the data's own max
    timestamp; both ends truncated to dates, the end covering its whole day."""
    days = {"days": 1, "day": 1, "weeks": 7, "week": 7, "months": 30, "month": 30}[unit] * n
    d = attach_scalars(df, df, "_last", F.to_date(F.max("timestamp")).alias("end"))
    end = F.col("_last.end")
    ts = F.col("timestamp")
    return d.filter((ts >= F.date_sub(end, days).cast("timestamp_ntz"))
                    & (ts < F.date_add(end, 1).cast("timestamp_ntz"))).drop("_last")


def apply_filters(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """F7 (+F11): conjunction of the spec's filters."""
    df = by_customers(df, spec.customer_ids)
    df = by_dates(df, spec.date_start, spec.date_end, spec.end_of_day)
    df = by_amount(df, spec.min_amount, spec.max_amount)
    df = by_types(df, spec.transaction_types)
    df = by_countries(df, spec.countries)
    return by_channels(df, spec.channels)


def cash_only(df: DataFrame) -> DataFrame:
    """F8."""
    return df.filter(F.coalesce(F.col("is_cash"), F.lit(False)))


def near_ctr(df: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """structuring_lower <= amount < ctr_threshold (half-open)."""
    return df.filter((F.col("amount") >= cfg.structuring_lower) & (F.col("amount") < cfg.ctr_threshold))


def get_customer(customers: DataFrame, customer_id) -> DataFrame:
    """point lookup, at most one record."""
    return customers.filter(F.col("customer_id") == customer_id).limit(1)
