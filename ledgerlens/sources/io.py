"""Sources and sinks with explicit schemas (no inference)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import known_number

TRANSACTION_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("transaction_type", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("counterparty_id", T.StringType()),
    T.StructField("counterparty_country", T.StringType()),
    T.StructField("currency", T.StringType()),
    T.StructField("account_balance", T.DoubleType()),
    T.StructField("is_cash", T.BooleanType()),
    T.StructField("merchant_category", T.StringType()),
    T.StructField("ground_truth_flag", T.BooleanType()),
    T.StructField("ground_truth_pattern", T.StringType()),
])

CUSTOMER_SCHEMA = T.StructType([
    T.StructField("customer_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("occupation", T.StringType()),
    T.StructField("account_type", T.StringType()),
    T.StructField("account_open_date", T.DateType()),
    T.StructField("country", T.StringType()),
    T.StructField("risk_category", T.StringType()),
    T.StructField("pep_flag", T.BooleanType()),
    T.StructField("kyc_status", T.StringType()),
])

FEEDBACK_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("entity_id", T.StringType()),
    T.StructField("decision", T.StringType()),
])


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str, columns: dict[str, str] | None) -> DataFrame:
    """CSV by header name, or Parquet. ``columns`` renames source columns first. Either way every known column is
    ``try_cast`` to its declared type (a bad value becomes NULL, never a failed job) and NaN becomes NULL; unknown
    columns stay as they are, absent optional columns stay absent."""
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"format {fmt!r}: csv or parquet")
    raw = spark.read.parquet(path) if fmt == "parquet" else spark.read.option("header", True).option("inferSchema", False).csv(path)
    raw = raw.withColumnsRenamed(columns or {})
    types = {f.name: f.dataType for f in schema.fields}

    def known(c: str):
        x = F.col(f"`{c}`").try_cast(types[c])
        return known_number(x) if isinstance(types[c], T.DoubleType) else x

    return raw.select(*[known(c).alias(c) if c in types else F.col(f"`{c}`") for c in raw.columns])


def read_transactions(spark: SparkSession, path: str, fmt: str = "csv", columns: dict[str, str] | None = None) -> DataFrame:
    """CSV or Parquet; bad timestamps become NULL."""
    return _read(spark, path, TRANSACTION_SCHEMA, fmt, columns)


def read_customers(spark: SparkSession, path: str, fmt: str = "csv", columns: dict[str, str] | None = None) -> DataFrame:
    """Customers; account_open_date coerced to DATE, bad -> NULL."""
    return _read(spark, path, CUSTOMER_SCHEMA, fmt, columns)


def write_sample(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """S3: overwrite a sampled table (parquet by default, csv with header)."""
    w = df.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))


def append_feedback(df: DataFrame, path: str) -> None:
    """Append decisions (timestamp, entity_id, decision); creates the log if absent.
    Append-mode Parquet: each writer adds files, no read-modify-write."""
    df.select(F.col("timestamp").cast("timestamp_ntz"), F.col("entity_id").cast("string"),
              F.col("decision").cast("string")).write.mode("append").parquet(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """The feedback log; an absent log is an empty frame (zero counts)."""
    try:
        return spark.read.schema(FEEDBACK_SCHEMA).parquet(path)
    except Exception as e:  # absent path
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], FEEDBACK_SCHEMA)
        raise
