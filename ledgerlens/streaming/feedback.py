"""Analyst feedback as a stream (H1, H2 incrementally).

The feedback log (S4) is an append-only Parquet folder, so Structured Streaming
can keep its statistics current without re-reading it: new files become
micro-batches, the counts and the latest verdict per entity are state in the
streaming aggregation, and the state store plus the query checkpoint make the
job restartable after executor or driver loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.feedback import CONFIRM, FALSE_POSITIVE
from ..sources.io import FEEDBACK_SCHEMA


def read_feedback_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(FEEDBACK_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def feedback_stats_stream(stream: DataFrame) -> DataFrame:
    """H1 as a running global aggregate (output mode ``complete`` or ``update``)."""
    return stream.agg(F.count_if(F.col("decision") == CONFIRM).alias("confirmed"),
                      F.count_if(F.col("decision") == FALSE_POSITIVE).alias("false_positives"))


def feedback_latest_stream(stream: DataFrame) -> DataFrame:
    """H2 as a running per-entity aggregate: the decision with the latest timestamp."""
    return stream.groupBy("entity_id").agg(
        F.max_by("decision", "timestamp").alias("decision"), F.max("timestamp").alias("decided_at"))


def start_to_table(df: DataFrame, table_path: str, checkpoint: str, mode: str = "complete"):
    """Write each micro-batch's result to a Parquet folder, overwritten per batch; restartable via ``checkpoint``.
    The overwrite is not atomic: a reader may meet an empty or half-written folder while a batch is being written."""
    def sink(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(table_path)
    return (df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .foreachBatch(sink).start())
