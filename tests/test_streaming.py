"""Streaming feedback statistics agree with the batch operators after each append."""

import datetime as dt

from ledgerlens.operators import feedback as H
from ledgerlens.sources import io
from ledgerlens.streaming import feedback as S

SCHEMA = "timestamp timestamp_ntz, entity_id string, decision string"


def test_stream_tracks_appends(spark, tmp_path):
    log = str(tmp_path / "log")
    first = [(dt.datetime(2024, 1, 1), "A", "Confirm"), (dt.datetime(2024, 1, 1), "B", "Confirm")]
    io.append_feedback(spark.createDataFrame(first, SCHEMA), log)
    stream = S.read_feedback_stream(spark, log)
    q1 = (S.feedback_stats_stream(stream).writeStream.outputMode("complete").format("memory")
          .queryName("fb_stats").option("checkpointLocation", str(tmp_path / "ck1")).start())
    q2 = (S.feedback_latest_stream(stream).writeStream.outputMode("complete").format("memory")
          .queryName("fb_latest").option("checkpointLocation", str(tmp_path / "ck2")).start())
    try:
        q1.processAllAvailable(); q2.processAllAvailable()
        assert spark.table("fb_stats").collect()[0]["confirmed"] == 2
        later = [(dt.datetime(2024, 1, 5), "A", "False Positive"), (dt.datetime(2024, 1, 2), "C", "Confirm")]
        io.append_feedback(spark.createDataFrame(later, SCHEMA), log)
        q1.processAllAvailable(); q2.processAllAvailable()
        st = spark.table("fb_stats").collect()[0]
        batch = H.feedback_stats(io.read_feedback(spark, log)).collect()[0]
        assert (st["confirmed"], st["false_positives"]) == (batch["confirmed"], batch["false_positives"]) == (3, 1)
        latest = {r["entity_id"]: r["decision"] for r in spark.table("fb_latest").collect()}
        assert latest == {"A": "False Positive", "B": "Confirm", "C": "Confirm"}
    finally:
        q1.stop(); q2.stop()
