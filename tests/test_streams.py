"""Redelivery over several batches and restarts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from kithgraph.streaming import bus


def test_a_redelivered_batch_adds_no_row(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("source", "sink", "checkpoint"))
    schema = "event_id string, occurred_at timestamp"
    rows = [(f"e{i}", datetime(2024, 1, 1, 12, i)) for i in range(6)]

    def deliver(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)

    def consume():
        stream = bus.distinct_events(bus.file_stream(spark, source, files_per_batch=1))
        bus.subscribe(stream, bus.idempotent_append(sink), checkpoint).awaitTermination()
        return sorted(r["event_id"] for r in spark.read.parquet(sink).select("event_id").collect())

    deliver(rows[:3])
    deliver(rows[:3])
    assert consume() == ["e0", "e1", "e2"]
    deliver(rows[2:])
    assert consume() == [f"e{i}" for i in range(6)]
    assert consume() == [f"e{i}" for i in range(6)]
    assert spark.read.parquet(sink).agg(F.count("*")).first()[0] == 6
