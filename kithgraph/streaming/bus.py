"""Event streams: sources, validation, fan-out, idempotent hand-over."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kithgraph.session import scratch_path

ENVELOPE = ("event_id string, event_type string, schema_version string, occurred_at string, producer string, correlation_id string, "
            "causation_id string, confidence double, provenance map<string,string>, payload string")


def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Replayable stream over a parquet table, from its first row.

    The path is given as a pattern that matches only itself, so the table may be a folder or one file.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def validated(raw: DataFrame, column: str = "value") -> DataFrame:
    """Parsed envelopes with a ``valid`` flag: an id and a type, confidence in [0, 1], a readable time (UTC)."""
    parsed = raw.withColumn("e", F.from_json(column, ENVELOPE)).select(column, "e.*")
    at = F.try_to_timestamp("occurred_at")
    ok = (F.coalesce("event_id", F.lit("")) != "") & (F.coalesce("event_type", F.lit("")) != "") & at.isNotNull() \
        & (F.col("confidence").isNull() | F.col("confidence").between(0.0, 1.0))
    return parsed.withColumn("occurred_at", at).withColumn("valid", F.coalesce(ok, F.lit(False)))


def drain(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None, path: str | None = None) -> str:
    """Run a stream over what is there, as parquet; returns the folder.  Each sink has its own checkpoint."""
    path = path or scratch_path(df.sparkSession, name)
    q = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint or path + "-checkpoint") \
        .trigger(availableNow=True).start(path)
    q.awaitTermination()
    return path


def distinct_events(df: DataFrame, key: str = "event_id", at: str = "occurred_at", within: str = "1 day") -> DataFrame:
    """Each event once, also when it is delivered again in a later batch.

    Keys seen are state, and are forgotten once the stream's time has moved on by ``within``; what is delivered later than
    that is let through again, and events without a time are not told apart by it.
    """
    return df.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def subscribe(df: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """One subscriber: sees every event from its checkpoint on.  Hand-over is at least once, so handlers must be idempotent."""
    return df.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def idempotent_append(path: str, key: str = "event_id") -> Callable[[DataFrame, int], None]:
    """Handler that writes each batch under its own number: a repeated batch replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
