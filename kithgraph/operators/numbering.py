"""Dense positions over a whole frame without sending it through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kithgraph.session import cut_lineage


def global_positions(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """1, 2, 3 ... in the given order.

    Range chunks are numbered in their own tasks; only one count per chunk is added up.  The
    chunks are checkpointed so that both uses see the same boundaries.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunked = cut_lineage(df.repartitionByRange(width, *order).withColumn("__chunk", F.spark_partition_id()))
    local = chunked.withColumn("__local", F.row_number().over(Window.partitionBy("__chunk").orderBy(*order)))
    sizes = chunked.groupBy("__chunk").agg(F.count("*").alias("n"))  # at most one row per chunk
    before = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    return (local.join(F.broadcast(offsets), "__chunk")
            .withColumn(name, F.col("__offset") + F.col("__local")).drop("__chunk", "__local", "__offset"))
