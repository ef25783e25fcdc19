"""Longest run of flagged rows per key, safe for keys that hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def longest_runs(df: DataFrame, key: str, order: Sequence[Column], flag: Column) -> DataFrame:
    """Longest run of true flags per key in the given order.

    A range shuffle on (key, order) cuts a long key into consecutive chunks, each handled by its
    own task.  A chunk is reduced to one row (its leading, trailing and longest run and its number of
    breaks) and the chunks of a key, at most one per shuffle partition, are folded in order.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flagged = df.withColumn("__flag", flag.cast("int"))
    chunked = (flagged.repartitionByRange(width, F.col(key), *order)
               .withColumn("__chunk", F.spark_partition_id()))
    rows_so_far = (Window.partitionBy("__chunk", key).orderBy(*order)
                   .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = (chunked.withColumn("__run", F.sum(1 - F.col("__flag")).over(rows_so_far))
            .groupBy("__chunk", key, "__run").agg(F.sum("__flag").alias("n")))
    chunks = runs.groupBy("__chunk", key).agg(
        F.max("__run").alias("breaks"), F.max("n").alias("longest"),
        F.sum(F.when(F.col("__run") == 0, F.col("n")).otherwise(0)).alias("head"), F.max_by("n", "__run").alias("tail"))
    ordered = chunks.groupBy(key).agg(F.array_sort(F.collect_list(
        F.struct(F.col("__chunk").alias("chunk"), "breaks", "longest", "head", "tail"))).alias("chunks"))
    zero = F.struct(F.lit(0).cast("bigint").alias("run"), F.lit(0).cast("bigint").alias("best"))

    def fold(acc: Column, c: Column) -> Column:
        joined = acc["run"] + c["head"]
        return F.struct(F.when(c["breaks"] == 0, joined).otherwise(c["tail"]).alias("run"),
                        F.greatest(acc["best"], joined, c["longest"]).alias("best"))

    return ordered.select(key, F.aggregate("chunks", zero, fold, lambda acc: acc["best"]).alias("longest_run"))
