"""What the operators of this subpackage share: written tables, row keys and batches of text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.operators.numbering import global_positions
from kithgraph.session import scratch_path

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: cuts lineage and survives lost executors, and its size is known to the planner."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a ``written`` table that nothing will read any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def row_keyed(docs: DataFrame, id_col: str, text_col: str, name: str = "__key") -> DataFrame:
    """Adds a unique long that sorts rows by (id, text), nulls first.

    It is the id itself where ids are unique and filled.  Otherwise rows get their position in that order, so
    repeated rows count as documents of their own.
    """
    seen = docs.select(F.count("*").alias("n"), F.count(id_col).alias("filled"), F.countDistinct(id_col).alias("kinds")).first()
    if seen["n"] == seen["filled"] == seen["kinds"] and dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint"):
        return docs.withColumn(name, F.col(id_col).cast("long"))
    order = (F.col(id_col).asc_nulls_first(), F.col(text_col).asc_nulls_first())
    return written(global_positions(docs, order, name), "keyed").withColumn(name, F.col(name).cast("long"))


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts of an Arrow column as bytes; null is empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def text_bytes(column: pa.Array) -> np.ndarray:
    """Length of each text of an Arrow column in bytes; 0 where it is null."""
    return pc.fill_null(pc.binary_length(column.cast(pa.binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def bounded_slices(batches: Iterator[pa.RecordBatch], text_col: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows with about ``limit`` bytes of text each; a longer text is a run of its own."""
    for batch in batches:
        texts = utf8(batch.column(batch.schema.get_field_index(text_col)))
        start = size = 0
        for i, text in enumerate(texts):
            if size and size + len(text) > limit:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(text)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def arrow(schema: pa.Schema, *columns: Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
