from __future__ import annotations

import pytest


@pytest.fixture
def documents(spark):
    """Builds a documents frame from (doc_id, text) pairs, with extra columns whose names clash with inner ones."""
    def build(rows, schema="doc_id long, text string"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, schema)
        return df.withColumn("key", F.lit("x")).withColumn("n", F.lit(None).cast("string")).withColumn("fp", F.lit(1)).withColumn("id", F.lit("?"))

    return build
