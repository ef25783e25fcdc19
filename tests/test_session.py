"""Joins go by measured sizes."""

from pyspark.sql import functions as F

from kithgraph import session
from kithgraph.sources.graph import Graph


def test_a_table_whose_files_are_small_is_not_gathered_on_the_driver(spark, tmp_path):
    Graph(spark, str(tmp_path))
    spark.range(300_000).select("id", F.lit("x" * 100).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/big.parquet")
    big = spark.read.parquet(f"{tmp_path}/big.parquet")
    rows = spark.range(2_000_000).join(big, "id").groupBy("text").agg(F.count("*").alias("n"))
    assert [r["n"] for r in rows.collect()] == [300_000]
    assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()


def test_partitions_grow_with_the_stored_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "INPUT_PER_PARTITION", 1000, raising=False)
    (tmp_path / "orders.parquet").mkdir()
    (tmp_path / "orders.parquet" / "part-0").write_bytes(b"x" * 60_000)
    (tmp_path / "events.parquet").write_bytes(b"x" * 39_500)
    key, before = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", spark.conf.get("spark.sql.shuffle.partitions")
    try:
        session.sized_tasks(spark, str(tmp_path))
        assert spark.conf.get(key) == "100" and spark.conf.get("spark.sql.shuffle.partitions") == before
        (tmp_path / "events.parquet").write_bytes(b"x")
        session.sized_tasks(spark, str(tmp_path))
        assert spark.conf.get(key) == "61"
        spark.conf.set(key, "7")  # somebody else's
        session.sized_tasks(spark, str(tmp_path))
        assert spark.conf.get(key) == "7"
    finally:
        spark.conf.unset(key)


def test_shuffle_files_go_with_their_action(spark, tmp_path):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark.conf.unset(key)
    Graph(spark, str(tmp_path))
    assert spark.conf.get(key) == "true"
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert sorted(rows.collect()) == sorted(rows.collect()) and rows.count() == 7  # again without them
    spark.conf.set(key, "false")  # somebody else's
    Graph(spark, str(tmp_path))
    assert spark.conf.get(key) == "false"
    spark.conf.unset(key)
