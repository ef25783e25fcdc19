"""Spark session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
GUESSED_CONF = "spark.sql.autoBroadcastJoinThreshold"
MEASURED_CONF = "spark.sql.adaptive.autoBroadcastJoinThreshold"
GUESSED = "64KB"  # files of a few hundred rows
INITIAL_CONF = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
OWN_INITIAL_CONF = "kithgraph.initialPartitionNum"  # what was set here, so that a cluster's own setting is known from it
INPUT_PER_PARTITION = 4 << 20  # stored bytes; a compressed row is several times as long in a task
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
TASK_SIZES = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB", "spark.sql.files.maxPartitionBytes": "32MB"}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on; cluster settings win where given."""
    builder = SparkSession.builder.appName("kithgraph")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def measured_broadcasts(spark: SparkSession) -> None:
    """Broadcast joins by measured sizes, no longer by guessed ones.

    A guess starts from the bytes of compressed files and does not see how many rows an explode makes, so the driver would
    gather tables of many times the threshold.  What Spark chose by size stays as the limit of what adaptive execution has measured.
    """
    if spark.conf.get(MEASURED_CONF, None) is None:
        spark.conf.set(MEASURED_CONF, spark.conf.get(GUESSED_CONF))
        if "-" not in spark.conf.get(GUESSED_CONF):
            spark.conf.set(GUESSED_CONF, GUESSED)


def sized_tasks(spark: SparkSession, folder: str) -> None:
    """What a task reads stays the same size however large the input: shuffle partitions in proportion to the stored bytes, small splits.

    With a fixed number of partitions sorts and aggregates of a task grow with the input.  Adaptive execution merges what is small.  Settings
    that were made elsewhere stay.
    """
    given = spark.conf.get(INITIAL_CONF, None)
    if given is None or given == spark.conf.get(OWN_INITIAL_CONF, None):
        size = _stored_bytes(spark, folder)
        number = str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // INPUT_PER_PARTITION)))
        spark.conf.set(INITIAL_CONF, number)
        spark.conf.set(OWN_INITIAL_CONF, number)
    for key, value in TASK_SIZES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def short_lived_shuffles(spark: SparkSession) -> None:
    """Shuffle files are deleted when the action that made them has ended, unless this is set elsewhere.

    Otherwise they stay until the driver's garbage collection meets them, so the disk holds those of every stored table and round of a query
    at once.  An action that is run again makes them again.
    """
    if spark.conf.get(CLEANUP_CONF, None) is None:
        spark.conf.set(CLEANUP_CONF, "true")


def _stored_bytes(spark: SparkSession, folder: str) -> int:
    """Bytes of the files below a folder, those in table folders included; none if it cannot be listed."""
    path, size = spark._jvm.org.apache.hadoop.fs.Path(folder), 0
    try:
        each = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
        while each.hasNext():
            size += each.next().getLen()
    except Py4JJavaError:
        return 0
    return size


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named in ``spark.checkpoint.dir``.

    Only in local mode, where nothing is configured, a folder of this machine is made; on a cluster executors could not
    see each other's files in it, so there it is an error.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="kithgraph-")
        spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; never reused, so nothing is overwritten.  It is deleted when the session's JVM ends."""
    path = os.path.join(shared_dir(spark), "scratch", f"{name}-{uuid.uuid4().hex}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: survives executor loss, unlike a local one."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def stored(df: DataFrame, name: str) -> DataFrame:
    """A lineage cut as a compressed table of the shared folder, for frames that are large; checkpoints are not compressed."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
