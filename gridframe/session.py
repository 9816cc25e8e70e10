"""Session settings the library relies on, and lineage cutting for its one iterative operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a batch that Spark hands to a Python worker.
ARROW_BYTES = 4 << 20


def configure(spark: SparkSession) -> SparkSession:
    """Settings that results, and the memory of Python workers, depend on. Safe to call on a running session.

    Workers hold a batch of rows while they work on it; without a bound in bytes a few long texts or vectors make it large.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


def local_session(cores: int | str = 8, memory: str = "8g", app: str = "gridframe") -> SparkSession:
    """Session for tests and the benchmark. On a cluster, bring your own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """This session's folder below ``spark.checkpoint.dir``, with its scheme. All machines can reach it.

    Only in local mode, where all tasks share the machine's folders, is a folder of our own chosen if neither the
    setting nor a directory on the context exists; elsewhere that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not sc.master.startswith(("local[", "local")) or not configured and sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="gridframe-checkpoint-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder.

    Used where several consumers read one intermediate table (a map with its gradient, labels of a tile) and in
    the rounds of component merging. The table is computed once, survives lost executors, and keeps the
    plans of its consumers short. Spark removes the files of checkpoints that are no longer used if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
