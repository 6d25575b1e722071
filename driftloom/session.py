"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Rows that carry whole HTML pages cross into Python in small batches.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}


def local_session(app: str = "driftloom", cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; a cluster job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("DRIFTLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.checkpoint.dir", os.environ.get("DRIFTLOOM_CHECKPOINTS", "/tmp/driftloom-checkpoints"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if str(cores).isdigit():
        # The test tables are single files of one row group: the fixtures of queries spread them by hand. Not for a cluster.
        builder = builder.config("spark.driftloom.spreadTables", str(cores))
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return folder.rstrip("/")


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the folder the cluster names."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
