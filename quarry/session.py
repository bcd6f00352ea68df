"""Session defaults for local runs; on a cluster the given session is used as it is."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of a batch of rows sent to Python, where the session has no bound of its own.

    Rows may hold long texts, and a task keeps a batch several times over: in the JVM's heap,
    in its Arrow buffers and in the worker.
    """
    spark.conf.set(BATCH_BYTES, spark.conf.get(BATCH_BYTES, str(8 << 20)))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path that all machines share: in spark.checkpoint.dir, or on one machine a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{named or tempfile.mkdtemp(prefix='quarry-')}/{name}-{uuid.uuid4().hex[:12]}"


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with UTC time, AQE and Arrow switched on."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    small_batches(spark)
    return spark
