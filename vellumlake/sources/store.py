"""Where tables are kept that executors and the driver share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below what spark.checkpoint.dir names (on one machine without it, below one of our own); it goes when the application ends."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "/tmp/checkpoints"
    folder = f"{top.rstrip('/')}/{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return folder


#: Rows, and about the bytes, that a Python worker takes in at once: a worker holds a few copies of both.
BATCH_ROWS, BATCH_BYTES = 1000, 4_000_000


def small_batches(spark: SparkSession) -> None:
    """Lets Python workers of this session take bounded batches, whatever the length of texts, and give freed memory back."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key)
        now = int(now.upper().removesuffix("B")) if now.upper().removesuffix("B").lstrip("-").isdigit() else 0
        if not 0 < now <= most:
            spark.conf.set(key, str(most))
    spark.sparkContext.environment.update({"MALLOC_MMAP_THRESHOLD_": "1048576", "ARROW_DEFAULT_MEMORY_POOL": "system"})
