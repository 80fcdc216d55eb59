"""Names of the runs of a stream: a checkpoint has one, and a new checkpoint gets another."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The name of the checkpoint's run, made up at first use and kept beside its logs."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/run")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        out = files.create(at, False)
        out.write(bytearray(uuid.uuid4().hex.encode()))
        out.close()
    stream = files.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
