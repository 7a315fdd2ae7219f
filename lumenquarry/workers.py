"""What Python workers need from the driver."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Bytes of rows in an Arrow batch.
BATCH_BYTES = 4 << 20


def find_package(spark: SparkSession) -> None:
    """Let workers import this package from where the driver has it, whatever folder the driver runs in.

    On a cluster whose machines don't share that folder the package has to be shipped (--py-files).
    """
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in paths:
        env["PYTHONPATH"] = os.pathsep.join([here, *paths])


def bounded_batches(spark: SparkSession) -> None:
    """Hold what one Arrow batch brings to a Python worker to BATCH_BYTES, however long the texts are (a longer row comes alone)."""
    find_package(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
