"""Session defaults shared by the tests, the bench and interactive use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Batches handed to Python are bounded by rows and by bytes, so that a few very long texts cannot fill a worker.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | None = None, partitions: int | None = None, name: str = "feedloom") -> SparkSession:
    """A single-machine session; on a cluster the caller brings its own."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{n}]").appName(name)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions or n)).config("spark.driver.memory", "8g")
    return builder.getOrCreate()
