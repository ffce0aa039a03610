"""Session settings the engine relies on."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

from pricewake.sources.stored import stored_bytes

RUNTIME_CONF = {
    # Day grain is the UTC calendar day.
    "spark.sql.session.timeZone": "UTC",
    # Joins against the listing table are sized, and skewed ones split, at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A task sorts and folds what it reads, at some 25 MB of memory for each MB shuffled
    # to it; both sizes bound that whatever the size of the input.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.files.maxPartitionBytes": "16m",
}

# Input files, in bytes, that come to one partition of a shuffle at first; small partitions are merged at run time.
PARTITION_BYTES = 4 << 20


def configure(spark: SparkSession, *inputs: str) -> SparkSession:
    """Apply the settings to a session the caller owns.

    With ``inputs``, the files or folders to be read, shuffles start from as many
    partitions as these need, and never from fewer than ``spark.sql.shuffle.partitions``;
    merging can only make partitions larger.
    """
    for name, value in RUNTIME_CONF.items():
        spark.conf.set(name, value)
    if inputs:
        needed = math.ceil(sum(stored_bytes(spark, path) for path in inputs) / PARTITION_BYTES)
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", max(least, needed))
    return spark


def local_session(
    cores: str = "*", partitions: int = 8, memory: str = "8g", **conf: str
) -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pricewake")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
