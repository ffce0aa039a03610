"""Memoised loads: a table is rebuilt only when its stored version has expired.

A version is a folder of its own under ``versions``; the file ``current`` names
the one to read and when it was made. The name is switched in one step after the
version is complete, and a version is removed only when later ones have followed,
so a reader has the whole of one version, whatever is refreshed meanwhile.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pricewake.sources.stored import folder_names, read_line, remove_folder, switch_line

# Fixed value: a loaded table stays fresh for one hour.
MAX_AGE_SECONDS = 3600
# Versions that stay for readers which began before a switch, the current one included.
KEPT_VERSIONS = 3


def current_version(spark: SparkSession, path: str) -> tuple[str, float] | None:
    """Folder and time of the version to read, None before the first."""
    line = read_line(spark, f"{path}/current")
    if line is None:
        return None
    name, moment = line.split(" ")
    return f"{path}/versions/{name}", float(moment)


def refresh(spark: SparkSession, path: str, build: Callable[[], DataFrame], now: float | None = None) -> str:
    """Write a new version from ``build()`` and make it current; its folder.

    A failure on the way leaves the version before it current. Two refreshes at
    once write two versions, and the one that ends last is read.
    """
    moment = time.time() if now is None else now
    # Names sort by time.
    name = f"{int(moment * 1000):016d}-{uuid.uuid4().hex}"
    build().write.parquet(f"{path}/versions/{name}")
    switch_line(spark, f"{path}/current", f"{name} {moment}")
    # Versions being written by another refresh are newer than the current one.
    older = sorted(x for x in folder_names(spark, f"{path}/versions") if x < name)
    for old in older[: max(0, len(older) - KEPT_VERSIONS + 1)]:
        remove_folder(spark, f"{path}/versions/{old}")
    return f"{path}/versions/{name}"


def load_or_refresh(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    max_age: float = MAX_AGE_SECONDS,
    now: float | None = None,
) -> DataFrame:
    """The current version under ``path`` if young enough, else a new one from ``build()``."""
    moment = time.time() if now is None else now
    found = current_version(spark, path)
    if found is None or moment - found[1] >= max_age:
        found = (refresh(spark, path, build, moment), moment)
    return spark.read.parquet(found[0])
