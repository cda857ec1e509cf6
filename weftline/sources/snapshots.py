"""A registry snapshot that is used again while it is young and was built with the same options.

A snapshot is a folder of Parquet with a pointer beside it, a line of JSON that is written last: what has no pointer isn't there, so a
build that was cut short is never read. The newest pointer counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "path string, built_at timestamp, include_prerelease boolean, rows long"


def _pointers(spark: SparkSession, folder: str) -> DataFrame:
    """All pointers; a folder without any is an empty table."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/pointers")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], POINTER)
    return spark.read.schema(POINTER).json(f"{folder}/pointers")


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest pointer, if there is one."""
    return _pointers(spark, folder).orderBy(F.desc("built_at"), "path").limit(1)


def write_snapshot(rows: DataFrame, folder: str, include_prerelease: bool, built_at: datetime) -> DataFrame:
    """Write the rows, then the pointer; the rows, read back."""
    spark, path = rows.sparkSession, f"{folder}/data-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    found = spark.read.schema(rows.schema).parquet(path)
    pointer = found.agg(F.count("*").alias("rows")).select(F.lit(path).alias("path"), F.lit(built_at).alias("built_at"), F.lit(include_prerelease).alias("include_prerelease"), "rows")
    pointer.coalesce(1).write.mode("append").json(f"{folder}/pointers")
    return found


def reusable(pointer: DataFrame, include_prerelease: bool, max_age: timedelta, now: datetime) -> DataFrame:
    """pointer if it is no older than max_age in whole seconds, not from the future, and built with the same option. Age 0 reuses nothing."""
    age = F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("built_at")) / 1_000_000)
    most = int(max_age.total_seconds())
    return pointer.where((F.lit(most) > 0) & (age >= 0) & (age <= most) & (F.col("include_prerelease") == include_prerelease))


def load_or_build(spark: SparkSession, folder: str, include_prerelease: bool, max_age: timedelta, now: datetime, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The snapshot and whether it was there already; only its one-row pointer comes to the driver."""
    found = reusable(latest(spark, folder), include_prerelease, max_age, now).first()
    if found:
        return spark.read.parquet(found.path), True
    return write_snapshot(build(), folder, include_prerelease, now), False
