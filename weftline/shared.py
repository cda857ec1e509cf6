"""The shared scratch folder, and cutting lineage with written tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART_BYTES = 4 << 20
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir. Only where that is unset on a single machine (tests) a local folder is used."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a write goes when it is written, so disks hold one step's shuffles and not those of all steps."""
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    with freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(*frames: DataFrame) -> int:
    """In how many partitions rows made from these frames are dealt: one for each ``PART_BYTES`` of the files below them, so that a task's share
    doesn't grow with the tables, and as many as there are cores at least. Only the lengths of files are read."""
    spark, files = frames[0].sparkSession, {unquote(f) for df in frames for f in df.inputFiles()}
    length = spark.read.format("binaryFile").load(sorted(files)).agg(F.sum("length")).first()[0] if files else 0
    return max(spark.sparkContext.defaultParallelism, -(-(length or 0) // PART_BYTES))
