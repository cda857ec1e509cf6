"""What the operators of this subpackage share: inputs, the shared scratch folder, cutting lineage."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = "4m"
BROADCAST_ROWS, SALTS = 100_000, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir. Only where that is unset on a single machine (tests) a local folder is used."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by bytes as well as rows, so very long texts don't add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that are out of use. It does so when the driver collects its garbage, which a
    driver with little to do may put off for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; whatever else the caller's table carries can't clash with an operator's own names."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once for a row however often ``then`` uses it, also inside lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def attached(big: DataFrame, small: DataFrame, keys: list[str], how: str, label: str) -> DataFrame:
    """big joined with the rows of small, which have a fixed width and a key each. small is broadcast if it has BROADCAST_ROWS rows at
    most; beyond that both are dealt by key and salt, so a key of any share of big goes to many tasks. Spark takes the SALTS rows of a key
    for one and would send them all through the driver, so the merge is asked for."""
    small = staged(small, label)
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), keys, how)
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(SALTS)))
    every = small.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(every.hint("merge"), [*keys, "__salt"], how).drop("__salt")
