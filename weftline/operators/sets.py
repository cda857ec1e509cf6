"""Unions and differences with an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.graph import ends_of, sides


def touching_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """id with its outgoing and incoming edges, each once."""
    found = sides(edges).join(ids.select(F.col("id").alias("page")), "page", "left_semi").distinct()
    return ends_of(found).select(F.col("page").alias("id"), "from_id", "to_id", "kind")


def ordered_union(primary: DataFrame, secondary: DataFrame, key: str, value: str, order: str, limit: int) -> DataFrame:
    """For each key the values of primary then secondary, each at its first place, at most ``limit``."""
    both = primary.select(key, value, F.struct(F.lit(0).alias("part"), F.col(order).alias("at")).alias("o")).union(secondary.select(key, value, F.struct(F.lit(1).alias("part"), F.col(order).alias("at")).alias("o")))
    first = both.groupBy(key, value).agg(F.min("o").alias("o"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("o", value))).where(F.col("place") <= limit).drop("o")


def difference(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return wanted.join(present.select(key), key, "left_anti")


def latest_rows(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """New rows over old ones: the highest version of each key."""
    both = old.unionByName(new)
    return both.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(F.struct(*both.columns), version).alias("r")).select("r.*")


def first_rows(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old rows stay; of new keys the first row is added."""
    fresh = new.join(old.select(*keys), keys, "left_anti")
    firsts = fresh.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min_by(F.struct(*fresh.columns), order).alias("r")).select("r.*")
    return old.unionByName(firsts)
