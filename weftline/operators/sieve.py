"""A sieve of fixed size ahead of joins: it drops rows that a join on ids would drop, before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.shared import staged

#: A sieve has 2**BITS places in words of 64, so 2**(BITS - 6) rows of two numbers at most, however many ids there are.
BITS = 25


def _spot(c: Column) -> Column:
    return F.xxhash64(c).bitwiseAND(F.lit((1 << BITS) - 1))


def sieve(ids: DataFrame, *columns: str) -> DataFrame:
    """word, bits: the places that the hashes of the ids in these columns take."""
    spots = ids.select(F.explode(F.array(*columns)).alias("id")).where("id is not null").select(_spot(F.col("id")).alias("spot"))
    bit = F.expr("shiftleft(1L, cast(spot & 63 as int))")
    return staged(spots.groupBy(F.shiftright("spot", 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")), "sieve")


def _met(rows: DataFrame, column: str, through: DataFrame, how: str) -> DataFrame:
    known = F.broadcast(through.select(F.col("word").alias("__word"), F.col("bits").alias("__bits")))  # of fixed size
    return rows.join(known, F.shiftright(_spot(F.col(column)), 6).cast("int") == F.col("__word"), how)


def _hit(column: str) -> Column:
    return F.getbit("__bits", _spot(F.col(column)).bitwiseAND(F.lit(63)).cast("int")) == 1


def sifted(rows: DataFrame, column: str, through: DataFrame) -> DataFrame:
    """rows without most of those whose id in ``column`` isn't in the sieve; every row whose id is stays. Where ids are many, more rows pass
    that a join then drops. A null is no id."""
    return _met(rows.where(F.col(column).isNotNull()), column, through, "inner").where(_hit(column)).drop("__word", "__bits")


def unsifted(rows: DataFrame, column: str, through: DataFrame) -> DataFrame:
    """The other rows: none of their ids is in the sieve."""
    missed = F.col(column).isNull() | F.col("__bits").isNull() | ~_hit(column)
    return _met(rows, column, through, "left").where(missed).drop("__word", "__bits")
