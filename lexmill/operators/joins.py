"""Lookups of predictions and records by id, and by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import strip
from lexmill.operators.dedup import keep_last


def lookup(left: DataFrame, right: DataFrame, key: str, order: Column) -> DataFrame:
    """Rows of both sides with equal ids; of the right side's rows of an id the last by `order`."""
    return left.join(keep_last(right, key, order), key)


def strict_lookup(left: DataFrame, right: DataFrame, key: str, order: Column) -> DataFrame:
    """As lookup, but the query fails at the first id that the right side lacks."""
    last = keep_last(right, key, order).withColumn("__there", F.lit(True))
    joined = left.join(last, key, "left")
    checked = F.when(F.col("__there"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no row for "), F.col(key).cast("string"))))
    return joined.withColumn(key, checked).drop("__there")


def differing(reference: DataFrame, first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """(key, first, second, reference columns) where two sides' values of an id differ but for outer white space."""
    a = first.select(key, F.col(value).alias("first_value"))
    b = second.select(key, F.col(value).alias("second_value"))
    return reference.join(a, key).join(b, key).where(strip("first_value") != strip("second_value"))


def by_position(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """Rows of equal position; the order column numbers both sides."""
    return left.join(right, order)
