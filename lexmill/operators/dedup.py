"""Keep-first deduplication, duplicate groups and keyed lookups.

Texts are compared by hash, so shuffles move keys rather than documents, and
groups are pre-aggregated before the shuffle: a key of any frequency costs one
row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The row with the smallest `order` (unique) of each key, a null key being one.

    Rows without an order can't be compared: they stay, and are nobody's first.
    """
    first = df.select(F.sha2(key, 256).alias("__k"), F.col(order).alias("__o")).groupBy("__k").agg(F.min("__o").alias(order))
    return df.where(F.col(order).isNotNull()).join(first.select(order), order, "left_semi").unionByName(df.where(F.col(order).isNull()))


def keep_last(df: DataFrame, key: str, order: Column) -> DataFrame:
    """The row with the largest `order` of each key, as a lookup that later rows overwrite."""
    rest = [c for c in df.columns if c != key]
    last = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return last.select(key, *(F.col(f"__row.{c}").alias(c) for c in rest))


def duplicate_groups(df: DataFrame, key: Column, order: str) -> DataFrame:
    """(key_hash, n, first) of the keys that occur more than once."""
    return df.groupBy(F.sha2(key, 256).alias("key_hash")).agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1")


def duplicate_reasons(df: DataFrame, first_key: Column, second_key: Column, order: str) -> DataFrame:
    """`df` with duplicate_reason: duplicate_id for later rows of the first key, else duplicate_pair
    for later rows of the second."""
    keyed = df.withColumns({"__a": F.sha2(first_key, 256), "__b": F.sha2(second_key, 256)})
    a = keyed.groupBy("__a").agg(F.min(order).alias("__x")).select(F.col("__x").alias(order), F.lit(True).alias("__first_a"))
    b = keyed.groupBy("__b").agg(F.min(order).alias("__y")).select(F.col("__y").alias(order), F.lit(True).alias("__first_b"))
    joined = df.join(a, order, "left").join(b, order, "left")
    reason = F.when(F.col("__first_a").isNull(), "duplicate_id").when(F.col("__first_b").isNull(), "duplicate_pair")
    return joined.withColumn("duplicate_reason", reason).drop("__first_a", "__first_b")


def duplicate_records(df: DataFrame, record: Column) -> DataFrame:
    """(n_rows, n_distinct): a gate on exact duplicates of whole records."""
    counted = df.groupBy(record.alias("__r")).count()
    return counted.agg(F.sum("count").alias("n_rows"), F.count("*").alias("n_distinct"))


def require_distinct(df: DataFrame, record: Column) -> DataFrame:
    """`df`, or an error at run time if a record occurs twice."""
    n = duplicate_records(df, record).first()
    if (n["n_rows"] or 0) != n["n_distinct"]:
        raise ValueError(f"{n['n_rows'] - n['n_distinct']} duplicate records")
    return df


def require_known(df: DataFrame, key: Column, order: str, known: list[Column]) -> DataFrame:
    """The first row of each key, or an error if keys repeat and none of them is a known one."""
    repeated = duplicate_groups(df, key, order)
    expected = F.array(*(F.sha2(k, 256) for k in known)) if known else F.array().cast("array<string>")
    row = repeated.agg(F.count("*").alias("n"), F.count_if(F.array_contains(expected, F.col("key_hash"))).alias("known")).first()
    if row["n"] and not row["known"]:
        raise ValueError(f"{row['n']} unexpected duplicates")
    return keep_first(df, key, order)


def require_count(df: DataFrame, expected: int) -> DataFrame:
    if (n := df.count()) != expected:
        raise ValueError(f"{n} rows instead of {expected}")
    return df
