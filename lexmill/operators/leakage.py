"""Leakage between data sets: anti-joins and overlap counts on hashed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hashed(df: DataFrame, key: Column, name: str = "k") -> DataFrame:
    return df.select(F.sha2(key, 256).alias(name)).distinct()


def without_leaks(df: DataFrame, key: Column, other: DataFrame, other_key: Column) -> DataFrame:
    """Rows whose key isn't one of the other set."""
    return df.withColumn("__k", F.sha2(key, 256)).join(hashed(other, other_key, "__k"), "__k", "left_anti").drop("__k")


def leak_flag(df: DataFrame, key: Column, other: DataFrame, other_key: Column, flag: str) -> DataFrame:
    """`df` with a flag of whether its key is one of the other set."""
    keys = hashed(other, other_key, "__k").withColumn(flag, F.lit(True))
    return df.withColumn("__k", F.sha2(key, 256)).join(keys, "__k", "left").withColumn(flag, F.coalesce(flag, F.lit(False))).drop("__k")


def overlap_matrix(df: DataFrame, name: Column, key: Column) -> DataFrame:
    """(left_set, right_set, n_shared): distinct keys that two named sets share; pairs without any aren't listed.

    A key's sets are gathered first; they are as few as there are names, so pairs stay few.
    """
    sets = df.groupBy(F.sha2(key, 256).alias("k")).agg(F.array_sort(F.collect_set(name)).alias("names")).where(F.size("names") > 1)
    pairs = F.flatten(
        F.transform("names", lambda a, i: F.transform(F.slice("names", i + 2, F.size("names")), lambda b: F.struct(a.alias("left_set"), b.alias("right_set"))))
    )
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.left_set", "p.right_set").agg(F.count("*").alias("n_shared"))


def set_relation(left: DataFrame, right: DataFrame) -> DataFrame:
    """(relation, n): sizes of union, intersection and differences of two one-column key sets."""
    a, b = left.distinct().toDF("k"), right.distinct().toDF("k")
    both = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), "k", "full")
    kind = F.when(F.col("l").isNull(), "right_only").when(F.col("r").isNull(), "left_only").otherwise("both")
    counts = both.groupBy(kind.alias("relation")).agg(F.count("*").alias("n"))
    return counts.union(both.agg(F.lit("union").alias("relation"), F.count("*").alias("n")))


def selected(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a wanted id, and the wanted ids that no row has."""
    return df.join(ids, key, "left_semi"), ids.join(df.select(key), key, "left_anti")
