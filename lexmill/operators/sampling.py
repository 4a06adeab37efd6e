"""Quotas, reproducible samples and splits.

Order is by the hash of seed and id. Exact ranks within a stratum come in two
steps, so that a stratum of any size is dealt over many tasks: rows are counted
by stratum and leading hash digits, and a row's rank is the count before its
bucket plus its place in it.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import seeded

SPLITS = ("train", "validation", "test")
#: Decimal, so that quotas are computed exactly.
TRAIN, VALIDATION = Decimal("0.8"), Decimal("0.1")


def ranked(df: DataFrame, strata: list[str], key: str, seed: int, digits: int = 3) -> DataFrame:
    """`df` with __rank: exact place in its stratum in the order of the seeded hash, from 1. No id counts as an empty one."""
    h = df.withColumn("__h", F.coalesce(seeded(seed, key), seeded(seed, F.lit("")))).withColumn("__b", F.substring("__h", 1, digits))
    counts = h.groupBy(*strata, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*strata).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    counts = counts.withColumnsRenamed({c: f"__c_{c}" for c in [*strata, "__b"]})
    on = [F.col(s).eqNullSafe(F.col(f"__c_{s}")) for s in strata] + [F.col("__b") == F.col("__c___b")]
    joined = h.join(counts, on).drop(*(f"__c_{c}" for c in [*strata, "__b"]))
    own = Window.partitionBy(*strata, "__b").orderBy("__h", key)
    return joined.withColumn("__rank", F.row_number().over(own) + F.col("__before")).drop("__h", "__b", "__before")


def sample(df: DataFrame, key: str, n: int, seed: int, strict: bool = False) -> DataFrame:
    """n rows, the same ones for the same seed; if strict, fewer are an error."""
    if strict and (have := df.limit(n).count()) < n:
        raise ValueError(f"a sample of {n} from {have} rows")
    return df.orderBy(seeded(seed, key), key).limit(n)


def _largest(df: DataFrame, share: Column, total: Column, order: list[Column], room: Column | None = None, name: str = "quota") -> DataFrame:
    """Whole shares plus one for the first strata in `order`, up to `total`; df is a small table of strata."""
    base = F.floor(share) if room is None else F.least(F.floor(share), room)
    df = df.withColumn("__base", base).withColumn("__frac", share - F.floor(share))
    everything = Window.partitionBy()
    open_ = F.lit(True) if room is None else room > F.col("__base")
    df = df.withColumns({"__left": total - F.sum("__base").over(everything), "__open": open_})
    place = F.row_number().over(Window.partitionBy("__open").orderBy(*order))
    more = F.when(F.col("__open") & (place <= F.col("__left")), 1).otherwise(0)
    return df.withColumn(name, (F.col("__base") + more).cast("long")).drop("__base", "__frac", "__left", "__open")


def split_quotas(counts: DataFrame, strata: list[str], train: Decimal | float = TRAIN, validation: Decimal | float = VALIDATION) -> DataFrame:
    """(strata, n, train, validation, test): largest remainders twice, the rest is test; totals are exact.

    Equal remainders go to the smaller stratum. With shares of type float they are computed in doubles, whose
    rounding tells equal remainders apart.
    """
    n = F.col("n")
    df = counts.withColumn("__all", F.sum("n").over(Window.partitionBy()))
    order = [F.desc("__frac"), *strata]
    df = _largest(df, n * F.lit(train), F.round(F.col("__all") * F.lit(train)), order, name="train")
    df = _largest(df, n * F.lit(validation), F.round(F.col("__all") * F.lit(validation)), order, room=n - F.col("train"), name="validation")
    return df.withColumn("test", n - F.col("train") - F.col("validation")).drop("__all")


def proportional_quotas(counts: DataFrame, label: str, size: int, ties: str = "label") -> DataFrame:
    """(label, n, quota) for a sample of `size`. Equal remainders go to the smaller label, or with
    ties="count" to the larger count, then the larger label."""
    share = F.lit(size) * F.col("n") / F.sum("n").over(Window.partitionBy())
    order = [F.desc("__frac"), F.asc(label)] if ties == "label" else [F.desc("__frac"), F.desc("n"), F.desc(label)]
    return _largest(counts.withColumn("__share", share), F.col("__share"), F.lit(size), order).drop("__share")


def _quota_join(df: DataFrame, quotas: DataFrame, strata: list[str], names: list[str]) -> DataFrame:
    """Quota columns at each row; quotas has a row a stratum, null being one."""
    own = quotas.select(*(F.col(s).alias(f"__q_{s}") for s in strata), *(F.col(n).alias(f"__q_{n}") for n in names))
    joined = df.join(own, [F.col(s).eqNullSafe(F.col(f"__q_{s}")) for s in strata])
    return joined.drop(*names, *(f"__q_{s}" for s in strata)).withColumnsRenamed({f"__q_{n}": n for n in names})


def stratified_split(
    df: DataFrame, strata: list[str], key: str, seed: int, train: Decimal | float = TRAIN, validation: Decimal | float = VALIDATION
) -> DataFrame:
    """`df` with split: train, validation and test in each stratum by its quotas."""
    quotas = split_quotas(df.groupBy(*strata).agg(F.count("*").alias("n")), strata, train, validation)
    r = _quota_join(ranked(df, strata, key, seed), quotas, strata, ["train", "validation"])
    split = F.when(F.col("__rank") <= F.col("train"), "train").when(F.col("__rank") <= F.col("train") + F.col("validation"), "validation")
    return r.withColumn("split", split.otherwise("test")).drop("__rank", "train", "validation")


def require_complete(df: DataFrame, split: DataFrame, key: str) -> DataFrame:
    """`split`, or an error if it isn't `df` once over: a row lost, repeated or in two splits."""
    tally = lambda x, sign: x.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).select("k", (F.col("n") * sign).alias("n"))
    uneven = tally(df, 1).union(tally(split, -1)).groupBy("k").agg(F.sum("n").alias("n")).where("n <> 0")
    if n := uneven.count():
        raise ValueError(f"{n} ids are not split once over")
    twice = split.groupBy(key).agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").count()
    if twice:
        raise ValueError(f"{twice} ids are in several splits")
    return split


def split_conformance(df: DataFrame, strata: list[str], train: Decimal | float = TRAIN, validation: Decimal | float = VALIDATION) -> DataFrame:
    """(strata, split, expected, actual) of every stratum and split."""
    quotas = split_quotas(df.groupBy(*strata).agg(F.count("*").alias("n")), strata, train, validation)
    expected = quotas.select(*strata, F.explode(F.create_map(*(x for s in SPLITS for x in (F.lit(s), F.col(s))))).alias("split", "expected"))
    actual = df.groupBy(*strata, "split").agg(F.count("*").alias("actual"))
    both = expected.withColumn("actual", F.lit(0).cast("long")).union(actual.select(*strata, "split", F.lit(0).cast("long"), "actual"))
    return both.groupBy(*strata, "split").agg(F.sum("expected").alias("expected"), F.sum("actual").alias("actual"))


def stratified_sample(df: DataFrame, label: str, key: str, size: int, seed: int) -> DataFrame:
    """`size` rows by proportional quotas, by hash order within each label."""
    quotas = proportional_quotas(df.groupBy(label).agg(F.count("*").alias("n")), label, size)
    r = _quota_join(ranked(df, [label], key, seed), quotas, [label], ["quota"])
    return r.where(F.col("__rank") <= F.col("quota")).drop("__rank", "quota")


def stratified_top(df: DataFrame, label: str, key: str, score: str, size: int, seed: int) -> DataFrame:
    """`size` rows by proportional quotas, the best scores of each label, ties by hash; with place."""
    quotas = proportional_quotas(df.groupBy(label).agg(F.count("*").alias("n")), label, size, ties="count")
    best = Window.partitionBy(label).orderBy(F.desc(score), seeded(seed, key), F.col(key))
    r = df.withColumn("place", F.row_number().over(best)).where(F.col("place") <= size)  # a limit before the sort of each label
    return _quota_join(r, quotas, [label], ["quota"]).where(F.col("place") <= F.col("quota")).drop("quota")


def group_split(df: DataFrame, group: Column, key: str, label: str, score: str, validation: int, train: int, seed: int) -> DataFrame:
    """Validation rows first, then training rows among those whose group has none; with split."""
    keyed = df.withColumn("__g", F.sha2(group, 256))
    val = stratified_top(keyed, label, key, score, validation, seed)
    rest = keyed.join(val.select("__g").distinct(), "__g", "left_anti")
    tr = stratified_top(rest, label, key, score, train, seed + 1)
    both = val.withColumn("split", F.lit("validation")).unionByName(tr.withColumn("split", F.lit("train")))
    return both.drop("__g", "place")


def fingerprint(df: DataFrame, split: str, key: str) -> DataFrame:
    """(split, fingerprint): digest of each split's digests of ordered ids.

    Ids are digested in ranges first, so no task holds all ids of a split. Rows without an id don't count; a split of
    only such rows has none.
    """
    part = F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 4)
    digest = lambda xs: F.when(F.size(xs) > 0, F.sha2(F.array_join(xs, ","), 256))
    parts = df.groupBy(split, part.alias("__p")).agg(digest(F.array_sort(F.collect_list(key)).cast("array<string>")).alias("d"))
    known = F.collect_list(F.when(F.col("d").isNotNull(), F.struct("__p", "d")))
    return parts.groupBy(split).agg(digest(F.transform(F.array_sort(known), lambda x: x["d"])).alias("fingerprint"))
