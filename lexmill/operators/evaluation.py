"""Evaluation of predictions: token overlap, breakdowns, deltas, distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import metric_form, once, tokens


def token_overlap(prediction: Column | str, reference: Column | str, form: str) -> Column:
    """Struct of precision, recall, f1 and exact_match by multisets of tokens in a normal form.

    Tokens of both sides are sorted together and read once.
    """

    def common(s: Column) -> Column:
        tagged = lambda side, p: F.transform(side, lambda t: F.struct(t.alias("t"), F.lit(p).alias("p")))
        start = F.struct(F.lit("").alias("t"), *(F.lit(0).alias(c) for c in ("p", "r", "common")))

        def read(s: Column, x: Column) -> Column:
            same = s["t"] == x["t"]
            return F.struct(
                x["t"].alias("t"), (F.when(same, s["p"]).otherwise(0) + x["p"]).alias("p"), (F.when(same, s["r"]).otherwise(0) + 1 - x["p"]).alias("r"),
                (s["common"] + F.when(same, 0).otherwise(F.least(s["p"], s["r"]))).alias("common"),
            )

        both = F.sort_array(F.concat(tagged(s["p"], 1), tagged(s["r"], 0)))
        return F.aggregate(both, start, read, lambda s: s["common"] + F.least(s["p"], s["r"]))

    def ratios(s: Column) -> Column:
        ratio = lambda n: F.when(s["common"] > 0, s["common"] / n).otherwise(0.0)
        return F.struct(ratio(s["n_p"]).alias("precision"), ratio(s["n_r"]).alias("recall"), s["exact_match"].alias("exact_match"))

    def scored(s: Column) -> Column:
        total = s["precision"] + s["recall"]
        f1 = F.when(total > 0, 2 * s["precision"] * s["recall"] / total).otherwise(0.0)
        return F.struct(s["precision"].alias("precision"), s["recall"].alias("recall"), f1.alias("f1"), s["exact_match"].alias("exact_match"))

    texts = F.struct(metric_form(prediction, form).alias("p"), metric_form(reference, form).alias("r"))
    split = once(texts, lambda s: F.struct(tokens(s["p"]).alias("p"), tokens(s["r"]).alias("r"), (s["p"] == s["r"]).cast("int").alias("exact_match")))
    counted = once(split, lambda s: F.struct(common(s).alias("common"), F.size(s["p"]).alias("n_p"), F.size(s["r"]).alias("n_r"), s["exact_match"].alias("exact_match")))
    return once(once(counted, ratios), scored)


def token_f1(df: DataFrame, key: str, prediction: str, reference: str, form: str, *keep: str) -> DataFrame:
    """(key, keep, precision, recall, f1, exact_match) of each row: no shuffle."""
    return df.select(key, *keep, token_overlap(prediction, reference, form).alias("__x")).select(key, *keep, "__x.*")


def grouped_means(df: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """(dimension, value, n, means): over all rows and by each dimension, in one pass."""
    sets = [[], *([b] for b in by)]
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(b) for b in by)).agg(
        F.grouping_id().alias("__g"), F.count("*").alias("n"), *(F.avg(m).alias(f"mean_{m}") for m in metrics)
    )
    everything = 2 ** len(by) - 1
    dim, value = F.lit("all"), F.lit("all")
    for k, b in enumerate(by):
        mine = F.col("__g") == everything - 2 ** (len(by) - 1 - k)
        dim, value = F.when(mine, b).otherwise(dim), F.when(mine, F.col(b).cast("string")).otherwise(value)
    return grouped.select(dim.alias("dimension"), value.alias("value"), "n", *(f"mean_{m}" for m in metrics))


def change_counts(df: DataFrame, delta: Column, by: str) -> DataFrame:
    return df.groupBy(by).agg(
        F.count_if(delta > 0).alias("improved"), F.count_if(delta < 0).alias("regressed"), F.count_if(delta == 0).alias("unchanged"),
        F.avg(delta).alias("mean_delta"),
    )


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def first_per_group(df: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= k)


def distribution(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, percent) of all rows."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def combinations(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, n): by each dimension alone and all together, in one pass; others are null."""
    sets = [*([F.col(b)] for b in by), [F.col(b) for b in by]]
    return df.groupingSets(sets, *(F.col(b) for b in by)).agg(F.count("*").alias("n"))


def missing_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, missing, total): nulls and blank strings."""
    gone = lambda f: F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == "")
    row = df.agg(F.count("*").alias("__n"), *(F.count_if(gone(f)).alias(f) for f in fields))
    return row.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("missing"), F.col("__n").alias("total")) for f in fields))).alias("x")).select("x.*")


def describe(df: DataFrame, value: str, by: str) -> DataFrame:
    """Minimum, quartiles, 95th percentile (all interpolated linearly), mean and maximum.

    Values are counted first, so that a group's quantiles need a row a value.
    """
    counts = df.groupBy(by, value).agg(F.count("*").alias("__n"))
    q = [F.percentile(value, p, F.col("__n")).alias(f"p{int(100 * p)}") for p in (0.25, 0.5, 0.75, 0.95)]
    return counts.groupBy(by).agg(
        F.sum("__n").alias("n"), F.min(value).alias("minimum"), *q, (F.sum(F.col(value) * F.col("__n")) / F.sum("__n")).alias("mean"), F.max(value).alias("maximum")
    )


def over_limits(df: DataFrame, value: str, limits: list[int], by: str) -> DataFrame:
    """(by, n, over_L, percent_over_L) for each limit."""
    out = [F.count("*").alias("n")]
    for x in limits:
        n = F.count_if(F.col(value) > x)
        out += [n.alias(f"over_{x}"), (100 * n / F.count("*")).alias(f"percent_over_{x}")]
    return df.groupBy(by).agg(*out)


def matrix(df: DataFrame, row: str, column: str, columns: list[int]) -> DataFrame:
    """Counts of row by column values; the columns are a stated list, missing cells 0."""
    cells = [F.count_if(F.col(column) == c).alias(f"{column}_{c}") for c in columns]
    return df.groupBy(row).agg(*cells)


def accuracy(df: DataFrame, correct: Column, valid: Column) -> DataFrame:
    """(n, n_valid, n_correct, of_valid, of_all)."""
    n, v, c = F.count("*"), F.count_if(valid), F.count_if(valid & correct)
    return df.agg(n.alias("n"), v.alias("n_valid"), c.alias("n_correct"), F.when(v > 0, c / v).alias("of_valid"), F.when(n > 0, c / n).alias("of_all"))


def best_step(df: DataFrame, run: str, step: str, loss: str) -> DataFrame:
    """(run, step, loss) of the smallest loss, the first of equals."""
    best = F.min(F.struct(F.col(loss).alias("l"), F.col(step).alias("s")))
    return df.where(F.col(loss).isNotNull()).groupBy(run).agg(best.alias("b")).select(run, F.col("b.s").alias(step), F.col("b.l").alias(loss))


def running_mean(df: DataFrame, by: str, value: str, *order: Column) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running_mean", F.avg(value).over(w))


def union_tagged(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """All rows with the name of the part they come from; missing columns are null."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def training_curves(log: DataFrame, run: str) -> DataFrame:
    """(run, step, metric, value) from a log of steps with loss, eval_loss and learning_rate."""
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("loss", "eval_loss", "learning_rate")))
    return log.select(run, "step", F.explode(each).alias("x")).select(run, "step", "x.metric", "x.value").where("value is not null")
