"""Small helpers of the operators in this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.session import cut, table

__all__ = ["cut", "table", "small_batches", "release", "whole_runs", "looked_up", "bit_filter", "passes", "components"]

#: Rows of an Arrow batch of whole documents; bounds a Python worker's memory.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches of whole texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release() -> None:
    """Give memory that a Python worker no longer uses back to the system; workers are kept and do other work next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def whole_runs(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole runs of rows that agree in the first k columns, with the runs' starts; the rows come in order."""
    left = None
    for batch in batches:
        if left is not None:
            batch = pa.concat_batches([left, batch])
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in batch.columns[:k]:
            x = c.to_numpy(zero_copy_only=False)
            change[1:] |= x[1:] != x[:-1]
        starts = np.flatnonzero(change)
        if len(starts) > 1:
            yield batch.slice(0, starts[-1]), starts[:-1]
        left = batch.slice(starts[-1])
    if left is not None:
        yield left, np.zeros(1, np.int64)


#: Bits of the filter in looked_up; its broadcast has at most one row for 64 of them.
FILTER_BITS = 1 << 24


def looked_up(src: DataFrame, wanted: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """`src` joined with `wanted` (how: inner or left) on columns that both have, nulls being equal; no other names may be common.

    Most rows that `wanted` lacks are kept out of the shuffle by a bit filter,
    whose broadcast is bounded by FILTER_BITS / 64 rows whatever the size of
    `wanted`; the more is wanted, the more rows pass the filter.
    """
    wanted = cut(wanted)
    place = F.pmod(F.xxhash64(*on), F.lit(FILTER_BITS))
    words = wanted.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bits"))
    words = words.select(F.col("word").alias("__filter_word"), F.col("bits").alias("__filter_bits"))
    tried = src.withColumn("__filter_place", place).join(F.broadcast(words), F.shiftright("__filter_place", 6) == F.col("__filter_word"), "left")
    tried = tried.withColumn("__filter_passed", F.expr("coalesce(bit_get(__filter_bits, cast(__filter_place & 63 as int)) = 1, false)"))
    tried = tried.drop("__filter_place", "__filter_word", "__filter_bits")
    other = wanted.withColumnsRenamed({c: f"__wanted_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"__wanted_{c}")) for c in on]
    joined = tried.where("__filter_passed").drop("__filter_passed").join(other, same, how).drop(*(f"__wanted_{c}" for c in on))
    if how == "inner":
        return joined
    rest = tried.where("not __filter_passed").drop("__filter_passed")
    return joined.unionByName(rest, allowMissingColumns=True)


def bit_filter(hashes: DataFrame, bits: int):
    """A broadcast bitmap of the hashes (column h of longs); its size is `bits`, however many there are."""
    place = F.col("h").bitwiseAND(bits - 1)
    words = hashes.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bits"))
    got = words.toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes a bit filter lets through: all that it was made of, and a few others."""
    place = hashes & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0


#: Edges of a node beyond which they are dealt over several tasks.
HOT_EDGES = 1_000_000


def components(edges: DataFrame, most_rounds: int = 60, hot_edges: int = HOT_EDGES) -> DataFrame:
    """Smallest node reachable from each node: (node, component) of undirected edges (a, b).

    Alternates the large-star and small-star steps until each node has one edge,
    to a node that has none to a smaller one. A step sees a node's edges in one
    task; those of a node with more than `hot_edges` are dealt over several, which
    the large-star step gives the node's smallest neighbour, counted before. Only
    such nodes, few, reach the driver. Nodes without an edge are not listed.
    """
    edges = edges.where(F.col("a") != F.col("b"))
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def lowest(rows: DataFrame, hot: list) -> DataFrame:
        """Distinct rows (u, v) with m, the smallest v of a u's share."""
        share = F.lit(0)
        for node, count, _ in hot:
            share = F.when(F.col("u") == node, F.pmod(F.xxhash64("v"), F.lit(-(-count // hot_edges))).cast("int")).otherwise(share)
        dealt = rows.withColumn("share", share).repartition("u", "share").dropDuplicates(["u", "share", "v"])
        return dealt.withColumn("m", F.min("v").over(Window.partitionBy("u", "share")))

    for _ in range(most_rounds):
        ends = e.select(F.col("u").alias("node"), "v", F.lit(1).alias("up")).union(e.select(F.col("v").alias("node"), F.lit(None).cast("long"), F.lit(0)))
        nodes = ends.groupBy("node").agg(F.count("*").alias("n"), (F.min("up") != F.max("up")).alias("inner"), F.min("v").alias("low"), F.max("v").alias("high"))
        state = nodes.agg(
            F.max(F.col("inner") | F.coalesce(F.col("low") != F.col("high"), F.lit(False))).alias("open"),
            F.collect_list(F.when(F.col("n") > hot_edges, F.struct("node", "n", "low"))).alias("hot"),
        ).first()
        if not state["open"]:
            break
        hot = [(r["node"], r["n"], r["low"]) for r in state["hot"]]
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = lowest(both, hot)
        for node, _, low in hot:
            large = large.withColumn("m", F.when(F.col("u") == node, F.lit(node if low is None else low)).otherwise(F.col("m")))
        large = large.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        small = lowest(large, hot)
        parts = F.array(F.when(F.col("v") != F.col("m"), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))), F.struct("u", F.col("m").alias("v")))
        e = cut(small.select(F.explode(parts).alias("x")).where("x is not null").select("x.u", "x.v"))
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
