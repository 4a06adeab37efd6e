"""Exact top-k inner-product search, score at a time.

Vectors become integers floor(scale * x). A shard of them is indexed by postings:
for each class of impact (the magnitude's power of two) and each dimension the
vectors with such a component there, and the components. For a block of queries
the classes are processed from the highest impact down, posting list by posting
list; after each class a pair's score lies within its partial score plus or
minus the product of the query's norm and the norm of what is left of the
vector. A shard stops as soon as these bounds prove, for every query of the
block, that only a few vectors can still be among its k best; those are rescored
exactly, all others are ruled out. Without a proof it goes on to the last class,
after which the scores are exact.

Vectors are dealt over shards of a bounded number of components and stay there;
the queries go to every shard and are streamed through it in blocks, and each
shard gives k candidates a query. Vectors that are null or hold a null or
non-finite component take no part, nor do rows without an id; a shorter vector
counts as padded with zeros. Scores that may not fit 64 bits are an error. Equal
scores go to the smaller id. Rows that repeat a query's id are one query, with
the least of their vectors in the order of bytes, and candidates as often as
they occur; a query's own id is never in its result. Empty tables give no rows;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import cut

#: Most components of a shard, fewest vectors where cores are idle, and queries of a block.
SHARD_CELLS, LEAST_VECTORS, QUERY_BLOCK = 1 << 21, 4096, 256
_TYPES = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}


def packed(x: np.ndarray) -> bytes:
    """Integers in the fewest bytes each, behind that number."""
    most = np.abs(x).max(initial=0)
    size = next(n for n in _TYPES if n == 8 or most < 2 ** (8 * n - 1))
    return bytes([size]) + x.astype(_TYPES[size]).tobytes()


def _packed(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """(id, vec, width): packed integer components; rows without a valid vector are left out."""
    for batch in batches:
        ids, out, width = [], [], []
        for k, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = v.values if v.is_valid else None
            if k is None or own is None or own.null_count:
                continue
            x = own.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(x).all():
                x = np.floor(scale * x)
                if np.abs(x).max(initial=0) >= 2.0**62:
                    raise OverflowError(f"a component of vector {k} is beyond 64 bits")
                ids.append(k)
                out.append(packed(x.astype(np.int64)))
                width.append(len(x))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(width, pa.int64())], ["id", "vec", "width"])


def matrix(vecs: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(vecs), width), np.int64)
    for row, v in zip(out, vecs, strict=True):
        own = np.frombuffer(v, _TYPES[v[0]], offset=1)
        row[: len(own)] = own
    return out


class Shard:
    """Posting segments of some vectors, by falling class of impact."""

    def __init__(self, ids: np.ndarray, v: np.ndarray) -> None:
        self.ids, self.v = ids, v
        size = np.abs(v)
        self.most = float(size.max(initial=0))
        impact = np.frexp(size.astype(np.float64))[1]  # 0: no component, and no posting
        #: For each class its postings (dimension, vectors, components), and the norms of what is left after it.
        self.segments: list[tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]] = []
        for c in range(int(impact.max(initial=0)), 0, -1):
            dim, row = np.nonzero((impact == c).T)
            if not len(dim):
                continue
            cuts = np.flatnonzero(dim[1:] != dim[:-1]) + 1
            lists = [(int(dim[part[0]]), row[part], v[row[part], dim[part[0]]]) for part in np.split(np.arange(len(dim)), cuts)]
            left = np.where(impact < c, v, 0).astype(np.float64)
            self.segments.append((lists, np.sqrt((left**2).sum(1))))

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query rows, vector rows and scores of each query's k best in this shard, and ties of the last."""
        most = float(np.abs(q).max(initial=0)) * self.most * q.shape[1]
        if most >= 2.0**63:
            raise OverflowError("scores may not fit 64 bits")
        # the fastest type in which sums of products are exact
        kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
        n, weight = len(self.ids), np.ascontiguousarray(q.T.astype(kind))
        own = np.nonzero(self.ids[:, None] == q_ids[None, :])  # all of a query's own rows, however often stored
        partial = np.zeros((n, len(q)), kind)
        norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        lowest = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
        for lists, left in self.segments:
            for dim, rows, impact in lists:
                partial[rows] += impact.astype(kind)[:, None] * weight[dim][None, :]
            if not left.any():
                break
            # a proof is out of reach while what is left outweighs the best score
            if n <= 4 * k or left.max() * norm.max() > partial.max():
                continue
            slack = left[:, None] * norm[None, :] * (1 + 1e-9) + 1e-6
            least = partial - slack
            least[own] = -np.inf
            kth = np.partition(least, n - k, axis=0)[n - k]
            possible = partial + slack >= kth
            possible[own] = False
            if possible.sum(0).max() <= max(4 * k, n // 16):  # nothing else can be among the best
                col, row = np.nonzero(possible)
                return self._best(row, col, np.einsum("ij,ij->i", q[row], self.v[col]), len(q), k)
        if n > k:
            partial[own] = lowest
            kth = np.partition(partial, n - k, axis=0)[n - k]
            col, row = np.nonzero(partial >= kth)
        else:
            col, row = np.divmod(np.arange(len(q) * n), max(len(q), 1))
        other = q_ids[row] != self.ids[col]
        row, col = row[other], col[other]
        return self._best(row, col, partial[col, row].astype(np.int64), len(q), k)

    def _best(self, row: np.ndarray, col: np.ndarray, score: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((self.ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        keep = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row] < k
        return row[keep], col[keep], score[keep]


def _searched(batches: Iterator[pa.RecordBatch], width: int, k: int, block: int) -> Iterator[pa.RecordBatch]:
    """Candidates (query_id, vec_id, score) of rows (shard, asks, id, vec): of each shard first its vectors, then the queries."""
    name, index = None, None
    ids: list[int] = []
    vecs: list[bytes] = []

    def answers() -> pa.RecordBatch:
        q_ids = np.array(ids, np.int64)
        row, col, score = index.search(q_ids, matrix(vecs, width), k)
        ids.clear(), vecs.clear()
        return pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(index.ids[col]), pa.array(score)], ["query_id", "vec_id", "score"])

    for batch in batches:
        for shard, asks, id_, vec in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if shard != name:
                if index and ids:
                    yield answers()
                name, index = shard, None
                ids.clear(), vecs.clear()
            if asks and index is None:
                index = Shard(np.array(ids, np.int64), matrix(vecs, width))
                ids.clear(), vecs.clear()
            ids.append(id_), vecs.append(vec)
            if index and len(ids) == block:
                yield answers()
    if index and ids:
        yield answers()


def top_k(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, scale: float = 64.0,
    shard_cells: int = SHARD_CELLS, block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with an id divisible by `every`, its k best other rows."""
    src = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    vecs = cut(src.mapInArrow(lambda it: _packed(it, scale), "id long, vec binary, width long"))
    n, width = vecs.agg(F.count("*"), F.max("width")).first()
    width = max(width or 0, 1)
    # a shard for each core while shards are not small
    shards = max(1, -(-n * width // shard_cells), min(df.sparkSession.sparkContext.defaultParallelism, n // LEAST_VECTORS))
    # rows are dealt by their place in the written table, so that many rows of one id are no single shard
    drawn = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    held = vecs.select(drawn.alias("shard"), F.lit(0).alias("asks"), "id", "vec")
    queries = vecs.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vec").alias("vec"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asks"), "id", "vec")
    # with a number, so that few bytes aren't brought together in few tasks: the work is in the products
    rows = held.union(asked).repartition(2 * shards, "shard").sortWithinPartitions("shard", "asks", "id")
    found = rows.mapInArrow(lambda it: _searched(it, width, k, block), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
