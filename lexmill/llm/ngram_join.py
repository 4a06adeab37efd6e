"""Near-duplicate documents: Jaccard join of word n-gram sets over count vectors.

A document's set is its distinct n-word shingles as 64-bit hashes; fewer words
make one shingle of the whole sequence, no words an empty set that is linked
with nothing. Sets are equal as texts of words are: equal sets are one class.

1. Tokens (shingles) are hashed into groups. Two linked sets differ in at most
   d shingles, so of any d + 1 filled groups one is equal in both: each set goes
   to the trees named by (size level, group, contents) of its first d + 1 filled
   groups, d being the most for the sizes it can meet there, and any two linked
   sets meet in a tree. Trees of the same members are one; a tree of many members
   is dealt out in blocks.
2. The members of a tree are points: count vectors, tokens per group, of a length
   that follows the set's size and can be folded to a shorter one. Two sets share
   at most the sum of the smaller counts. An R-tree over the points bounds the
   overlap of anything below two nodes by the smaller upper limits; node pairs
   that can't reach the needed overlap, or lie in one component, are left out. A
   task gives only a spanning forest of what passes, never the pairs of a group.
3. The forests' edges are verified on the sets. Where an edge of a tree fails and
   its ends stay apart, the tree's members that can still be linked to another
   component are compared on the sets themselves, each surviving pair verified.
4. Trees of several blocks that hold several components after that are treated
   alike over every two blocks.
Components come from star contraction on the cluster. Ties go to the smallest
id; repeated rows are copies; null, empty and blank texts have empty sets; rows
without an id take part, and a class of such rows alone has no component id; a
text of any length is used whole; an empty table gives no rows; columns other
than the key and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.bytescan import LOWER, U64, blocks, byte_class, mix, word_hashes
from lexmill.llm.common import components, cut, looked_up, small_batches, whole_runs

#: [^\x20\x09-\x0D]
WORD_BYTES = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Fewest coordinates of a count vector, and tokens per coordinate otherwise.
DIMS, PER_DIM = 16, 2
#: Members of a tree's block, and their tokens (sets of so many tokens fit a worker).
BLOCK_ROWS, BLOCK_TOKENS = 2048, 1 << 22
#: Members of an R-tree's leaf and inner node.
LEAF, FANOUT = 32, 8
#: Members of a star that are verified in one task.
STAR = 1024
#: A tree with this share of all rows at least is dealt over tasks before it is gathered; one row in SEEN is looked at.
HOT_SHARE, SEEN = 1 / 200, 64
_MULT = np.random.default_rng(7).integers(1, 2**63, 64, dtype=U64) | U64(1)
_LEVELS = np.unique(np.floor(1.6 ** np.arange(0, 88)).astype(np.int64))


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order."""
    for _, _, buf, offs in blocks(column):
        w, at = word_hashes(LOWER[buf], offs, WORD_BYTES)
        grams = w[: max(0, len(w) - n + 1)] * _MULT[0]
        for k in range(1, n):
            grams = grams + w[k : k + len(grams)] * _MULT[k]
        grams = mix(grams)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= n:
                own = np.sort(grams[a : b - n + 1])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif b > a:
                yield mix((w[a:b] * _MULT[1 : b - a + 1]).sum(keepdims=True) + U64(b - a))
            else:
                yield np.zeros(0, U64)


def set_id(own: np.ndarray) -> int:
    """An id of a set's contents."""
    return int(mix(mix(own + _MULT[40]).sum(keepdims=True) + _MULT[41:42] * U64(len(own)))[0].astype(np.int64))


def keys(own: np.ndarray, num: int, den: int) -> np.ndarray:
    """Names of a set's trees at similarity num/den; the lowest seven bits are the size level."""
    n = len(own)
    out = []
    first, last = np.searchsorted(_LEVELS, n), np.searchsorted(_LEVELS, n * den // num)
    running = np.zeros(n + 1, U64)
    np.cumsum(mix(own + _MULT[42]), out=running[1:])
    for level in range(first, last + 1):
        differ = (den - num) * 2 * int(_LEVELS[level]) // (den + num)
        groups = differ + 1 + (differ + 9) // 10
        limits = np.searchsorted((own >> U64(32)) * U64(groups) >> U64(32), np.arange(groups + 1, dtype=U64))
        total = running[limits[1:]] - running[limits[:-1]]
        name = np.arange(groups, dtype=U64) * _MULT[43] + _MULT[44:45] * U64(level)
        key = mix(total + name) & ~U64(127) | U64(level)
        # the largest set that this one can be linked with, and meets on this level first
        other = min(int(_LEVELS[level]), n * den // num)
        most = (den - num) * (n + other) // (den + num)
        # of two linked sets' first most + 1 filled groups one is common; a set with fewer sends its empty ones too
        filled = np.flatnonzero(limits[1:] > limits[:-1])
        out.append(key[filled[: most + 1]] if len(filled) > most else key)
    return np.concatenate(out)


def block_size(level: np.ndarray, rows: int, tokens: int) -> np.ndarray:
    """Members of a block in trees of these size levels."""
    return np.clip(tokens // _LEVELS[level], 4, rows)


def count_vector(own: np.ndarray) -> bytes:
    """Counts of a set's tokens in a power of two of groups: half a byte each, behind a 0, or four bytes behind a 1."""
    dims = DIMS
    while dims * PER_DIM < len(own) and dims < 1 << 16:
        dims *= 2
    counts = np.bincount((own & U64(dims - 1)).astype(np.int64), minlength=dims)
    if counts.max() > 15:
        return b"\1" + counts.astype(np.uint32).tobytes()
    return b"\0" + (counts[::2] | counts[1::2] << 4).astype(np.uint8).tobytes()


def folded(vectors: list[bytes]) -> np.ndarray:
    """Count vectors as rows of the length of the shortest."""
    if all(v[:1] == b"\0" for v in vectors) and len({*map(len, vectors)}) == 1:
        packed = np.frombuffer(b"".join(vectors), np.uint8).reshape(len(vectors), -1)[:, 1:]
        return np.stack([packed & 15, packed >> 4], -1).reshape(len(vectors), -1)
    counts = []
    for v in vectors:
        packed = np.frombuffer(v, np.uint8, offset=1)
        counts.append(packed.view(np.uint32) if v[0] else np.stack([packed & 15, packed >> 4], -1).ravel())
    width = min(map(len, counts))
    return np.array([c.reshape(-1, width).sum(0, dtype=np.int32) for c in counts])


def can_link(x: np.ndarray, nx, y: np.ndarray, ny, num: int, den: int):
    """Whether the summed coordinate minima reach the overlap that sets of these sizes need."""
    return (num + den) * np.minimum(x, y).sum(-1, dtype=np.int64) >= num * (nx + ny)


def _ids(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [(len(s), set_id(s) if len(s) else None, count_vector(s) if len(s) else None) for s in shingle_sets(batch.column(2), n)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], *(pa.array([s[k] for s in sets], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary())))],
            ["key", "text_id", "n", "sid", "vector"],
        )


def _keys(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        ids, out = [], []
        for own in shingle_sets(batch.column(0), n):
            if len(own) and (sid := set_id(own)) not in seen:  # equal sets of a task send their keys once
                if len(seen) < 200_000:
                    seen.add(sid)
                ids.append(sid)
                out.append(keys(own, num, den).view(np.int64))
        size = np.array(list(map(len, out)), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)), pa.array(np.repeat(np.array(ids, np.int64), size))], ["tree", "sid"]
        )


def _members(batches: Iterator[pa.RecordBatch], rows: int, tokens: int) -> Iterator[pa.RecordBatch]:
    """Members (tree, block, blocks, sid) of trees that hold two sets or more, from rows (tree, block, blocks, sid) in order.

    Trees not dealt out before (blocks 0) are named by their members, so that trees of the same members become equal rows.
    """
    for batch, starts in whole_runs(batches, 2):
        tree, block, blocks, sid = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        run = np.zeros(len(sid), np.int64)
        run[starts[1:]] = 1
        run = np.cumsum(run)
        new = np.concatenate([[True], (sid[1:] != sid[:-1]) | (run[1:] != run[:-1])])
        tree, block, blocks, sid, run = (x[new] for x in (tree, block, blocks, sid, run))
        count = np.bincount(run)
        starts = np.concatenate([[0], np.cumsum(count)[:-1]])
        name = mix(np.add.reduceat(mix(sid.view(U64) + _MULT[45]), starts) + count.astype(U64) * _MULT[46])
        own = blocks[starts] > 0
        size = block_size((tree[starts] & 127).astype(np.int64), rows, tokens)
        into = np.where(own, blocks[starts], -(-count // size)).astype(np.int32)
        # the tree's name is part of the draw, so that other sets meet in the blocks of another tree
        drawn = (mix(sid.view(U64) ^ name[run]) % into[run].astype(U64)).astype(np.int32)
        keep = (count > 1)[run] | own[run]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[keep]) for x in (np.where(own[run], tree, name.view(np.int64)[run]), np.where(own[run], block, drawn), into[run], sid)],
            ["tree", "block", "blocks", "sid"],
        )


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The set of each row (text, sid, others) whose text has it, as (others, sid, set)."""
    for batch in batches:
        wanted = batch.column(1).to_pylist()
        sets = [own.tobytes() if len(own) and set_id(own) == sid else None for sid, own in zip(wanted, shingle_sets(batch.column(0), n), strict=True)]
        sets = pa.array(sets, pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], batch.column(1), sets], [*batch.schema.names[2:], "sid", "set"]).filter(sets.is_valid())


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sets are linked."""
    both = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return den * common >= num * (len(x) + len(y) - common)


def _verified(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Linked pairs (a, b) of rows (a, part, later, sid, set) in order: each star's centre, then its other ends."""
    centre, star = None, None
    for batch in batches:
        out = []
        a, part, later, sid = (c.to_pylist() for c in batch.columns[:4])
        for k, x in enumerate(batch.column(4)):
            own = np.frombuffer(x.as_buffer(), U64)
            if not later[k]:
                centre, star = own, (a[k], part[k])
            elif star == (a[k], part[k]) and similar(centre, own, num, den):
                out.append((a[k], sid[k]))
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])


class CountTree:
    """A bulk-loaded R-tree over count vectors, with the sizes and the components of the sets."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> None:
        spread = vectors.std(0).argsort()[::-1][:2]
        order = np.lexsort((vectors[:, spread[1]], vectors[:, spread[0]], sizes // 8, group))
        self.order, self.vectors, self.sizes, self.group = order, vectors[order], sizes[order], group[order]
        starts = np.arange(0, len(order), LEAF)
        #: Levels from the leaves up: upper limits of the coordinates, smallest size, least and greatest component below.
        level = (self.vectors, self.sizes, self.group, self.group)
        self.levels: list[tuple[np.ndarray, ...]] = []
        while not self.levels or len(starts) > 1:
            ways = (np.maximum, np.minimum, np.minimum, np.maximum)
            level = tuple(f.reduceat(x, starts) for f, x in zip(ways, level, strict=True))
            self.levels.append(level)
            if len(level[0]) <= FANOUT:
                break
            starts = np.arange(0, len(level[0]), FANOUT)

    def pairs(self, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of different components whose overlap can suffice."""
        p, q = np.triu_indices(len(self.levels[-1][0]))
        for k in range(len(self.levels) - 1, -1, -1):
            high, low, least, most = self.levels[k]
            good = ~((least[p] == most[p]) & (least[q] == most[q]) & (least[p] == least[q]))
            p, q = p[good], q[good]
            good = [can_link(high[p[i : i + 4096]], low[p[i : i + 4096]], high[q[i : i + 4096]], low[q[i : i + 4096]], num, den) for i in range(0, len(p), 4096)]
            good = np.concatenate(good) if good else np.zeros(0, bool)
            p, q = p[good], q[good]
            if k:
                below, width = np.arange(FANOUT), len(self.levels[k - 1][0])
                p = np.broadcast_to(p[:, None, None] * FANOUT + below[:, None], (len(p), FANOUT, FANOUT)).ravel()
                q = np.broadcast_to(q[:, None, None] * FANOUT + below[None, :], (len(q), FANOUT, FANOUT)).ravel()
                good = (p <= q) & (q < width)
                p, q = p[good], q[good]
        for a, b in zip(p.tolist(), q.tolist(), strict=True):
            x, y = slice(a * LEAF, (a + 1) * LEAF), slice(b * LEAF, (b + 1) * LEAF)
            good = can_link(self.vectors[x][:, None], self.sizes[x][:, None], self.vectors[y][None], self.sizes[y][None], num, den)
            i, j = np.nonzero(good & (self.group[x][:, None] != self.group[y][None]))
            i, j = i + a * LEAF, j + b * LEAF
            yield self.order[i[i < j]], self.order[j[i < j]]


class Forest:
    """Joins the points of a tree into components, and keeps the edges that did."""

    def __init__(self, group: np.ndarray) -> None:
        self.label, self.edges = group.copy(), []

    def join(self, i: np.ndarray, j: np.ndarray, good=None) -> None:
        """Take those of the pairs that join two components (and are good)."""
        apart = self.label[i] != self.label[j]
        for a, b in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
            p, q = self.label[a], self.label[b]
            if p != q and (good is None or good(a, b)):
                self.label[self.label == q] = p
                self.edges.append((a, b))


def forest(vectors: np.ndarray, sizes: np.ndarray, group: np.ndarray, num: int, den: int, good=None, block=None) -> np.ndarray:
    """Edges (rows of two) of a spanning forest over the pairs of different components that can be linked (and are good).

    With blocks, only pairs of different blocks count.
    """
    out = Forest(group)
    found = CountTree(vectors, sizes, group).pairs(num, den) if len(sizes) > 2 * LEAF else [_few(vectors, sizes, num, den)]
    if block is None:  # most members are near the first one, or near another after it
        left = np.arange(len(sizes))
        for _ in range(16):
            if len(left) < 3:
                break
            lead, left = left[:1], left[1:]
            near = can_link(vectors[left], sizes[left], vectors[lead], sizes[lead], num, den)
            out.join(np.repeat(lead, int(near.sum())), left[near], good)
            left = left[~near]
    for i, j in found:
        i, j = np.minimum(i, j), np.maximum(i, j)
        if block is not None:
            across = block[i] != block[j]
            i, j = i[across], j[across]
        order = np.lexsort((j, i))
        out.join(i[order], j[order], good)
    return np.array(out.edges, np.int64).reshape(-1, 2)


def _few(vectors: np.ndarray, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the rows of one leaf that can be linked."""
    i, j = np.triu_indices(len(sizes), 1)
    near = can_link(vectors[i], sizes[i], vectors[j], sizes[j], num, den)
    return i[near], j[near]


def _forests(batches: Iterator[pa.RecordBatch], num: int, den: int, exact: bool) -> Iterator[pa.RecordBatch]:
    """Forest edges (tree, lo, hi, a, b) of rows (tree, lo, hi, block, comp, n, sid, vector or, if exact, set) in order."""
    for batch, starts in whole_runs(batches, 3):
        tree, lo, hi, block, comp, sizes, sid = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:7])
        ends, out = [*starts[1:].tolist(), len(sid)], []
        for s, e in zip(starts.tolist(), ends, strict=True):
            if e - s < 2:
                continue
            held = batch.column(7).slice(s, e - s).to_pylist()
            good = None
            if exact:
                sets = [np.frombuffer(x, U64) for x in held]
                held = [count_vector(x) for x in sets]
                good = lambda i, j: similar(sets[i], sets[j], num, den)  # noqa: B023, E731
            _, group = np.unique(comp[s:e], return_inverse=True)
            edges = forest(folded(held), sizes[s:e], group, num, den, good, block[s:e] if lo[s] != hi[s] else None)
            if len(edges):
                out.append((s, s + edges))
        rows = np.concatenate([np.repeat(s, len(x)) for s, x in out]) if out else np.zeros(0, np.int64)
        ends = sid[np.concatenate([x for _, x in out])] if out else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (tree[rows], lo[rows], hi[rows], ends.min(1, initial=2**63 - 1), ends.max(1, initial=-(2**63)))], ["tree", "lo", "hi", "a", "b"]
        )


def _doubtful(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Of rows as in _forests (with vectors) those that can be linked with a row of another component: all but the vector."""
    for batch, starts in whole_runs(batches, 3):
        lo, hi, block, comp, sizes = (c.to_numpy(zero_copy_only=False) for c in batch.columns[1:6])
        ends, keep = [*starts[1:].tolist(), batch.num_rows], np.zeros(batch.num_rows, bool)
        for s, e in zip(starts.tolist(), ends, strict=True):
            own, vectors, size = comp[s:e], folded(batch.column(7).slice(s, e - s).to_pylist()), sizes[s:e]
            for i, j in CountTree(vectors, size, own).pairs(num, den) if e - s > 2 * LEAF else [_few(vectors, size, num, den)]:
                good = own[i] != own[j]
                if lo[s] != hi[s]:
                    good &= block[s:e][i] != block[s:e][j]
                keep[s + i[good]] = keep[s + j[good]] = True
        yield batch.select(range(7)).filter(pa.array(keep))


class _Join:
    """The parts of one join: texts, classes of equal sets, and the components found so far."""

    def __init__(self, src: DataFrame, n: int, num: int, den: int) -> None:
        self.src, self.n, self.num, self.den = src, n, num, den
        self.ids = cut(src.mapInArrow(lambda it: _ids(it, n), "key long, text_id long, n long, sid long, vector binary"))
        one = F.min(F.struct(F.col("key").isNull().alias("no"), "key", "text_id")).alias("one")
        classes = self.ids.where("sid is not null").groupBy("sid").agg(one, F.first("n").alias("n"), F.first("vector").alias("vector"))
        self.classes = cut(classes.select("sid", "one.key", "one.text_id", "n", "vector"))
        self.joined: DataFrame | None = None

    def members(self) -> DataFrame:
        """(tree, block, blocks, sid) of all trees of two or more sets."""
        n, num, den, rows, tokens = self.n, self.num, self.den, BLOCK_ROWS, BLOCK_TOKENS
        sent = lambda texts: texts.select("text").mapInArrow(lambda it: _keys(it, n, num, den), "tree long, sid long")
        some = self.src.where(F.pmod("text_id", F.lit(SEEN)) == 0).dropDuplicates(["text_id"])
        least = max(SEEN, int(self.ids.count() / SEEN * HOT_SHARE))
        level = F.element_at(F.array(*(F.lit(int(x)) for x in block_size(np.arange(len(_LEVELS)), rows, tokens))), (F.col("tree").bitwiseAND(127) + 1).cast("int"))
        # few: at most 1 / HOT_SHARE of them for every key that a row has on average
        counted = sent(some).groupBy("tree").count().where(F.col("count") >= least)
        hot = cut(counted.select("tree", F.greatest(F.lit(2), F.ceil(F.col("count") * SEEN / level)).cast("int").alias("blocks")))
        dealt = sent(self.src).join(F.broadcast(hot), "tree", "left").select(
            "tree", F.coalesce(F.pmod(F.xxhash64("sid", "tree"), F.col("blocks")).cast("int"), F.lit(0)).alias("block"), F.coalesce("blocks", F.lit(0)).alias("blocks"), "sid"
        )
        dealt = dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "sid")
        return cut(dealt.mapInArrow(lambda it: _members(it, rows, tokens), "tree long, block int, blocks int, sid long").distinct())

    def labelled(self, rows: DataFrame) -> DataFrame:
        """Rows with the component of their sid."""
        if self.joined is None:
            return rows.withColumn("comp", F.col("sid"))
        return rows.join(self.joined, F.col("sid") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "sid")).drop("node", "component")

    def apart(self, edges: DataFrame) -> DataFrame:
        """Edges whose ends are not in one component."""
        if self.joined is None:
            return edges
        for end in ("a", "b"):
            edges = edges.join(self.joined.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left")
        return edges.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")

    def with_sets(self, rows: DataFrame, columns: str) -> DataFrame:
        """The rows (sid and `columns`) with the sets, read from one text of each class."""
        n = self.n
        rows = rows.join(self.classes.select("sid", "key", "text_id"), "sid")
        found = looked_up(self.src, rows, ["key", "text_id"])
        names = [c.split()[0] for c in columns.split(", ")]
        return found.select("text", "sid", *names).mapInArrow(lambda it: _sets(it, n), f"{columns}, sid long, set binary")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) those whose sets are linked; stars of many ends are dealt over tasks."""
        num, den = self.num, self.den
        pairs = cut(pairs)
        stars = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts")))
        ends = pairs.join(stars, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("later"), F.col("b").alias("sid"))
        centres = stars.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("later"), F.col("a").alias("sid"))
        sets = self.with_sets(ends.union(centres), "a long, part int, later int")
        sets = sets.repartition("a", "part").sortWithinPartitions("a", "part", "later", "sid")
        return cut(sets.mapInArrow(lambda it: _verified(it, num, den), "a long, b long"))

    def join(self, links: DataFrame) -> None:
        """Take further links into the components."""
        if not links.limit(1).count():
            return
        if self.joined is None:
            self.joined = cut(components(links))
            return
        ends = links.select(F.col("a").alias("sid")).union(links.select(F.col("b").alias("sid"))).distinct()
        ends = cut(self.labelled(ends))
        top = components(
            links.join(ends.select(F.col("sid").alias("a"), F.col("comp").alias("ca")), "a")
            .join(ends.select(F.col("sid").alias("b"), F.col("comp").alias("cb")), "b")
            .select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        )
        both = self.joined.union(ends.where("sid = comp").select("sid", "comp")).distinct()
        moved = both.join(top.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
        self.joined = cut(moved.select("node", F.coalesce("to", "component").alias("component")))

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows (tree, lo, hi, block, comp, n, sid, vector) of rows (tree, lo, hi, block, sid), by tree and blocks in order."""
        rows = self.labelled(rows).join(self.classes.select("sid", "n", "vector"), "sid").select("tree", "lo", "hi", "block", "comp", "n", "sid", "vector")
        return _in_order(rows)

    def settle(self, rows: DataFrame) -> None:
        """Join all linked sets that are together in a (tree, lo, hi) of rows (tree, lo, hi, block, sid)."""
        num, den, edge = self.num, self.den, "tree long, lo int, hi int, a long, b long"
        found = cut(self.dealt(rows).mapInArrow(lambda it: _forests(it, num, den, False), edge))
        self.join(self.links(found.select("a", "b").distinct()))
        failed = cut(self.apart(found).select("tree", "lo", "hi").distinct())
        if failed.limit(1).count():
            kept = "tree long, lo int, hi int, block int, comp long, n long"
            open_ = self.dealt(rows.join(failed, ["tree", "lo", "hi"])).mapInArrow(lambda it: _doubtful(it, num, den), f"{kept}, sid long")
            exact = _in_order(self.with_sets(open_, kept)).mapInArrow(lambda it: _forests(it, num, den, True), edge)
            self.join(cut(exact.select("a", "b").distinct()))


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "lo", "hi").sortWithinPartitions("tree", "lo", "hi", "sid")


def near_duplicates(
    df: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_shingles, component_id) of each row: sets link at a similarity of num/den or more."""
    small_batches(df.sparkSession)
    src = df.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.col(text).cast("string")).alias("text_id"), F.col(text).cast("string").alias("text"))
    work = _Join(src, n, num, den)
    members = work.members()
    work.settle(members.select("tree", F.col("block").alias("lo"), F.col("block").alias("hi"), "block", "sid"))

    many = members.where("blocks > 1")
    if many.limit(1).count():
        open_ = work.labelled(many).groupBy("tree").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
        several = many.join(cut(open_.select("tree")), "tree").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        several = several.where("other <> block").select("tree", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "sid")
        work.settle(several)

    named = work.labelled(work.classes.select("sid", "key"))
    least = named.groupBy("comp").agg(F.min("key").alias("component_id"))
    named = named.join(least, "comp").select("sid", "component_id")
    return work.ids.select("key", "n", "sid").join(named, "sid", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id")
    )
