"""Removal of repeated byte strings by suffix arrays over shards.

A byte goes if it is covered by a `size`-byte string that also starts anywhere
else in the input, in the same document or another; matches never cross
documents, overlapping occurrences count, and everything is judged on the input.

1. Every window of `size` bytes has an anchor: its k-gram of smallest hash, the
   leftmost of equals. Equal windows have equal anchors, so only windows of one
   anchor need to be compared. Runs of neighbouring windows with one anchor
   form a segment; only its hashes move.
2. Anchors of a single segment hold nothing repeated. Segments with equal bytes
   are repeated as a whole, and one of them stands for all.
3. The remaining different segments of an anchor are written one after another
   into shards; each shard's suffix array is induced and its permuted common
   prefixes tell which windows occur twice.
   An anchor with more than `hot` different segments isn't put into one shard:
   the hashes of its single windows are counted instead, dealt out by hash.
4. The repeated ranges are joined to their documents and cut out.

Null and empty texts have no bytes; texts under `size` bytes stay whole. A row
is known by its id and its text: rows that share an id are documents of their
own, rows equal in both are copies and lose what they repeat. Rows without an
id take part like others. Empty tables give empty results; columns other than
the key and the text are not read. Texts of any length are scanned in
overlapping slices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.bytescan import U64, blocks, mix, prefix_hash, range_hash
from lexmill.llm.common import cut, looked_up, release, small_batches
from lexmill.llm.suffixes import repeated

SIZE, GRAM = 200, 48
#: Different segments of one anchor that a shard takes, and bytes of a shard.
HOT, SHARD_BYTES = 20_000, 4 << 20
_SLICE = 1 << 21
_PLACE = U64((1 << 22) - 1)


def _window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def segments(buf: np.ndarray, offs: np.ndarray, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Document, first and last window start, anchor and contents hash of each segment of a block."""
    out: list[tuple[np.ndarray, ...]] = []
    for low in range(0, max(1, len(buf) - size + 1), _SLICE):
        part = buf[low : low + _SLICE + size - 1]
        n = len(part) - size + 1
        if n < 1:
            continue
        running = prefix_hash(part)
        at = np.arange(len(part) - gram + 1)
        grams = range_hash(running, at, at + gram)
        anchor = (_window_minimum((grams & ~_PLACE) | at.astype(U64), size - gram + 1) & _PLACE).astype(np.int64)
        start = np.arange(low, low + n)
        doc = np.searchsorted(offs, start, "right") - 1
        valid = start + size <= offs[doc + 1]
        # a new segment begins where the anchor or the document changes
        first = valid.copy()
        first[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        a = np.flatnonzero(first)
        if not len(a):
            continue
        last = valid.copy()
        last[:-1] &= ~valid[1:] | first[1:]
        b = np.flatnonzero(last)
        contents = mix(range_hash(running, a, b + size) + (anchor[a] - a).astype(U64))
        d = doc[a]
        out.append((d, a + low - offs[d], b + low - offs[d], grams[anchor[a]], contents))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(5))


def _segments(batches: Iterator[pa.RecordBatch], size: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, _, buf, offs in blocks(batch.column(2)):
            doc, a, b, anchor, contents = segments(buf, offs, size, gram)
            row = pa.array(i + doc)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x.view(np.int64)) for x in (anchor, contents)), batch.column(0).take(row), batch.column(1).take(row), *(pa.array(x.astype(np.int64)) for x in (a, b))],
                ["anchor", "contents", "key", "text_id", "a", "b"],
            )


def _cut_out(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments."""
    for batch in batches:
        rows: list[tuple] = []
        for key, text_id, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = (text or "").encode()
            for w in wanted:
                rows.append((w["anchor"], w["hot"], key, text_id, w["a"], data[w["a"] : w["b"] + size]))
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["anchor", "hot", "key", "text_id", "a", "data"])


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _shards(batches: Iterator[pa.RecordBatch], size: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Repeated window ranges of rows (anchor, key, text_id, a, data), which come sorted by anchor."""
    held: list[tuple] = []
    n, name = 0, None

    def flush() -> pa.RecordBatch:
        text = np.frombuffer(b"\xff".join(h[4] for h in held), np.uint8)  # no text holds the byte FF
        starts = np.concatenate([[0], np.cumsum([len(h[4]) + 1 for h in held])])
        flags = repeated(text, size, 2 * max(len(h[4]) for h in held) + 2)
        inside = np.zeros(len(text) + 1, bool)
        windows = starts[1:] - size  # one past each segment's last window
        np_idx = np.zeros(len(text) + 2, np.int32)
        np.add.at(np_idx, starts[:-1], 1)
        np.add.at(np_idx, windows, -1)
        inside[: len(text)] = np.cumsum(np_idx)[: len(text)] > 0
        a, b = _runs(flags & inside[: len(text)])
        k = np.searchsorted(starts, a, "right") - 1
        names = [pa.array([h[c] for h in held], pa.int64()).take(pa.array(k)) for c in (1, 2)]
        base = np.array([h[3] for h in held], np.int64)
        return pa.RecordBatch.from_arrays([*names, pa.array(base[k] + a - starts[k]), pa.array(base[k] + b - starts[k])], ["key", "text_id", "a", "b"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != name and n > shard_bytes:
                yield flush()
                held, n = [], 0
            name = row[0]
            held.append(row)
            n += len(row[4]) + 1
    if held:
        yield flush()
    held = []
    release()


def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(window, key, text_id, a) of every window of the segments."""
    for batch in batches:
        for key, text_id, a, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            buf = np.frombuffer(data, np.uint8)
            at = np.arange(len(buf) - size + 1)
            h = range_hash(prefix_hash(buf), at, at + size).view(np.int64)
            names = [pa.array([x], pa.int64()).take(pa.array(np.zeros(len(at), np.int64))) for x in (key, text_id)]
            yield pa.RecordBatch.from_arrays([pa.array(h), *names, pa.array(a + at)], ["window", "key", "text_id", "a"])


def repeated_ranges(
    df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, gram: int = GRAM, hot: int = HOT, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """(key, text_id, a, b): runs of window starts, both ends included, whose windows also start elsewhere."""
    spark = df.sparkSession
    small_batches(spark)
    src = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    src = src.select("key", F.xxhash64("text").alias("text_id"), "text")
    found = src.mapInArrow(lambda it: _segments(it, size, gram), "anchor long, contents long, key long, text_id long, a long, b long")
    shared = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("contents").alias("low"), F.max("contents").alias("high"))
    # of the segments only those with a shared anchor are shuffled; both sides are written, so that a very frequent anchor can be split
    rows = cut(looked_up(found, shared.where("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("mixed")), ["anchor"]))

    place = ("key", "text_id", "a", "b")
    kinds = rows.where("mixed").groupBy("anchor", "contents").agg(F.count("*").alias("copies"), F.min(F.struct(*place)).alias("one"))
    kinds = cut(kinds)
    several = cut(kinds.where("copies > 1").select("anchor", "contents"))
    whole = rows.where("not mixed").select(*place).union(
        rows.where("mixed").join(several, ["anchor", "contents"], "left_semi").select(*place)
    )
    # each takes more than `hot` segments, so they are few
    over = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > hot).select("anchor", F.lit(True).alias("hot"))
    wanted = kinds.join(F.broadcast(over), "anchor", "left")
    wanted = wanted.select("one.key", "one.text_id", F.struct("anchor", F.coalesce("hot", F.lit(False)).alias("hot"), "one.a", "one.b").alias("w"))
    wanted = wanted.groupBy("key", "text_id").agg(F.collect_list("w").alias("wanted"))
    pieces = looked_up(src, wanted, ["key", "text_id"]).select("key", "text_id", "text", "wanted").mapInArrow(
        lambda it: _cut_out(it, size), "anchor long, hot boolean, key long, text_id long, a long, data binary"
    )
    pieces = cut(pieces)
    names = ("key", "text_id", "a", "data")
    cold = pieces.where("not hot").select("anchor", *names).repartition("anchor").sortWithinPartitions("anchor")
    parts = cold.mapInArrow(lambda it: _shards(it, size, shard_bytes), "key long, text_id long, a long, b long")
    single = pieces.where("hot").select(*names).mapInArrow(lambda it: _windows(it, size), "window long, key long, text_id long, a long")
    twice = single.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    single = single.join(twice, "window", "left_semi").select("key", "text_id", "a", F.col("a").alias("b"))
    return whole.union(parts).union(single)


def _kept(batches: Iterator[pa.RecordBatch], size: int, whole: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []} | ({"kept": [], "spans": []} if whole else {})
        for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = (text or "").encode()
            spans: list[list[int]] = []
            for a, b in sorted((r["a"], r["b"] + size) for r in ranges or ()):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            ends = [0, *(x for s in spans for x in s), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
            for name, value in (
                ("n_bytes", len(data)), ("n_removed", len(data) - len(kept)), ("n_spans", len(spans)),
                ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept", kept), ("spans", [x for s in spans for x in s]),
            ):
                if name in out:
                    out[name].append(value)
        types = {"kept_sha256": pa.string(), "kept": pa.binary(), "spans": pa.list_(pa.int64())}
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, types.get(k, pa.int64())) for k, v in out.items())], ["key", *out])


def remove_repeats(
    df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, whole: bool = True, **options: int
) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256[, kept, spans]) of each row.

    kept holds the remaining bytes; cutting may split a character, so they need not be text.
    """
    ranges = repeated_ranges(df, key, text, size, **options).groupBy("key", "text_id").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    src = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    src = src.withColumn("text_id", F.xxhash64("text"))
    full = looked_up(src, ranges, ["key", "text_id"], "left").select("key", "text", "ranges")  # documents without repeats stay where they are
    schema = f"key {src.schema['key'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept binary, spans array<long>" if whole else ""
    return full.mapInArrow(lambda it: _kept(it, size, whole), schema).withColumnRenamed("key", key)
