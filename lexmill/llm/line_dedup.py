"""Line deduplication across documents by a deletion-neighbourhood join.

A line (text between line feeds) goes if an earlier line, by document id and
line number, equals it, or if both have at least `min_chars` characters and it
is within one edit (a character inserted, deleted or replaced) of the earlier
one; whether that earlier line goes itself doesn't matter. The earliest stays.
Lines under `min_exact` characters and blank ones always stay.

Lines are first aggregated to distinct ones with their earliest place. Two
lines within one edit, the longer of M characters, share their first or their
last (M-1)//2 characters, so only lines that share such a half with another
one of the same or the next length go on, and need no variant inside it. These
emit their variants as hashed keys: for replacements the text without character
i together with i, for insertions the longer line's text without a character
against the shorter line's whole text. Lines with equal keys are within one
edit, so each group needs only its earliest member, whatever its size; the edit
distance of each line to the one it goes for is then verified on the texts.
The bound of one edit is fixed, as the keys are made for it. Halves and variants
are pre-aggregated, so a frequent one costs a row a task, not a group in one.

Null and empty texts stay as they are. A row is known by its id and its text:
rows that share an id are documents of their own, in the order of their texts'
hashes; rows equal in both are one document. Rows without an id are returned
unchanged and take out no line. An empty table gives an empty result. Further
columns are kept as they are, but for earlier n_lines and n_lines_removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.bytescan import BLOCK, U64, mix, powers
from lexmill.llm.common import cut, looked_up, small_batches

#: Fewest characters of a line that goes for a near copy, and for an equal one.
MIN_CHARS, MIN_EXACT = 20, 1
#: White space; a line of nothing else is blank.
_SPACE = np.array([*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_CODE_BASE = 0xD1342543DE82EF95
_CODE_INVERSE = pow(_CODE_BASE, -1, 2**64)
_codes: list[np.ndarray] = []


def _code_table() -> np.ndarray:
    if not _codes:
        _codes.append(mix(np.arange(1, 0x110001, dtype=U64) * U64(0xA0761D6478BD642F)))
    return _codes[0]


class Lines:
    """Lines of some texts, with hashes of any part of them."""

    def __init__(self, texts: list[str]) -> None:
        whole = "\n".join(texts)
        self.points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        breaks = np.flatnonzero(self.points == 10)
        self.start = np.concatenate([[0], breaks + 1])
        self.end = np.append(breaks, len(self.points))
        self.counts = np.array([t.count("\n") + 1 for t in texts], np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.pos = np.arange(len(self.start)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        self.running = np.zeros(len(self.points) + 1, U64)
        np.cumsum(_code_table()[self.points] * powers(_CODE_BASE, len(self.points)), out=self.running[1:])
        self.inverse = powers(_CODE_INVERSE, len(self.points) + 1)

    def filled(self) -> np.ndarray:
        """Whether each line has more than white space."""
        seen = np.concatenate([[0], np.cumsum(~np.isin(self.points, _SPACE))])
        return seen[self.end] > seen[self.start]

    def raw(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.running[b] - self.running[a]) * self.inverse[a]

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(self.raw(a, b) + (b - a).astype(U64) * U64(0x8EBC6AF09C88C6E3))


_MARK = pa.struct([("m", pa.int32()), ("side", pa.int32()), ("shorter", pa.bool_()), ("insert", pa.bool_()), ("replace", pa.bool_())])
_MARKED = pa.schema([("key", pa.int64()), ("text_id", pa.int64()), ("pos", pa.int32()), ("line", pa.string()), ("marks", pa.list_(_MARK))])
_MARKED_DDL = "key long, text_id long, pos int, line string, marks array<struct<m: int, side: int, shorter: boolean, insert: boolean, replace: boolean>>"


def _grouped(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    group, size, first = [], 0, 0
    for k, t in enumerate(texts):
        group.append(t)
        size += len(t)
        if size > BLOCK or k == len(texts) - 1:
            yield first, group
            group, size, first = [], 0, k + 1


def _lines(batches: Iterator[pa.RecordBatch], min_chars: int, min_exact: int) -> Iterator[pa.RecordBatch]:
    """(h, key, text_id, pos, n, halves): a row for each line; halves (of length class n, then n + 1) once a block."""
    for batch in batches:
        ids, text_ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        texts = [t or "" for t in batch.column(2).to_pylist()]
        for first, group in _grouped(texts):
            x = Lines(group)
            k = np.flatnonzero((x.end - x.start >= min(min_chars, min_exact)) & x.filled())
            a, b, n = x.start[k], x.end[k], (x.end - x.start)[k]
            h = x.hash(a, b)
            _, one = np.unique(h, return_index=True)
            halves = np.zeros((len(k), 4), np.int64)
            for c, more in ((0, 0), (2, 1)):
                p = (n + more - 1) // 2
                name = (n + more).astype(U64) * U64(4)
                halves[:, c] = mix(x.raw(a, a + p) + name).view(np.int64)
                halves[:, c + 1] = mix(x.raw(b - p, b) + name + U64(1)).view(np.int64)
            sent = np.zeros(len(k), bool)
            sent[one] = True
            sent &= n >= min_chars
            offsets = np.concatenate([[0], np.cumsum(np.where(sent, 4, 0))]).astype(np.int32)
            row = first + x.doc[k]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h.view(np.int64)), pa.array(ids[row].astype(np.int64)), pa.array(text_ids[row]), pa.array(x.pos[k].astype(np.int32)),
                    pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(halves[sent].ravel())),
                ],
                ["h", "key", "text_id", "pos", "n", "halves"],
            )


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(variant, kind, key, text_id, pos) of marked lines; kind: 0 a longer line without a character,
    1 a whole shorter line, 2 a line without a character at a place."""
    for batch in batches:
        keys, text_ids, places, lines, marks = (c.to_pylist() for c in batch.columns)
        for first, group in _grouped(lines):
            x = Lines(group)
            power = powers(_CODE_BASE, len(x.points) + 1)
            out: list[tuple] = []
            for d in range(len(group)):
                a, b, place = int(x.start[d]), int(x.end[d]), (keys[first + d], text_ids[first + d], places[first + d])
                for m in marks[first + d]:
                    half = (m["m"] - 1) // 2
                    name = U64(m["m"] * 4 + m["side"])
                    if m["shorter"]:
                        out.append((mix(x.raw(np.array([a]), np.array([b])) + np.array([name * U64(3) + U64(1)])), 1, *place))
                        continue
                    # the edit lies outside the shared half
                    i = np.arange(a + half, b) if m["side"] == 0 else np.arange(a, b - half)
                    raw = x.raw(np.full(len(i), a), i) + x.raw(i + 1, np.full(len(i), b)) * power[i - a]
                    if m["insert"]:
                        out.append((mix(raw + np.array([name * U64(3) + U64(1)])), 0, *place))
                    if m["replace"]:
                        at = (i - a).astype(U64) * U64(0x9FB21C651E98DF25)
                        out.append((mix(mix(raw + np.array([name * U64(3) + U64(2)])) + at), 2, *place))
            if out:
                size = [len(o[0]) for o in out]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([o[0] for o in out]).view(np.int64)),
                        *(pa.array(np.repeat(np.array([o[k] for o in out], t), size)) for k, t in ((1, np.int32), (2, np.int64), (3, np.int64), (4, np.int32))),
                    ],
                    ["variant", "kind", "key", "text_id", "pos"],
                )


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text_id, pos, line, marks) of the marked lines of each text."""
    for batch in batches:
        rows: list[dict] = []
        for key, text_id, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lines = (text or "").split("\n")
            rows += [{"key": key, "text_id": text_id, "pos": w["pos"], "line": lines[w["pos"]], "marks": w["marks"]} for w in wanted]
        yield pa.RecordBatch.from_pylist(rows, _MARKED)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, n_lines, n_lines_removed) of rows (row, text, gone)."""
    for batch in batches:
        out, n_lines, n_gone = [], [], []
        for t, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines = t.split("\n") if t else []
            drop = set(g or ())
            n_lines.append(len(lines))
            n_gone.append(len(drop))
            out.append("\n".join([x for k, x in enumerate(lines) if k not in drop]) if drop else t)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64())], ["row", "text", "n_lines", "n_lines_removed"]
        )


_PLACE = ("key", "text_id", "pos")


def removed_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_exact: int = MIN_EXACT) -> DataFrame:
    """(key, text_id, pos, near) of each line that goes; near: for a line that is only within an edit of an earlier one."""
    small_batches(df.sparkSession)
    src = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    src = src.select("key", F.xxhash64("text").alias("text_id"), "text")
    lines = cut(src.mapInArrow(lambda it: _lines(it, min_chars, min_exact), "h long, key long, text_id long, pos int, n int, halves array<long>"))
    # written, so that joins on it can split the rows of a very frequent line
    first = cut(lines.groupBy("h").agg(F.min(F.struct(*_PLACE)).alias("at")))

    half = lines.where(F.size("halves") > 0).select("h", "n", F.posexplode("halves").alias("k", "half"))
    half = half.select("half", "h", (F.col("n") * 4 + F.col("k")).alias("nk"))
    longer = F.col("nk") % 4 < 2
    ends = half.groupBy("half").agg(F.min(F.when(longer, F.col("h"))).alias("l0"), F.max(F.when(longer, F.col("h"))).alias("l1"), F.max(~longer).alias("s"))
    shared = ends.select("half", (F.col("s") & F.col("l0").isNotNull()).alias("insert"), F.coalesce(F.col("l0") != F.col("l1"), F.lit(False)).alias("replace"))
    marked = looked_up(half, shared.where("insert or replace"), ["half"]).select(
        "h", (F.shiftright("nk", 2) + F.when(longer, 0).otherwise(1)).alias("m"), (F.col("nk") % 2).alias("side"), (~longer).alias("shorter"), "insert", "replace",
    )
    marked = marked.where("insert or not shorter").distinct()
    marked = marked.groupBy("h").agg(F.collect_list(F.struct("m", "side", "shorter", "insert", "replace")).alias("marks"))
    placed = marked.join(first, "h").groupBy("at.key", "at.text_id").agg(F.collect_list(F.struct("at.pos", "marks")).alias("wanted"))
    picked = looked_up(src, placed, ["key", "text_id"]).select("key", "text_id", "text", "wanted").mapInArrow(_picked, _MARKED_DDL)
    picked = cut(picked.dropDuplicates([*_PLACE]))
    variants = picked.mapInArrow(_variants, "variant long, kind int, key long, text_id long, pos int")
    place = F.struct(*_PLACE)
    of = lambda k: F.when(F.col("kind") == k, place)
    groups = variants.groupBy("variant").agg(*(F.min(of(k)).alias(f"by_{k}") for k in range(3)), F.max(of(2)).alias("last_2"))
    groups = groups.where("(by_0 is not null and by_1 is not null) or by_2 < last_2").drop("last_2")
    by = F.when(F.col("kind") == 0, F.col("by_1")).when(F.col("kind") == 1, F.col("by_0")).otherwise(F.col("by_2"))
    near = looked_up(variants, groups, ["variant"]).select(place.alias("place"), by.alias("by")).where("by < place").groupBy("place").agg(F.min("by").alias("by"))
    texts = picked.select(place.alias("place"), "line")
    near = near.join(texts, "place").join(texts.select(F.col("place").alias("by"), F.col("line").alias("other")), "by")
    near = near.where(F.levenshtein("line", "other", 1) >= 0).select("place.*", F.lit(True).alias("near"))
    again = lines.join(first, "h").where((F.col("n") >= min_exact) & (place != F.col("at"))).select(*_PLACE, F.lit(False).alias("near"))
    return again.union(near)


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_exact: int = MIN_EXACT) -> DataFrame:
    """The rows of `df` with their remaining text, and n_lines and n_lines_removed."""
    df = df.drop("n_lines", "n_lines_removed")
    others = [c for c in df.columns if c != text]
    gone = removed_lines(df, key, text, min_chars, min_exact).groupBy("key", "text_id").agg(F.collect_set("pos").alias("gone"))
    row = F.struct(*(F.col(f"`{c}`") for c in others))
    src = df.select(row.alias("row"), F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    src = src.withColumn("text_id", F.xxhash64("text"))
    full = looked_up(src, gone, ["key", "text_id"], "left").select("row", "text", "gone")  # documents that lose nothing stay where they are
    schema = full.drop("gone").schema.add("n_lines", "long").add("n_lines_removed", "long")
    out = full.mapInArrow(_kept, schema)
    return out.select(*(F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in df.columns), "n_lines", "n_lines_removed")
