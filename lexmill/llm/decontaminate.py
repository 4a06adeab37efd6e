"""Benchmark decontamination by a prefix-filtered set join.

A window is `size` consecutive words of an item (all of them, if it has fewer).
A document holds a window only if it holds all its words, so of a window's
words, ordered by how many documents hold them, the rarest alone is a
sufficient prefix.

1. One scan of the documents counts, for the benchmark's words, the documents
   that hold them; each window gets its rarest word and that word's place in it.
2. A second scan sends each place of a prefix word where a window can lie: it
   has to fit between the document's ends, and its hash has to be one of a
   window's. Both tests use bit filters of a fixed size, so a task holds as much
   for any benchmark and the documents are read twice at every size.
3. What was sent is joined with the windows by prefix word, place and length, and
   all words are compared. A word of any frequency costs a document one row.

Null, empty or wordless texts and items have no words, no windows and no hits.
Equal items count apart, equal windows within an item once; every document row
gives one result of its own, whether ids repeat or are null; items without an
id hit words but are not listed; ties in rarity are
broken by the word's hash, which changes no result. Empty tables give no rows
or no hits. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.bytescan import LOWER, U64, blocks, byte_class, mix, word_hashes
from lexmill.llm.common import bit_filter, cut, passes, small_batches

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z
WORD_BYTES = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
SIZE = 10
#: Bits of the filters of words, prefix words and windows: 2 MB each, whatever the benchmark.
BITS = 1 << 24
_MULT = np.random.default_rng(11).integers(1, 2**63, 64, dtype=U64) | U64(1)


def _words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, word hashes and documents' word offsets, block by block."""
    for i, _, buf, offs in blocks(column):
        yield (i, *word_hashes(LOWER[buf], offs, WORD_BYTES))


def _window_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place where so many are left."""
    out = np.full(max(0, len(w) - n + 1), n, U64)
    for k in range(n):
        out = out + w[k : k + len(out)] * _MULT[k % 64] * U64(2 * (k // 64) + 1)
    return mix(out)


def _item_windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, wins, names = [], [], []
        for row, w, at in _words(batch.column(1)):
            for k in range(len(at) - 1):
                own = w[at[k] : at[k + 1]]
                n = min(size, len(own))
                if n:
                    uniq = np.unique(np.lib.stride_tricks.sliding_window_view(own.view(np.int64), n), axis=0)
                    ids += [batch.column(0)[row + k].as_py()] * len(uniq)
                    wins += list(uniq)
                    names += [_window_hashes(u.view(U64), n).view(np.int64)[0] for u in uniq]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.string()), pa.array(wins, pa.list_(pa.int64())), pa.array(names, pa.int64())], ["item", "win", "name"]
        )


def windows(benchmark: DataFrame, size: int, item: str, text: str) -> DataFrame:
    """(items, win, name): the distinct windows as arrays of word hashes, with the items that hold them and a hash of the whole."""
    src = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    each = src.mapInArrow(lambda it: _item_windows(it, size), "item string, win array<long>, name long")
    return each.groupBy("win", "name").agg(F.collect_set("item").alias("items"))


def _document_frequency(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    """(word, df) of the words that pass the filter, counted over each batch."""
    for batch in batches:
        found = []
        for _, w, at in _words(batch.column(0)):
            p = np.flatnonzero(passes(vocabulary.value, w))
            doc = np.searchsorted(at, p, "right")
            order = np.lexsort((w[p], doc))
            own, doc = w[p][order], doc[order]
            found.append(own[np.concatenate([[True], (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])])] if len(own) else own)
        word, df = np.unique(np.concatenate(found) if found else np.zeros(0, U64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(df.astype(np.int64))], ["word", "df"])


def prefixes(wins: DataFrame, df: DataFrame) -> DataFrame:
    """(word, lead, n, name, win, items): each window at its rarest word and that word's place."""
    each = wins.select("win", "name", F.posexplode("win").alias("lead", "word")).join(df, "word", "left")
    rarest = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word", "lead")).alias("first")
    first = each.groupBy("win", "name").agg(rarest)
    return wins.join(first, ["win", "name"]).select("first.word", "first.lead", F.size("win").alias("n"), "name", "win", "items")


_SENT = "key {}, text_id long, n_words long, word long, lead int, n int, name long, begins array<int>, win array<long>"


def _sent(batches: Iterator[pa.RecordBatch], lengths: list[int], leading, named) -> Iterator[pa.RecordBatch]:
    """A row with n_words for each document, and a row for each prefix word at which a window of a document can lie.

    Equal windows of a document are one row with all their places.
    """
    for batch in batches:
        rows: list[tuple] = []
        for first, w, at in _words(batch.column(2)):
            rows += [(first + d, int(n), None, None, None, None, None, None) for d, n in enumerate(np.diff(at))]
            for n in lengths:
                name = _window_hashes(w, n)
                begin = np.flatnonzero(passes(named.value, name))
                doc = np.searchsorted(at, begin, "right") - 1
                fits = begin + n <= at[doc + 1]
                begin, doc = begin[fits], doc[fits]
                if not len(begin):
                    continue
                name = name[begin]
                order = np.lexsort((begin, name, doc))
                begin, doc, name = begin[order], doc[order], name[order]
                cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (name[1:] != name[:-1])) + 1
                for places in np.split(np.arange(len(begin)), cuts):
                    k = places[0]
                    win = w[begin[k] : begin[k] + n]
                    d = int(doc[k])
                    own = (begin[places] - at[d]).tolist()
                    for lead in np.flatnonzero(passes(leading.value, win)).tolist():
                        rows.append((first + d, None, int(win[lead].view(np.int64)), lead, n, int(name[k].view(np.int64)), own, win.view(np.int64).tolist()))
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        at = pa.array([r[0] for r in rows], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), *(pa.array([r[k + 1] for r in rows], t) for k, t in enumerate(types))],
            ["key", "text_id", "n_words", "word", "lead", "n", "name", "begins", "win"],
        )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n_words, spans, items) of rows (key, n_words, found), found being lists of (begins, n, items)."""
    for batch in batches:
        spans, items = [], []
        for found in batch.column(2).to_pylist():
            found = found or ()
            spans.append([x for s in _merge((b, b + f["n"]) for f in found for b in f["begins"]) for x in s])
            items.append(sorted({i for f in found for i in f["items"]}))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], ["key", "n_words", "spans", "items"]
        )


def _merge(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted({*spans}):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", size: int = SIZE,
) -> DataFrame:
    """(key, n_words, spans, items) of each document row.

    spans: word positions start, end, start, end ... of the merged hit runs;
    items: the ids, as sorted strings, of items with an occurring window.
    """
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    src = src.select("key", F.xxhash64("text").alias("text_id"), "text")
    kind = src.schema["key"].dataType.simpleString()
    wins = cut(windows(benchmark, size, item, item_text))
    lengths = [r[0] for r in wins.select(F.size("win")).distinct().orderBy(F.size("win")).collect()]  # at most `size` numbers
    vocabulary = bit_filter(wins.select(F.explode("win").alias("h")), BITS)
    counted = src.select("text").mapInArrow(lambda it: _document_frequency(it, vocabulary), "word long, df long")
    lead = cut(prefixes(wins, counted.groupBy("word").agg(F.sum("df").alias("df"))))
    leading, named = bit_filter(lead.select(F.col("word").alias("h")), BITS), bit_filter(lead.select(F.col("name").alias("h")), BITS)
    sent = cut(src.mapInArrow(lambda it: _sent(it, lengths, leading, named), _SENT.format(kind)))
    hits = sent.where("word is not null").drop("n_words").alias("d").join(lead.alias("w"), ["word", "lead", "n", "name"])
    hits = hits.where(F.col("d.win") == F.col("w.win"))
    found = hits.groupBy("key", "text_id").agg(F.collect_set(F.struct("begins", "n", "items")).alias("found"))
    found = found.select(F.col("key").alias("own"), F.col("text_id").alias("own_text"), "found")
    rows = sent.where("word is null").select("key", "text_id", "n_words")
    rows = rows.join(found, F.col("key").eqNullSafe(F.col("own")) & (F.col("text_id") == F.col("own_text")), "left").select("key", "n_words", "found")
    return rows.mapInArrow(_merged, f"key {kind}, n_words long, spans array<long>, items array<string>").withColumnRenamed("key", key)


def contamination_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The report of `contamination` as counts and a digest of the items."""
    hit = F.expr("aggregate(sequence(0, cast(size(spans) / 2 as int)), 0L, (s, i) -> s + coalesce(get(spans, 2 * i + 1) - get(spans, 2 * i), 0L))")
    return found.select(
        key, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )

