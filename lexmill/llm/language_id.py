"""Language identification by Bayesian fusion of evidence.

Per row the log posterior of each language adds up
* the text: byte trigrams under a naive Bayes model, tempered because
  neighbouring trigrams aren't independent; the class `und` (noise) has a
  uniform model;
* the declared language (markup or metadata), right with a stated reliability;
* the address: its suffix and a language code as a path segment;
* the prior of the host, smoothed towards its domain, that towards the suffix,
  that towards the corpus. The counts are aggregated from all rows' text
  evidence; a row's own count is taken out of its prior.
The trigram model is fitted on at most TRAIN_ROWS labelled rows, picked by the
hash of their key and text; everything else covers all rows.

Rejected are rows without a letter and rows whose best class is `und`. Null
and empty texts have no text evidence and are rejected. Missing declarations,
addresses and hosts are no evidence. Ties go to the first language in order;
repeated rows get equal results; empty tables give empty results; further
columns are kept, but for those named like the results, which give way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.bytescan import LOWER, blocks
from lexmill.llm.common import cut, small_batches

LANGUAGES = ("en", "fr", "de", "es")
CLASSES = (*LANGUAGES, "und")
#: Rows that the trigram model is fitted on, at most.
TRAIN_ROWS = 2000
BUCKETS = 1 << 15
#: Weight of a trigram, reliability of a declaration, weight of an address hint, and prior of noise.
TEMPER, RELIABLE, HINT, NOISE = 0.25, 0.85, 2.0, 1e-4
RESULTS = ("language", "confidence", "text_language", "declared_language", "rejected")
#: Pseudo-counts of each level of the host prior.
SMOOTH = 5.0
HOT_SHARE, SALTS = 500, 64

_FOLD = LOWER.copy()
_FOLD[: ord("a")] = 32
_FOLD[ord("A") : ord("Z") + 1] = np.arange(97, 123)
_FOLD[123:128] = 32


def _trigrams(buf: np.ndarray) -> np.ndarray:
    x = _FOLD[buf].astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64)
    h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
    return (h >> np.uint32(17)).astype(np.int64)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, n): counts of each class's trigrams in rows (text, label)."""
    counts = np.zeros((len(LANGUAGES), BUCKETS), np.int64)
    for batch in batches:
        labels = batch.column(1).to_pylist()
        for first, _, buf, offs in blocks(batch.column(0)):
            for k, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                if labels[first + k] in LANGUAGES:
                    counts[LANGUAGES.index(labels[first + k])] += np.bincount(_trigrams(buf[a:b]), minlength=BUCKETS)
    cell = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(counts.ravel()[cell])], ["cell", "n"])


def fit(rows: DataFrame) -> np.ndarray:
    """Log probabilities [class, bucket] from labelled rows (text, label); only the counts reach the driver."""
    found = rows.mapInArrow(_labelled, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((len(CLASSES), BUCKETS), 0.05)
    counts.ravel()[found["cell"].to_numpy()] += found["n"].to_numpy()
    counts[-1] = 1.0
    # what no language has shown is as likely under each of them as under noise
    p = counts / counts.sum(1, keepdims=True)
    p[:-1] = 0.98 * p[:-1] + 0.02 / BUCKETS
    return np.log(p)


def _likelihoods(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    logp = table.value.astype(np.float32)
    letters = _FOLD != 32
    for batch in batches:
        n_letters, ll = [], []
        for _, _, buf, offs in blocks(batch.column(0)):
            grams = _trigrams(buf)
            a, b = offs[:-1], np.maximum(offs[1:] - 2, offs[:-1])
            own = np.zeros((len(a), len(CLASSES)))
            for c in range(len(CLASSES)):
                run = np.concatenate([[0.0], np.cumsum(logp[c][grams], dtype=np.float64)])
                own[:, c] = run[np.minimum(b, len(run) - 1)] - run[np.minimum(a, len(run) - 1)]
            run = np.concatenate([[0], np.cumsum(letters[buf])])
            n_letters.append(run[offs[1:]] - run[offs[:-1]])
            ll.append(own)
        ll = np.concatenate(ll) if ll else np.zeros((0, len(CLASSES)))
        n_letters = np.concatenate(n_letters) if n_letters else np.zeros(0, np.int64)
        offsets = np.arange(len(ll) + 1, dtype=np.int32) * len(CLASSES)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array(n_letters, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ll.ravel()))],
            [*batch.schema.names[1:], "__letters", "__ll"],
        )


def address_hint(address: Column) -> Column:
    """The language that an address's suffix or a path segment names, or null."""
    codes = "|".join(LANGUAGES)
    host = F.regexp_extract(address, r"^[a-z]+://([^/:?#]+)", 1)
    suffix = F.regexp_extract(host, rf"\.({codes})$", 1)
    segment = F.regexp_extract(address, rf"^[a-z]+://[^/]+/(?:.*/)?({codes})(?:[/?#]|$)", 1)
    return F.coalesce(F.nullif(segment, F.lit("")), F.nullif(suffix, F.lit("")))


def identify(
    df: DataFrame, key: str, text: str, declared: Column | None = None, address: Column | None = None,
    host: Column | None = None, label: Column | None = None, train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """`df` without the text, with language, confidence, declared_language, text_language and rejected."""
    spark = df.sparkSession
    small_batches(spark)
    none = F.lit(None).cast("string")
    declared = none if declared is None else declared
    label = declared if label is None else label
    address = none if address is None else address
    host = F.nullif(F.regexp_extract(address, r"^[a-z]+://([^/:?#]+)", 1), F.lit("")) if host is None else host
    train = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), label.alias("l")).where(F.col("l").isin(*LANGUAGES))
    labelled = train.select("l").count()
    if labelled > train_rows:
        train = train.where(F.pmod(F.xxhash64("k", "t"), F.lit(2**40)) < int(2**40 * 0.9 * train_rows / labelled))
    table = spark.sparkContext.broadcast(fit(train.select("t", "l").limit(train_rows)))
    kept = [c for c in df.columns if c not in (text, *RESULTS)]
    src = df.select(
        F.col(text).cast("string").alias("__text"), F.struct(*(F.col(f"`{c}`") for c in kept)).alias("__row"), F.xxhash64(key).alias("__key"),
        F.lower(F.substring(F.trim(declared), 1, 2)).alias("__declared"), address_hint(F.lower(address)).alias("__hint"), F.lower(host).alias("__host"),
    )
    src = src.withColumns(
        {"__domain": F.regexp_extract("__host", r"([^.]+\.[^.]+)$", 1), "__suffix": F.regexp_extract("__host", r"([^.]+)$", 1)}
    )
    schema = src.drop("__text").schema.add("__letters", T.LongType()).add("__ll", T.ArrayType(T.DoubleType()))
    seen = cut(src.mapInArrow(lambda it: _likelihoods(it, table), schema))

    def best(values: Column) -> Column:
        """Index of the largest value, the first of equals."""
        return F.array_position(values, F.array_max(values)).cast("int") - 1

    seen = seen.withColumn("__by_text", F.when(F.col("__letters") > 0, best(F.col("__ll"))))
    votes = seen.where("__by_text is not null")
    one_hot = [F.count_if(F.col("__by_text") == c).cast("double") for c in range(len(CLASSES))]
    levels = ("__host", "__domain", "__suffix")
    every = votes.agg(F.array(*one_hot).alias("n")).first()["n"]
    total = sum(every) + len(CLASSES)
    corpus = F.array(*(F.lit((n + 1) / total) for n in every))
    counts = {x: votes.where(F.col(x).isNotNull()).groupBy(x).agg(F.array(*one_hot).alias(f"{x}_n")) for x in levels}
    # hosts know their domain and suffix: the chain of priors is joined to the rows by host once
    hosts = counts["__host"].withColumns(
        {"__domain": F.regexp_extract("__host", r"([^.]+\.[^.]+)$", 1), "__suffix": F.regexp_extract("__host", r"([^.]+)$", 1)}
    )
    hosts = hosts.join(counts["__domain"], "__domain", "left").join(counts["__suffix"], "__suffix", "left")
    # hosts with over a HOT_SHARE-th of the rows, at most HOT_SHARE of them, are dealt over SALTS tasks
    hosts = cut(hosts.drop("__domain", "__suffix"))
    votes_of = F.aggregate("__host_n", F.lit(0.0), lambda s, x: s + x)
    hot = F.broadcast(hosts.where(votes_of * HOT_SHARE > float(sum(every))).select("__host", F.lit(True).alias("__hot")))
    salts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    hosts = hosts.join(hot, "__host", "left").withColumn("__salt", F.explode(salts)).drop("__hot")
    salted = seen.drop("__domain", "__suffix").join(hot, "__host", "left")
    # rows without a host meet nothing, and are dealt out likewise
    drawn = F.pmod(F.xxhash64("__key", "__letters"), F.lit(SALTS)).cast("int")
    salted = salted.withColumn("__salt", F.when(F.col("__hot") | F.col("__host").isNull(), drawn).otherwise(0))
    full = salted.join(hosts, ["__host", "__salt"], "left")
    own = F.array(*(F.when(F.col("__by_text") == c, 1.0).otherwise(0.0) for c in range(len(CLASSES))))

    def smoothed(n: str, above: Column) -> Column:
        less = F.when(F.col(n).isNotNull(), F.zip_with(n, own, lambda a, b: F.greatest(a - b, F.lit(0.0))))
        size = F.aggregate(less, F.lit(0.0), lambda s, x: s + x)
        return F.when(F.col(n).isNull(), above).otherwise(F.zip_with(less, above, lambda a, p: (a + SMOOTH * p) / (size + SMOOTH)))

    full = full.withColumn("__p2", smoothed("__suffix_n", corpus))
    full = full.withColumn("__p1", smoothed("__domain_n", F.col("__p2")))
    full = full.withColumn("__p0", smoothed("__host_n", F.col("__p1")))
    known = F.col("__declared").isin(*LANGUAGES)
    parts = []
    for c, name in enumerate(CLASSES):
        prior = F.get("__p0", F.lit(c)) if name != "und" else F.least(F.get("__p0", F.lit(c)), F.lit(NOISE))
        said = F.when(~F.coalesce(known, F.lit(False)), 0.0).when(F.col("__declared") == name, float(np.log(RELIABLE)))
        said = said.otherwise(float(np.log((1 - RELIABLE) / (len(CLASSES) - 1))))
        hint = F.when(F.col("__hint") == name, HINT).otherwise(0.0)
        parts.append(F.log(F.greatest(prior, F.lit(1e-12))) + TEMPER * F.get("__ll", F.lit(c)) + said + hint)
    full = full.withColumn("__post", F.array(*parts))
    full = full.withColumn("__z", F.aggregate(F.transform("__post", lambda x: F.exp(x - F.array_max("__post"))), F.lit(0.0), lambda s, x: s + x))
    names = F.array(*map(F.lit, CLASSES))
    full = full.withColumns(
        {
            "language": F.get(names, best(F.col("__post"))), "confidence": 1 / F.col("__z"),
            "text_language": F.get(names, F.col("__by_text")), "declared_language": F.col("__declared"),
        }
    )
    full = full.withColumn("rejected", (F.col("__letters") == 0) | (F.col("language") == "und"))
    return full.select(*(F.col("__row").getField(c).alias(c) for c in kept), *RESULTS)


def page_text(html: Column) -> Column:
    """Visible text of markup."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(bare, r"&[a-zA-Z]+;|&#\d+;", " ")


def markup_language(html: Column) -> Column:
    """The language that the html element declares."""
    return F.nullif(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2})""", 1), F.lit(""))
