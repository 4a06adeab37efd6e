"""Document scores under a masked pseudo-likelihood language model.

A window network predicts each token from the two before and the two after it,
never from itself; a document's score is the sum of these conditional log
probabilities. Words (runs of bytes other than white space, A-Z lower-cased)
are counted over all documents in buckets of their hashes, at least twice as
many buckets as words have been met, up to 2**MAX_BITS (what a worker holds). The
most frequent buckets are classes of their own. The others are dealt over
classes by the company they keep: how often each of the frequent words stands
before and after them, in all documents, under a mixture fitted to the most
frequent of them. The network gives the class between its neighbours, the counts
give the word within it.

Everything is gathered on the cluster: each task sends its counts, and after
each round the parameters that it has trained on its documents, entry by entry.
Counts and classes grow with the words of the corpus; the network's size and the
number of classes are fixed. Every token of every document is a target of
training in each round; rounds average the tasks' parameters by their number of
tokens.

Null, empty and blank texts have no tokens and the score 0. Repeated rows count
and score as often as they occur. Documents of one token are predicted from the
border alone. An empty table gives an empty result. Columns other than the key
and the text are not read. Sums run in floating point and in the order of the
partitions, so scores of differently partitioned inputs may differ slightly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.bytescan import LOWER, blocks, byte_class, word_hashes
from lexmill.llm.common import cut, small_batches

WORD_BYTES = byte_class((0x20, 0x20), (0x09, 0x0D))
CLASSES, OWN_CLASS = 96, 64
#: Fewest and most bits of a bucket, and bits that are counted.
MIN_BITS, MAX_BITS, COUNT_BITS = 14, 22, 23
#: Frequent words whose company is counted, buckets that the mixture is fitted to at most, and its rounds.
COMPANY, FITTED, EM_ROUNDS = 32, 4096, 12
OFFSETS = (-2, -1, 1, 2)
HIDDEN, ROUNDS, BATCH = 32, 2, 1024
_CHUNK = 4096
#: Distinct keys that a task gathers before it sends them.
_GATHERED = 1 << 21


class Vocabulary:
    """Class of each bucket and its log probability within the class."""

    def __init__(self, counts: np.ndarray, cls: np.ndarray | None = None) -> None:
        self.bits = int(len(counts)).bit_length() - 1
        order = np.lexsort((np.arange(len(counts)), -counts))
        self.frequent = order[:OWN_CLASS]
        #: Without company all others are one class.
        self.cls = np.full(len(counts), OWN_CLASS, np.int8) if cls is None else cls.astype(np.int8)
        self.cls[self.frequent] = np.arange(OWN_CLASS)
        smooth = counts + 0.5
        total = np.bincount(self.cls, smooth, CLASSES)
        self.within = np.log(smooth / total[self.cls]).astype(np.float32)

    def buckets(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Buckets of a column's tokens and documents' offsets, block by block."""
        for fine, at in _buckets(column):
            yield fine >> (COUNT_BITS - self.bits), at


def bucket_bits(distinct: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, int(2 * distinct - 1).bit_length()))


def mixture(profiles: np.ndarray, classes: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Log priors and log probabilities [class, company] of a mixture of multinomials, by expectation and maximisation."""
    r = np.random.default_rng(seed)
    n, width = profiles.shape
    share = r.dirichlet(np.full(classes, 0.3), n) if n else np.zeros((0, classes))
    for _ in range(EM_ROUNDS):
        prior = np.log((share.sum(0) + 1) / (n + classes))
        mass = share.T @ profiles + 0.1
        logp = np.log(mass / mass.sum(1, keepdims=True))
        # long profiles are tempered, so that no word decides for itself alone
        post = prior + (profiles @ logp.T) * np.minimum(1, 200 / np.maximum(profiles.sum(1, keepdims=True), 1))
        post = np.exp(post - post.max(1, keepdims=True, initial=-1e30))
        share = post / post.sum(1, keepdims=True)
    return prior, logp


class Network:
    """Sum of the neighbours' embeddings by offset, tanh, class logits. Class number CLASSES is the border."""

    SHAPES = {"E": (len(OFFSETS), CLASSES + 1, HIDDEN), "b": (HIDDEN,), "O": (HIDDEN, CLASSES), "o": (CLASSES,)}

    def __init__(self, flat: np.ndarray | None = None, seed: int = 5) -> None:
        if flat is None:
            r = np.random.default_rng(seed)
            self.p = {k: (r.standard_normal(s) * (0.1 if k in "EO" else 0)).astype(np.float32) for k, s in self.SHAPES.items()}
        else:
            self.p, at = {}, 0
            for k, s in self.SHAPES.items():
                n = int(np.prod(s))
                self.p[k] = flat[at : at + n].reshape(s).astype(np.float32)
                at += n

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.SHAPES])

    def hidden(self, context: np.ndarray) -> np.ndarray:
        e = self.p["E"]
        out = e[0][context[:, 0]]
        for k in range(1, len(OFFSETS)):
            out += e[k][context[:, k]]
        out += self.p["b"]
        return np.tanh(out, out=out)

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log probability of each target class between its neighbours' classes."""
        out = np.empty(len(target), np.float32)
        for a in range(0, len(target), _CHUNK):
            z = self.hidden(context[a : a + _CHUNK]) @ self.p["O"]
            z += self.p["o"]
            own = z[np.arange(len(z)), target[a : a + _CHUNK]]
            z -= z.max(1, keepdims=True, initial=-1e30) if (top := float(np.abs(z).max(initial=0))) > 60 else 0
            if top > 60:
                own = z[np.arange(len(z)), target[a : a + _CHUNK]]
            out[a : a + _CHUNK] = own - np.log(np.exp(z, out=z).sum(1))
        return out

    def train(self, line: np.ndarray, rate: float) -> int:
        """One pass of Adagrad over all tokens of a line of documents, in batches; returns their number."""
        shapes = list(self.SHAPES.items())
        cuts = np.cumsum([int(np.prod(s)) for _, s in shapes])[:-1]
        flat = self.flat()
        self.p = {k: v.reshape(s) for (k, s), v in zip(shapes, np.split(flat, cuts), strict=True)}  # views of flat
        square, g = np.full_like(flat, 1e-4), np.empty_like(flat)
        part = {k: v.reshape(s) for (k, s), v in zip(shapes, np.split(g, cuts), strict=True)}
        reach, done = max(OFFSETS), 0
        for a in range(reach, len(line) - reach, BATCH):
            b = min(a + BATCH, len(line) - reach)
            y = line[a:b]
            real = np.flatnonzero(y != CLASSES)  # borders are neighbours, not targets
            if not len(real):
                continue
            done += len(real)
            h = self.p["E"][0][line[a + OFFSETS[0] : b + OFFSETS[0]]]
            for k in range(1, len(OFFSETS)):
                h += self.p["E"][k][line[a + OFFSETS[k] : b + OFFSETS[k]]]
            h += self.p["b"]
            np.tanh(h, out=h)
            z = h @ self.p["O"]
            z += self.p["o"]
            if float(np.abs(z).max()) > 60:
                z -= z.max(1, keepdims=True)
            np.exp(z, out=z)
            scale = np.zeros(b - a, np.float32)
            scale[real] = 1 / len(real)
            z *= (scale / z.sum(1))[:, None]
            z[real, y[real]] -= scale[real]
            dh = z @ self.p["O"].T
            dh *= 1 - h * h
            np.matmul(h.T, z, out=part["O"])
            z.sum(0, out=part["o"])
            dh.sum(0, out=part["b"])
            # the batch's places and their neighbours by class: one order serves all offsets
            near = line[a - reach : b + reach]
            order = np.argsort(near, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], near[order[1:]] != near[order[:-1]]]))
            wide = np.zeros((b - a + 4 * reach, HIDDEN), np.float32)
            wide[2 * reach : 2 * reach + b - a] = dh
            part["E"][:] = 0
            for k, o in enumerate(OFFSETS):
                part["E"][k][near[order[first]]] = np.add.reduceat(wide[order + reach - o], first)
            square += g * g
            flat -= rate * g / np.sqrt(square)
        return done


def _buckets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for _, _, buf, offs in blocks(column):
        w, at = word_hashes(LOWER[buf], offs, WORD_BYTES)
        yield (w >> np.uint64(64 - COUNT_BITS)).astype(np.int64), at


def lined(cls: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents' classes in one line with two borders before, between and after them; places of the tokens."""
    size = np.diff(at)
    place = np.arange(len(cls)) + 2 * (np.repeat(np.arange(len(size)), size) + 1)
    line = np.full(len(cls) + 2 * (len(size) + 1), CLASSES, np.int64)
    line[place] = cls
    return line, place


def contexts(cls: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Classes of each token's neighbours within its document."""
    line, place = lined(cls, at)
    return np.stack([line[place + k] for k in OFFSETS], 1)


class Tally:
    """Counts of keys, merged and given out whenever many have been gathered."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > _GATHERED:
            self.merge()
            if self.size > _GATHERED // 2:
                yield self.rows()

    def merge(self) -> None:
        if len(self.parts) > 1:
            keys, at = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
            self.parts = [(keys, np.bincount(at, np.concatenate([n for _, n in self.parts]), len(keys)).astype(np.int64))]
        self.size = sum(len(k) for k, _ in self.parts)

    def rows(self) -> pa.RecordBatch:
        self.merge()
        keys, n = self.parts[0] if self.parts else (np.zeros(0, np.int64),) * 2
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["k", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, n): tokens of each bucket."""
    tally = Tally()
    for batch in batches:
        found = [bucket for bucket, _ in _buckets(batch.column(0))]
        if found:
            yield from tally.add(np.concatenate(found))
    yield tally.rows()


def _company(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    """(k, n): how often a bucket (k // 2 COMPANY) has a frequent word before it (first COMPANY cells) or after it."""
    words, tally = vocabulary.value, Tally()
    for batch in batches:
        found = []
        for bucket, at in words.buckets(batch.column(0)):
            cls = words.cls[bucket].astype(np.int64)
            line, place = lined(np.where(cls < COMPANY, cls, CLASSES), at)
            for side, near in enumerate((line[place - 1], line[place + 1])):
                some = (near < COMPANY) & (cls >= OWN_CLASS)
                found.append(bucket[some] * (2 * COMPANY) + side * COMPANY + near[some])
        if found:
            yield from tally.add(np.concatenate(found))
    yield tally.rows()


def _dealt(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """(bucket, cls) of rows (bucket, cells, n): the class under which a bucket's company is likeliest."""
    prior, logp = model.value
    for batch in batches:
        cells, size = batch.column(1), np.diff(batch.column(1).offsets.to_numpy())
        row = np.repeat(np.arange(batch.num_rows), size)
        weight = batch.column(2).flatten().to_numpy().astype(np.float64)
        scale = np.minimum(1, 200 / np.maximum(np.bincount(row, weight, batch.num_rows), 1))
        like = np.zeros((batch.num_rows, len(prior)))
        np.add.at(like, row, weight[:, None] * logp.T[cells.flatten().to_numpy()])
        best = (prior + like * scale[:, None]).argmax(1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((OWN_CLASS + best).astype(np.int8))], ["bucket", "cls"])


def _train(batches: Iterator[pa.RecordBatch], vocabulary, flat, rate: float) -> Iterator[pa.RecordBatch]:
    net, cls_of, n = Network(flat.value), vocabulary.value.cls, 0
    for batch in batches:
        for bucket, at in vocabulary.value.buckets(batch.column(0)):
            n += net.train(lined(cls_of[bucket].astype(np.int64), at)[0], rate)
    if n:
        values = net.flat().astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values * n), pa.array(np.full(len(values), n, np.int64))], ["entry", "value", "n"]
        )


def _score(batches: Iterator[pa.RecordBatch], vocabulary, flat) -> Iterator[pa.RecordBatch]:
    net, words = Network(flat.value), vocabulary.value
    for batch in batches:
        sizes, sums = [], []
        for bucket, at in words.buckets(batch.column(1)):
            cls = words.cls[bucket].astype(np.int64)
            each = net.log_probability(contexts(cls, at), cls) + words.within[bucket]
            run = np.concatenate([[0.0], np.cumsum(each, dtype=np.float64)])
            sizes.append(np.diff(at))
            sums.append(run[at[1:]] - run[at[:-1]])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.concatenate(sizes) if sizes else [], pa.int64()), pa.array(np.concatenate(sums) if sums else [], pa.float64())],
            ["key", "n_tokens", "log_likelihood"],
        )


def vocabulary(src: DataFrame) -> Vocabulary:
    """Counts of all words, and their classes by the company they keep."""
    spark = src.sparkSession
    rows = src.mapInArrow(_count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # 2**COUNT_BITS rows at most
    bits = bucket_bits(len(rows))
    counts = np.zeros(1 << bits, np.int64)
    for batch in rows.to_batches():
        np.add.at(counts, batch.column(0).to_numpy() >> (COUNT_BITS - bits), batch.column(1).to_numpy())
    del rows
    words = Vocabulary(counts)
    others = np.lexsort((np.arange(len(counts)), -counts))[OWN_CLASS : OWN_CLASS + FITTED]
    others = others[counts[others] > 0]
    if not len(others):
        return words
    shared, width = spark.sparkContext.broadcast(words), 2 * COMPANY
    cells = src.mapInArrow(lambda it: _company(it, shared), "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    cells = cut(cells.select(F.floor(F.col("k") / width).alias("bucket"), (F.col("k") % width).cast("int").alias("cell"), "n"))
    chosen = spark.createDataFrame([(int(x),) for x in others], "bucket long")
    some = cells.join(F.broadcast(chosen), "bucket").toArrow()  # FITTED * 2 COMPANY rows at most
    profiles = np.zeros((len(others), width))
    place = np.zeros(len(counts), np.int64)
    place[others] = np.arange(len(others))
    profiles[place[some["bucket"].to_numpy()], some["cell"].to_numpy()] = some["n"].to_numpy()
    model = mixture(profiles, CLASSES - OWN_CLASS)
    best = spark.sparkContext.broadcast(model)
    each = cells.groupBy("bucket").agg(F.collect_list(F.struct("cell", "n")).alias("x")).select("bucket", F.col("x.cell").alias("cells"), F.col("x.n").alias("n"))
    got = each.mapInArrow(lambda it: _dealt(it, best), "bucket long, cls byte").toArrow()  # a row a bucket at most
    cls = np.full(len(counts), OWN_CLASS + int(model[0].argmax()), np.int8)
    cls[got["bucket"].to_numpy()] = got["cls"].to_numpy()
    return Vocabulary(counts, cls)


def fit(df: DataFrame, text: str = "text", rounds: int = ROUNDS) -> tuple[Vocabulary, Network]:
    """Counts of all tokens, and the network trained over all documents."""
    spark = df.sparkSession
    small_batches(spark)
    src = df.select(F.col(text).cast("string").alias("text"))
    words, net = vocabulary(src), Network()
    shared = spark.sparkContext.broadcast(words)
    for k in range(rounds):
        flat = spark.sparkContext.broadcast(net.flat())
        got = src.mapInArrow(lambda it, f=flat, r=0.05 / (1 + k): _train(it, shared, f, r), "entry int, value double, n long")
        got = got.groupBy("entry").agg((F.sum("value") / F.sum("n")).alias("value")).toArrow()  # one row a parameter
        if len(got):
            values = np.zeros(len(net.flat()))
            values[got["entry"].to_numpy()] = got["value"].to_numpy()
            net = Network(values)
    return words, net


def score(df: DataFrame, words: Vocabulary, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, log_likelihood, per_token) of each row's whole text."""
    spark = df.sparkSession
    shared, flat = spark.sparkContext.broadcast(words), spark.sparkContext.broadcast(net.flat())
    src = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    out = src.mapInArrow(lambda it: _score(it, shared, flat), f"key {kind}, n_tokens long, log_likelihood double")
    return out.withColumn("per_token", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))).withColumnRenamed("key", key)


def lm_scores(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all rows under a model of the same rows."""
    return score(df, *fit(df, text), key, text)
