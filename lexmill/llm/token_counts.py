"""Exact token counts at every prefix of a text.

For a merge-type vocabulary the encoding of a prefix is the encoding of a
shorter prefix plus one last token, and that token is the only one that forms
a stable pair with the last token of the shorter prefix (a pair is stable if
encoding its text gives the pair back). So one pass over the end positions
finds the last token, and with it the count, of every prefix. The pass runs
over the distinct chunks of a batch side by side; a text's table is the running
count of its chunks plus the table inside the chunk in which the prefix ends.

Null and empty texts have the table [0]. Rows are independent: repeated rows
give repeated results, ties cannot occur, an empty table gives an empty one,
further columns are not read. A chunk for which no stable token is found is
encoded prefix by prefix and counted by the sentencepiece library instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.bytescan import mix
from lexmill.llm.common import release, small_batches
from lexmill.llm.pieces import ROW_CHARS, HashIndex, PieceModel, chunks, loaded, model_bytes

#: Tables of chunks that a Python worker keeps.
KEPT_TABLES = 700_000
_STEP = np.int64(1_000_003)


class PrefixCounts:
    """Tables of chunks: table[i] is the number of tokens of the chunk's first i characters."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        by_len: dict[int, list[tuple[int, int]]] = {}
        for piece, i in model.index.items():
            by_len.setdefault(len(piece), []).append((self._key(piece), i))
        #: Only a piece that encodes to itself can be a token of an encoding; left and right are its last merge.
        self.left, self.right = np.full((2, model.n), -1, np.int64)
        self.rank = np.append(model.rank, -1)
        self.piece_at = {}
        for n, some in by_len.items():
            if n == 1:
                self.rank[[i for _, i in some]] = -1
                continue
            own = []
            for h, i in some:
                merges: list[tuple[int, int]] = []
                if model.agenda(model.pieces[i], merges) == [i]:
                    self.left[i], self.right[i] = merges[-1]
                    own.append((h, i))
            if own:
                self.piece_at[n] = HashIndex(*np.array(own, np.int64).T)
        self.pair_keys, self.pair_ok = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        self.total: dict[str, int] = {}
        #: Chunks of the group at hand that don't fit a row.
        self.far: list[str] = []
        #: int8 counts as bytes, or an array for a long chunk
        self.tables: dict[str, bytes | np.ndarray] = {}
        self.again: set[str] = set()

    @staticmethod
    def _key(s: str) -> int:
        h = 0
        for c in s:
            h = (h * int(_STEP) + ord(c)) % 2**64
        return h & (2**62 - 1)

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether encoding the text of symbol a and then b gives just these two."""
        key = (a << 22) | b
        slot = (mix(key.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
        known = self.pair_keys[slot] == key
        out = self.pair_ok[slot]
        if not known.all():
            new, back = np.unique(key[~known], return_inverse=True)
            ok = self.apart(new >> 22, new & (2**22 - 1))
            out[~known] = ok[back]
            slot = (mix(new.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
            self.pair_keys[slot], self.pair_ok[slot] = new, ok
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether nothing merges across the border of a and b.

        Goes back through the merges that made a's right end and b's left end,
        latest first; the two parts at the border must not form a piece that
        would have been merged before the part that was undone.
        """
        model, n = self.model, len(a)
        a, b, limit, ok, left = a.copy(), b.copy(), np.full(n, 2**40), np.ones(n, bool), np.arange(n)
        while len(left):
            x, y = a[left], b[left]
            both = model.pairs.get((x << 22) | y)
            bad = (both >= 0) & (model.rank[both] < limit[left])
            ok[left[bad]] = False
            left, x, y = left[~bad], x[~bad], y[~bad]
            rx, ry = self.rank[np.minimum(x, model.n)], self.rank[np.minimum(y, model.n)]
            more = (rx >= 0) | (ry >= 0)
            left, x, y, rx, ry = left[more], x[more], y[more], rx[more], ry[more]
            first = rx > ry
            limit[left] = np.where(first, rx, ry + 1)
            a[left[first]], b[left[~first]] = self.right[x[first]], self.left[y[~first]]
        return ok

    def rows(self, texts: list[str]) -> np.ndarray:
        """Tables of texts without NUL, longest first, one a row; -1 where no token fits."""
        model = self.model
        points = model.matrix(texts).astype(np.int64)
        n, width = points.shape
        lone = model.char[points]
        plain = lone < model.n
        cost = np.where(plain, 1, np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4))))
        last = np.full((n, width + 1), -1, np.int64)
        count = np.full((n, width + 1), -1, np.int32)
        count[:, 0] = 0
        #: hashes[k] of the k characters that end at a position
        with np.errstate(over="ignore"):
            running = np.zeros((n, width + 1), np.int64)
            for i in range(width):
                running[:, i + 1] = running[:, i] * _STEP + points[:, i]
            power = np.cumprod(np.full(model.longest + 1, _STEP, np.int64))
        active = np.searchsorted(-np.array(list(map(len, texts))), -np.arange(width + 1), "right")
        for i in range(1, width + 1):
            left = np.arange(active[i])
            for k in range(min(i, model.longest), 0, -1):
                if k == 1:
                    token, good = lone[left, i - 1], np.ones(len(left), bool)
                elif k in self.piece_at:
                    with np.errstate(over="ignore"):
                        h = running[left, i] - running[left, i - k] * power[k - 1]
                    token = self.piece_at[k].get(h & np.int64(2**62 - 1))
                    good = token >= 0
                else:
                    continue
                good &= count[left, i - k] >= 0
                if i > k:
                    at = np.flatnonzero(good)
                    good[at] = self.stable(last[left[at], i - k], token[at])
                won = left[good]
                last[won, i] = token[good]
                count[won, i] = count[won, i - k] + (cost[won, i - 1] if k == 1 else 1)
                left = left[~good]
                if not len(left):
                    break
        return count

    def slow(self, chunk: str) -> np.ndarray:
        """The table by encoding; of a long chunk by its tokens, with the inside of each by encoding."""
        ids = self.model.ids_of
        return np.array([0] + [len(ids(self.model.agenda(chunk[:i]))) for i in range(1, len(chunk) + 1)], np.int32)

    def learn(self, new: list[str]) -> None:
        short = []
        for c in new:
            if len(c) <= ROW_CHARS and "\0" not in c:
                short.append(c)
            else:
                self.far.append(c)
                self.tables[c] = self.long(c)
                self.total[c] = int(self.tables[c][-1])
        short.sort(key=len, reverse=True)
        for at in range(0, len(short), 1 << 16):
            part = short[at : at + (1 << 16)]
            counts = self.rows(part)
            sizes = np.array(list(map(len, part)))
            odd = np.flatnonzero((counts < 0).sum(1) > counts.shape[1] - 1 - sizes)
            total = counts[np.arange(len(part)), sizes].tolist()
            # a count below 128 a byte: a chunk of a row has at most 4 tokens a character
            flat, width = counts.astype(np.int8).tobytes(), counts.shape[1]
            self.tables.update(zip(part, [flat[a : a + n + 1] for a, n in zip(range(0, len(flat), width), sizes.tolist(), strict=True)], strict=True))
            self.total.update(zip(part, total, strict=True))
            for c in map(part.__getitem__, odd.tolist()):
                self.tables[c] = self.slow(c)
                self.total[c] = len(self.model.by_library([c])[0])

    def long(self, chunk: str) -> np.ndarray:
        """The same pass for one text, with a table of last tokens."""
        model, n = self.model, len(chunk)
        last, count, known = [-1] * (n + 1), [0] + [-1] * n, {}
        for i in range(1, n + 1):
            for k in range(min(i, model.longest), 0, -1):
                token = model.symbol(chunk[i - 1]) if k == 1 else model.index.get(chunk[i - k : i])
                if token is None or count[i - k] < 0:
                    continue
                key = (last[i - k], token)
                if key not in known:
                    if i == k:
                        known[key] = model.agenda(chunk[:k]) == [token]
                    else:
                        known[key] = model.agenda(model.string(key[0]) + chunk[i - k : i]) == list(key)
                if known[key]:
                    last[i], count[i] = token, count[i - k] + (len(chunk[i - 1].encode()) if token >= model.n else 1)
                    break
            else:  # no stable token ends here
                symbols = model.agenda(chunk[:i])
                last[i], count[i] = symbols[-1], len(model.ids_of(symbols))
        return np.array(count, np.int32)

    def know(self, met: set[str]) -> None:
        if len(self.tables) > KEPT_TABLES:  # forget the chunks that were met in one group only
            if len(self.again) > KEPT_TABLES // 2:
                self.again.clear()
            self.tables = {c: self.tables[c] for c in self.again}
            self.total = {c: self.total[c] for c in self.again}
        new = met.difference(self.tables)
        self.again.update(c for c in met - new if len(c) <= ROW_CHARS)
        self.learn(list(new))

    def drop_long(self) -> None:
        """Forget the tables of chunks beyond a row, which can be of any size."""
        for c in self.far:
            del self.tables[c], self.total[c]
        self.far.clear()

    def table(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for i = 0 .. len(text); chunks must be known."""
        parts = chunks(text)
        inner = [t if isinstance(t := self.tables[c], np.ndarray) else np.frombuffer(t, np.int8) for c in parts]
        inner = [t[1:] for t in inner]
        ends = np.cumsum([self.total[c] for c in parts[:-1]], dtype=np.int32) if len(parts) > 1 else np.zeros(0, np.int32)
        base = np.repeat(np.append(np.int32(0), ends), list(map(len, inner))) if parts else np.zeros(0, np.int32)
        # the model's own space before the text is no character of it
        return np.append(np.int32(0), (np.concatenate(inner) + base)[1:]) if parts else np.zeros(1, np.int32)

    def fitting(self, parts: list[str], budget: int) -> int:
        """Characters of the longest prefix of at most `budget` tokens: it ends in the last chunk that starts within the budget."""
        base, chars = 0, -1
        for c in parts:
            end = base + self.total[c]
            if end > budget:
                inside = np.asarray(self.tables[c] if isinstance(self.tables[c], np.ndarray) else np.frombuffer(self.tables[c], np.int8), np.int64)
                return max(0, chars + int(np.flatnonzero(base + inside <= budget)[-1]))
            base, chars = end, chars + len(c)
        return max(0, chars)


_kept: dict[int, PrefixCounts] = {}


def _tables(proto: bytes) -> PrefixCounts:
    model = loaded(proto)
    if id(model) not in _kept:
        _kept[id(model)] = PrefixCounts(model)
    return _kept[id(model)]


def _batches(batches: Iterator[pa.RecordBatch], proto: bytes, budget: int, whole: bool) -> Iterator[pa.RecordBatch]:
    counts = _tables(proto)
    for batch in batches:
        key, col = batch.column(0), batch.column(1)
        n_bytes, n_tokens, fits, tables = [], [], [], []
        group: list[str] = []
        size = 0
        for k, value in enumerate(col):
            group.append(value.as_py() or "")
            size += len(group[-1])
            if size > 1 << 20 or k == len(col) - 1:
                parts = [chunks(t) for t in group]
                counts.know(set().union(*parts))
                total = counts.total.__getitem__
                for t, p in zip(group, parts, strict=True):
                    n = sum(map(total, p))
                    n_bytes.append(len(t.encode()))
                    n_tokens.append(n)
                    fits.append(len(t) if n <= budget else counts.fitting(p, budget))
                    if whole:
                        tables.append(counts.table(t))
                counts.drop_long()
                group, size = [], 0
        arrays = [key, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(fits, pa.int64())]
        names = ["key", "n_bytes", "n_tokens", "fitting_chars"]
        if whole:
            arrays.append(pa.array(tables, pa.list_(pa.int32())))
            names.append("prefix_tokens")
        yield pa.RecordBatch.from_arrays(arrays, names)
    release()


def token_counts(
    df: DataFrame, model_path: str, budget: int, key: str = "doc_id", text: str = "text", whole: bool = False
) -> DataFrame:
    """(key, n_bytes, n_tokens, fitting_chars[, prefix_tokens]) of each row's whole text.

    fitting_chars is the length in characters of the longest prefix of at most
    `budget` tokens; prefix_tokens, on request, is the count at every prefix.
    """
    small_batches(df.sparkSession)
    proto = model_bytes(model_path)
    src = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_bytes long, n_tokens long, fitting_chars long" + ", prefix_tokens array<int>" * whole
    return src.mapInArrow(lambda it: _batches(it, proto, budget, whole), schema).withColumnRenamed("key", key)
