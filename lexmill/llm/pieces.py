"""Merge-type SentencePiece vocabularies in numpy.

`PieceModel.encode` merges adjacent symbols in score order, for many short
pieces of text at once: each row is a text with its own agenda of adjacent
pairs, and in each round every row merges its best pair (the leftmost of
equals), as a priority queue would. `agenda` does the same for one text with a
heap. Text is cut before each run of spaces and around line feeds, which no
piece of such a vocabulary crosses, so what is merged is short.
"""

from __future__ import annotations

import heapq
import re

import numpy as np

from lexmill.llm.bytescan import mix

SPACE = "▁"
#: Longer texts go through the heap rather than the padded rows.
ROW_CHARS = 24
NONE = np.int64(2**31 - 1)


class HashIndex:
    """A read-only map from distinct int64 keys to int64 values, by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(8, int(4 * max(len(keys), 1) - 1).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        left, slot, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(left):
            at = (slot[left] + self.probes) & ((1 << self.bits) - 1)
            free = self.keys[at] == -1
            _, one = np.unique(at[free], return_index=True)
            won = left[free][one]
            self.keys[at[free][one]], self.values[at[free][one]] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is missing."""
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        left = np.flatnonzero((found != keys) & (found != -1))
        for _ in range(1, self.probes):
            if not len(left):
                break
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found != -1)]
        return out


class PieceModel:
    """A merge-type model read through the sentencepiece library."""

    def __init__(self, proto: bytes) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = self.n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.index = {p: i for i, (p, s) in enumerate(zip(self.pieces, special, strict=True)) if not s}
        if any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in self.index):
            raise ValueError("a piece crosses the borders of the chunks")
        scores = np.array([sp.get_score(i) for i in range(n)])
        rank = np.searchsorted(np.unique(-scores), -scores)  # 0 is the best score; equal scores share a rank
        #: A symbol is a piece's id, or n + code point for a character that is no piece.
        left, right, to = [], [], []
        for p, i in self.index.items():
            for k in range(1, len(p)):
                a, b = self.symbol(p[:k]), self.symbol(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), to.append(i)
        self.rank = rank
        self.pairs = HashIndex((np.array(left, np.int64) << 22) | np.array(right, np.int64), np.array(to, np.int64))
        self.best = {(a, b): (int(rank[i]), i) for a, b, i in zip(left, right, to, strict=True)}
        self.char = np.arange(n, n + 0x110000, dtype=np.int64)
        for p, i in self.index.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.text = [str(i) for i in range(n)]
        self.longest = max(map(len, self.index))

    def symbol(self, s: str) -> int | None:
        return self.index.get(s, self.n + ord(s) if len(s) == 1 else None)

    def string(self, symbol: int) -> str:
        return self.pieces[symbol] if symbol < self.n else chr(symbol - self.n)

    def ids_of(self, symbols: list[int]) -> list[int]:
        """Ids of symbols; a character that is no piece becomes its bytes."""
        if max(symbols) < self.n:
            return symbols
        out: list[int] = []
        for s in symbols:
            out += [s] if s < self.n else [self.byte_id[b] for b in chr(s - self.n).encode()]
        return out

    def agenda(self, text: str, merges: list | None = None) -> list[int]:
        """Symbols of one text: a heap of adjacent pairs by score, then place. merges: gets the merged pairs."""
        sym = [self.symbol(c) for c in text]
        size, after, before = [1] * len(sym), list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap = [(*self.best[p], i, i + 1, 2) for i, p in enumerate(zip(sym, sym[1:], strict=False)) if p in self.best]
        heap = [(r, i, j, to, n) for r, to, i, j, n in heap]
        heapq.heapify(heap)
        while heap:
            _, i, j, to, n = heapq.heappop(heap)
            if not size[i] or not size[j] or size[i] + size[j] != n or after[i] != j:
                continue
            if merges is not None:
                merges.append((sym[i], sym[j]))
            sym[i], size[i], size[j], after[i] = to, n, 0, after[j]
            if after[j] < len(sym):
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(sym) and (found := self.best.get((sym[a], sym[b]))):
                    heapq.heappush(heap, (found[0], a, b, found[1], size[a] + size[b]))
        return [s for s, n in zip(sym, size, strict=True) if n]

    def matrix(self, texts: list[str]) -> np.ndarray:
        """Code points of texts without NUL, one row each, padded with 0."""
        points = np.array(texts, dtype=np.str_)
        return points.view(np.uint32).reshape(len(texts), -1)

    def rows(self, sym: np.ndarray) -> np.ndarray:
        """Merge each row of symbols, padded with -1, as far as scores allow."""
        n, width = sym.shape
        done = np.full((n, width), -1, np.int64)
        if width == 1:
            return sym
        rank = self._ranks(sym[:, :-1], sym[:, 1:])
        alive = np.arange(n)
        while len(alive):
            at = rank.argmin(1)
            more = rank[np.arange(len(at)), at] < NONE
            if not more.all():
                done[alive[~more], : sym.shape[1]] = sym[~more]
                sym, rank, alive, at = sym[more], rank[more], alive[more], at[more]
                if not len(alive):
                    break
            row, width = np.arange(len(at)), sym.shape[1]
            merged = self.pairs.get((sym[row, at] << 22) | sym[row, at + 1])
            keep = np.arange(width - 1)
            sym = np.take_along_axis(sym, keep + (keep > at[:, None]), 1)
            sym[row, at] = merged
            if width == 2:
                done[alive, :1] = sym
                break
            keep = np.arange(width - 2)
            rank = np.take_along_axis(rank, keep + (keep >= at[:, None]), 1)
            for step in (-1, 0):
                p = at + step
                ok = (p >= 0) & (p < width - 2)
                rank[row[ok], p[ok]] = self._ranks(sym[row[ok], p[ok]], sym[row[ok], p[ok] + 1])
        return done

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        to = self.pairs.get(((a << 22) | np.maximum(b, 0)).ravel()).reshape(a.shape)
        return np.where((to >= 0) & (b >= 0) & (a >= 0), self.rank[to], NONE)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Symbols of each text, by agenda."""
        out: list = [None] * len(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        odd = (sizes > ROW_CHARS) | (sizes == 0)
        if "\0" in "".join(texts):
            odd |= np.fromiter(("\0" in s for s in texts), bool, len(texts))
        for k in np.flatnonzero(odd).tolist():
            out[k] = self.agenda(texts[k])
        rows = np.flatnonzero(~odd)
        rows = rows[np.argsort(sizes[rows], kind="stable")]
        width = (sizes[rows] + 3) // 4
        for some in np.split(rows, np.flatnonzero(np.diff(width)) + 1):
            for at in range(0, len(some), 1 << 15):
                ks = some[at : at + (1 << 15)].tolist()
                points = self.matrix([texts[k] for k in ks])
                merged = self.rows(np.where(points > 0, self.char[points], -1))
                counts = (merged >= 0).sum(1)
                order = np.argsort(counts, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(counts[order])) + 1):  # rows of one length are lists as they are
                    if len(part):
                        for k, m in zip(part.tolist(), merged[part, : counts[part[0]]].tolist(), strict=True):
                            out[ks[k]] = m
        return out

    def by_library(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks by the library; the space or line feed before a chunk is left out again."""
        lead = [c[0] == SPACE for c in chunks]
        plain = [c[1:] if s else "\n" + c for c, s in zip(chunks, lead, strict=True)]
        found = self.library.encode([p.replace(SPACE, " ") for p in plain], num_threads=1)
        # the library drops the space that it puts before an empty text
        return [
            (ids or [self.index[SPACE]]) if s else ids[2:] for ids, s in zip(found, lead, strict=True)
        ]


_CHUNK = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


def chunks(text: str) -> list[str]:
    """Parts of a text that are merged on their own, with the model's space before the first."""
    return _CHUNK.findall(SPACE + text.replace(" ", SPACE)) if text else []


_loaded: dict[int, PieceModel] = {}


def loaded(proto: bytes) -> PieceModel:
    """The model of these bytes, kept for this Python worker."""
    key = hash(proto)
    if key not in _loaded:
        _loaded[key] = PieceModel(proto)
    return _loaded[key]


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
