"""Personal data: exact patterns, and a character tagger for what they miss.

The base patterns (e-mail, address of a host, card, phone) are matched leftmost
and without overlap per kind over the whole text. A bidirectional LSTM with CRF
transitions, trained here in numpy on labelled spans, adds spans of the same
kinds in other spellings (a phone without a plus, spaced or bracketed parts) and
secrets: keys, tokens and passwords that a text gives a value to. A span of any
kind holds a digit or an at sign, so the tagger reads exactly the windows that
hold one; windows overlap by half. Each is decoded by itself. Spans
cut off by a window's border give way to the neighbour window's; those that no
window holds whole are joined and decoded again in a window around them, which
grows until its border cuts none of them. Over the whole text the decoded spans
are then reconciled: of overlapping ones the set of the largest total score
stays, and base spans always stay.

Null and empty texts have no spans. Rows are independent: repeated rows give
repeated results, an empty table gives an empty one, further columns are not
read. Equal scores go to the earlier span.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import small_batches

#: Kinds of the base patterns, and all kinds in the order of spans.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
WINDOW, STRIDE = 64, 32
#: Labelled examples of the training set, all generated, its seed, and steps of training.
EXAMPLES, SEED, STEPS = 12_000, 11, 600

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
# a number begins where no digit stands before it, which the leftmost match does anyway
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns by kind, then place."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# ---- the tagger

_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Classes of characters: padding, lower, upper, digit, space, line feed, other letters, rest, each punctuation mark.
_CLASS = np.full(0x110000, 7, np.int8)
_CLASS[0x80:0x2000] = 6
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9, 0xA0]], _CLASS[[10, 13]] = 1, 2, 3, 4, 5
_CLASS[[ord(c) for c in _PUNCT]] = np.arange(8, 8 + len(_PUNCT))
N_CLASSES = 8 + len(_PUNCT)
#: Tags: outside, then begin and inside of each kind.
N_TAGS = 1 + 2 * len(KINDS)


def classes(text: str) -> np.ndarray:
    return _CLASS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Bidirectional LSTM over character classes, and a linear-chain CRF."""

    def __init__(self, hidden: int = 24, width: int = 10, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        self.h = hidden
        w = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": w(N_CLASSES, width) * 2, "O": w(2 * hidden, N_TAGS), "o": np.zeros(N_TAGS, np.float32), "A": np.zeros((N_TAGS, N_TAGS), np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": w(width + hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"c{d}"][hidden : 2 * hidden] = 1

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states [n, length, h] in reading direction d, and what the backward pass needs."""
        w, c0, h = self.p[f"W{d}"], self.p[f"c{d}"], self.h
        n, length = x.shape
        e = self.p["E"] @ w[: -h] + c0  # a class's share of the gates
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, tape = np.zeros((n, length, h), np.float32), []
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            z = e[x[:, t]] + state @ w[-h:]
            g = _sigmoid(z[:, : 3 * h])
            u = np.tanh(z[:, 3 * h :])
            i, f, o = g[:, :h], g[:, h : 2 * h], g[:, 2 * h :]
            new = f * cell + i * u
            tc = np.tanh(new)
            if keep:
                tape.append((t, state, cell, i, f, o, u, tc))
            state, cell = o * tc, new
            out[:, t] = state
        return out, tape

    def emissions(self, x: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, "f", False)[0], self._run(x, "b", False)[0]], 2)
        return both @ self.p["O"] + self.p["o"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log likelihood a window, and its gradients; padding has class 0 and counts as outside."""
        n, length = x.shape
        runs = {d: self._run(x, d, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        s, a = both @ self.p["O"] + self.p["o"], self.p["A"]
        alpha, beta = np.zeros_like(s), np.zeros_like(s)
        alpha[:, 0] = s[:, 0]
        for t in range(1, length):
            alpha[:, t] = s[:, t] + _logsumexp(alpha[:, t - 1, :, None] + a, 1)
        for t in range(length - 2, -1, -1):
            beta[:, t] = _logsumexp(a + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = _logsumexp(alpha[:, -1], 1)
        ds = np.exp(alpha + beta - z[:, None, None])
        pair = np.exp(alpha[:, :-1, :, None] + a + (s[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
        da = pair.sum((0, 1))
        row, col = np.arange(n)[:, None], np.arange(length)[None]
        gold = s[row, col, y].sum() + a[y[:, :-1], y[:, 1:]].sum()
        ds[row, col, y] -= 1
        np.add.at(da, (y[:, :-1], y[:, 1:]), -1)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["A"] = da / n
        ds = (ds / n).astype(np.float32)
        g["O"] = np.einsum("nlh,nlt->ht", both, ds)
        g["o"] = ds.sum((0, 1))
        dboth, h = ds @ self.p["O"].T, self.h
        for k, d in enumerate("fb"):
            w, dout = self.p[f"W{d}"], dboth[:, :, k * h : (k + 1) * h]
            dstate, dcell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            de = np.zeros((N_CLASSES, 4 * h), np.float32)
            for t, state, cell, i, f, o, u, tc in reversed(runs[d][1]):
                dh = dout[:, t] + dstate
                dc = dcell + dh * o * (1 - tc**2)
                dz = np.concatenate([dc * u * i * (1 - i), dc * cell * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u**2)], 1)
                g[f"W{d}"][-h:] += state.T @ dz
                np.add.at(de, x[:, t], dz)
                dstate, dcell = dz @ w[-h:].T, dc * f
            g[f"W{d}"][:-h] += self.p["E"].T @ de
            g["E"] += de @ w[:-h].T
            g[f"c{d}"] += de.sum(0)
        return float(z.sum() - gold) / n, g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 64, rate: float = 0.02) -> float:
        r = np.random.default_rng(SEED)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(p) for k, p in self.p.items()}
        loss = 0.0
        for step in range(1, steps + 1):
            at = r.integers(0, len(x), batch)
            loss, g = self.gradients(x[at], y[at])
            size = np.sqrt(sum(float((q.astype(np.float64) ** 2).sum()) for q in g.values()))
            for k, q in g.items():
                q = q * min(1.0, 5 / max(size, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.99 * v[k] + 0.01 * q * q
                self.p[k] -= (rate * (1 - 0.9 * step / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of each window, and each place's lead of that tag over outside."""
        s, a = self.emissions(x), self.p["A"]
        n, length = x.shape
        score, back = s[:, 0], np.zeros((n, length, N_TAGS), np.int8)
        for t in range(1, length):
            all_ = score[:, :, None] + a
            back[:, t] = all_.argmax(1)
            score = all_.max(1) + s[:, t]
        tags = np.zeros((n, length), np.int64)
        tags[:, -1] = score.argmax(1)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        return tags, np.take_along_axis(s, tags[:, :, None], 2)[:, :, 0] - s[:, :, 0]


def _word(r: np.random.Generator) -> str:
    w = "".join(r.choice(list("etaoinshrdlucmfwypvbgkqjxzéèüñß"), r.integers(1, 9)))
    return w.capitalize() if r.random() < 0.15 else w


def _digits(r: np.random.Generator, n: int) -> str:
    return "".join(map(str, r.integers(0, 10, n)))


def _checked(digits: str) -> str:
    """The digits with a last one that makes them pass Luhn."""
    return next(digits[:-1] + d for d in "0123456789" if luhn(digits[:-1] + d))


def _pick(r: np.random.Generator, values):
    return values[int(r.integers(0, len(values)))]


_HEX, _B32 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_NAMES = ("token", "secret", "api_key", "apikey", "api-key", "password", "passwd", "pwd", "key", "access_key", "auth_token", "client_secret")


def _code(r: np.random.Generator) -> str:
    """Letters and digits of a key or hash, at least one of each."""
    letters, sizes = _pick(r, ((_HEX, (24, 32, 40, 64)), (_HEX, (32, 40)), (_B32, (16, 20, 32)), (_B64, (20, 24, 32, 44))))
    size = _pick(r, sizes)
    return "".join(r.choice(list(letters), size - 2)) + _pick(r, "234567") + _pick(r, letters[-22:-6])


def _personal(r: np.random.Generator, kind: str) -> tuple[str, str, str]:
    """What stands before a span, the span, and what stands after it."""
    if kind == "email":
        at = _pick(r, ("@", "@", "@", " @ ", "(@)", "[@]", " (@) "))
        dot = "." if at == "@" else _pick(r, (".", " . "))
        user = _word(r).lower() + _pick(r, (f".{_digits(r, 2)}", "_" + _word(r).lower(), "." + _word(r).lower(), ""))
        host = _word(r).lower() + _pick(r, ("", _digits(r, 1), "-" + _word(r).lower()))
        host += _pick(r, ("", "", dot + _word(r).lower()))
        return "", f"{user}{at}{host}{dot}{_pick(r, ('com', 'org', 'net', 'fr', 'de'))}", ""
    if kind == "ip":
        return "", _pick(r, (".", ".", "[.]", " . ", ". ")).join(str(x) for x in r.integers(0, 256, 4)), ""
    if kind == "card":
        sep, digits = _pick(r, ("", " ", "-", ".", "/")), _checked(_digits(r, 16))
        return "", sep.join(digits[k : k + 4] for k in range(0, 16, 4)), ""
    if kind == "secret":
        name, quote = _pick(r, _NAMES), _pick(r, ('"', '"', "'", ""))
        name = _pick(r, (name, name, name.upper()))
        code = _code(r)
        return f"{name}{_pick(r, (' = ', '=', ': ', ':'))}{quote}", code.upper() if name.isupper() and r.random() < 0.5 else code, quote
    lead = _pick(r, ("+1 ", "+33 ", "+49 ", "", "", "", "001 ", "0044 "))
    body = _pick(r, ("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "({}) {} {}", "{} {} {}", "{}/{}-{}"))
    return "", lead + body.format(_digits(r, 3), _digits(r, 3), _digits(r, 4)), ""


def _harmless(r: np.random.Generator) -> str:
    return _pick(r, (
        lambda: _digits(r, r.integers(1, 9)), lambda: f"{r.integers(1900, 2030)}-{r.integers(1, 13):02d}-{r.integers(1, 29):02d}",
        lambda: f"{r.integers(1, 13)}:{r.integers(0, 60):02d}", lambda: f"v{r.integers(0, 9)}.{r.integers(0, 20)}.{r.integers(0, 9)}",
        lambda: f"{r.integers(0, 999)},{_digits(r, 3)}.{_digits(r, 2)}", lambda: _code(r), lambda: f"commit {_code(r)}",
        lambda: "@" + _word(r), lambda: f"{r.integers(1, 100)} %", lambda: f"{_pick(r, _NAMES)} {_word(r)} {_digits(r, 2)}",
        lambda: f"CC BY-NC {r.integers(1, 5)}.0", lambda: f"({r.integers(1, 40)})", lambda: f"{_word(r)} = {_digits(r, 3)}",
        lambda: f"{r.integers(1, 20)}.{r.integers(1, 20)}.{r.integers(1, 20)}", lambda: f"{r.integers(1, 13):02d}/{r.integers(1, 29):02d}/{r.integers(1900, 2030)}",
    ))()


_GAPS = (" ", " ", " ", " ", ", ", ".\n", ". ", " | ", "!! ", "### ")


def sample(r: np.random.Generator, length: int) -> tuple[str, list[Span]]:
    """A generated text of at least this length and its labelled spans, among words and harmless numbers."""
    text, spans = "", []
    while len(text) < length:
        u = r.random()
        if u < 0.14:
            kind = _pick(r, KINDS)
            before, part, after = _personal(r, kind)
            spans.append((kind, len(text) + len(before), len(text) + len(before) + len(part)))
            part = before + part + after
        else:
            part = _harmless(r) if u < 0.3 else _word(r)
        text += part + _pick(r, _GAPS)
    return text, spans


def examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of character classes and tags out of generated texts."""
    r = np.random.default_rng(seed)
    x, y = np.zeros((n, WINDOW), np.int8), np.zeros((n, WINDOW), np.int64)
    for row in range(n):
        shift = int(r.integers(0, 60))
        text, spans = sample(r, WINDOW + shift)
        tags = np.zeros(len(text), np.int64)
        for kind, a, b in spans:
            k = KINDS.index(kind)
            tags[a:b], tags[a] = 2 + 2 * k, 1 + 2 * k
        size = WINDOW if r.random() < 0.9 else int(r.integers(8, WINDOW))
        x[row, :size], y[row, :size] = classes(text)[shift : shift + size], tags[shift : shift + size]
    return x, y


_trained: dict[tuple, Tagger] = {}


def trained(steps: int = STEPS) -> Tagger:
    """The tagger, trained once a process; the seed fixes its weights."""
    if (key := (steps,)) not in _trained:
        tagger = Tagger()
        tagger.train(*examples(EXAMPLES, SEED), steps)
        _trained[key] = tagger
    return _trained[key]


def spans_of(tags: np.ndarray, lead: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, score) of the runs of one kind in a window."""
    out, k, n = [], 0, len(tags)
    while k < n:
        if tags[k]:
            kind, end = (tags[k] - 1) // 2, k + 1
            while end < n and tags[end] == 2 + 2 * kind:
                end += 1
            out.append((int(kind), k, end, float(lead[k:end].sum())))
            k = end
        else:
            k += 1
    return out


def _plausible(kind: str, part: str) -> bool:
    digits = len(_NOT_DIGIT.sub("", part))
    if kind == "email":
        return bool(re.fullmatch(r"[\w.%+-]+\s?[\[(]?@[\])]?\s?[\w-]+(?:\s?\.\s?[\w-]+)+", part))
    if kind == "ip":
        return len(p := re.findall("[0-9]+", part)) == 4 and all(len(x) < 4 and int(x) < 256 for x in p)
    if kind == "card":
        return 16 <= digits <= 19 and luhn(_NOT_DIGIT.sub("", part))
    if kind == "secret":
        return len(part) >= 12 and digits > 0 and bool(re.fullmatch(r"[A-Za-z0-9+/=_.-]*[A-Za-z][A-Za-z0-9+/=_.-]*", part))
    return 8 <= digits <= 15 and not re.search("[A-Za-z]", part)


def reconcile(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Of spans with scores those that don't overlap and have the largest sum."""
    found = sorted(set(found), key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in found]
    best = [(0.0, None, 0)]
    for k, (_, start, _, score) in enumerate(found):
        before = int(np.searchsorted(ends[:k], start, "right"))
        with_ = best[before][0] + score
        best.append((with_, k, before) if with_ > best[k][0] else (best[k][0], None, k))
    out, at = [], len(found)
    while at:
        _, k, before = best[at]
        if k is not None:
            out.append(found[k][:3])
        at = before
    return out[::-1]


def _regions(pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pieces that overlap or touch, joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(pieces):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def closed_spans(tagger: Tagger, texts: list[str], pieces: dict[int, list[tuple[int, int]]]) -> dict[int, list[tuple[int, int, int, float]]]:
    """Spans that meet the pieces of each text, decoded in windows that grow until they hold them whole."""
    found: dict[int, list[tuple[int, int, int, float]]] = {}
    while pieces:
        sized: dict[int, list[tuple[int, int, int, int]]] = {}
        for t, some in pieces.items():
            for a, b in _regions(some):
                start = max(0, a - max(STRIDE, b - a))
                size = -(-(b + max(STRIDE, b - a) - start) // WINDOW) * WINDOW
                sized.setdefault(size, []).append((t, start, a, b))
        pieces, coded = {}, {}
        for size, some in sized.items():
            step = max(1, 512 * WINDOW // size)
            for at in range(0, len(some), step):
                part = some[at : at + step]
                x = np.zeros((len(part), size), np.int8)
                for row, (t, start, _, _) in zip(x, part, strict=True):
                    if t not in coded:
                        coded = {t: classes(texts[t])}
                    own = coded[t][start : start + size]
                    row[: len(own)] = own
                tags, lead = tagger.decode(x)
                for (t, start, a, b), tag, score in zip(part, tags, lead, strict=True):
                    end = min(size, len(texts[t]) - start)
                    for kind, i, j, sum_ in spans_of(tag[:end], score[:end]):
                        if start + i >= b or start + j <= a:
                            continue
                        if (i == 0 and start) or (j == end and start + j < len(texts[t])):
                            pieces.setdefault(t, []).append((min(a, start + i), max(b, start + j)))
                        else:
                            found.setdefault(t, []).append((kind, start + i, start + j, sum_))
    return found


def added_spans(tagger: Tagger, texts: list[str], bases: list[list[Span]]) -> list[list[Span]]:
    """What the tagger adds to the base spans of each text."""
    where: list[tuple[int, int]] = []
    for t, text in enumerate(texts):
        grid = {g for m in _TRIGGER.finditer(text) for g in (m.start() // STRIDE, m.start() // STRIDE - 1)}
        where += [(t, g * STRIDE) for g in sorted(grid) if g >= 0 or len(text) <= 0]
    found: dict[int, list[tuple[int, int, int, float]]] = {}
    cut: dict[int, list[tuple[int, int, int]]] = {}
    coded: dict[int, np.ndarray] = {}
    for at in range(0, len(where), 512):
        some = where[at : at + 512]
        x = np.zeros((len(some), WINDOW), np.int8)
        for row, (t, start) in zip(x, some, strict=True):
            if t not in coded:
                coded = {t: classes(texts[t])}
            part = coded[t][start : start + WINDOW]
            row[: len(part)] = part
        tags, lead = tagger.decode(x)
        for k in np.flatnonzero(tags.any(1)).tolist():
            t, start = some[k]
            for kind, a, b, score in spans_of(tags[k], lead[k]):
                if start + b > len(texts[t]):
                    continue
                if (a == 0 and start) or (b == WINDOW and start + b < len(texts[t])):
                    cut.setdefault(t, []).append((kind, start + a, start + b))
                    continue
                found.setdefault(t, []).append((kind, start + a, start + b, score))
    # cut off at a border, and not held whole by a neighbour window
    pieces: dict[int, list[tuple[int, int]]] = {}
    for t, some in cut.items():
        whole = sorted((a, b, kind) for kind, a, b, _ in found.get(t, []))
        for kind, a, b in some:
            k = bisect_right(whole, (a, len(texts[t]) + 1, len(KINDS)))
            if not any(y >= b and kind == z for _, y, z in whole[max(0, k - WINDOW) : k]):
                pieces.setdefault(t, []).append((a, b))
    for t, some in closed_spans(tagger, texts, pieces).items():
        found.setdefault(t, []).extend(some)
    out: list[list[Span]] = [[] for _ in texts]
    for t, some in found.items():
        taken = sorted((a, b) for _, a, b in bases[t])
        starts = [a for a, _ in taken]
        for kind, a, b in reconcile(some):
            part = texts[t][a:b]
            a, b = a + len(part) - len(part.lstrip()), b - len(part) + len(part.rstrip())
            k = int(np.searchsorted(starts, b)) if starts else 0
            clash = any(x < b and y > a for x, y in taken[max(0, k - 4) : k])
            if not clash and _plausible(KINDS[kind], texts[t][a:b]):
                out[t].append((KINDS[kind], a, b))
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def _find(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    tagger = model.value
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        bases: list[list[Span]] = [[] for _ in texts]
        added: list[list[Span]] = [[] for _ in texts]
        some = [k for k, t in enumerate(texts) if _TRIGGER.search(t)]
        for k in some:
            bases[k] = base_spans(texts[k])
        for at in range(0, len(some), 64):
            part = some[at : at + 64]
            for k, spans in zip(part, added_spans(tagger, [texts[k] for k in part], [bases[k] for k in part]), strict=True):
                added[k] = spans
        counts = [pa.array([sum(s[0] == kind for s in b) for b in bases], pa.int64()) for kind in BASE_KINDS]
        joined = [_joined(b) for b in bases]
        spans = [j if not a else _joined(b + a) for j, b, a in zip(joined, bases, added, strict=True)]
        digests = [hashlib.sha256(j.encode()).hexdigest() for j in joined]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *counts, pa.array(digests), pa.array(spans), pa.array([len(a) for a in added], pa.int64()), pa.array([len(b) + len(a) for b, a in zip(bases, added, strict=True)], pa.int64())],
            ["key", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_added", "n_spans"],
        )


def personal_data(df: DataFrame, key: str = "doc_id", text: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans) of each row's whole text.

    spans: kind:start:end in characters, by kind, then start, joined by commas.
    """
    spark = df.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(tagger or trained())
    src = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = f"key {src.schema['key'].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string, n_added long, n_spans long"
    return src.mapInArrow(lambda it: _find(it, model), schema).withColumnRenamed("key", key)
