"""Line dedup, n-gram join, suffix dedup and component search against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import Union, ascii_lower, documents, frame

from lexmill.llm import line_dedup, ngram_join, suffix_dedup, suffixes
from lexmill.llm.common import components


def within_one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    i = next((k for k in range(n) if a[k] != b[k]), n)
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def lines_by_hand(rows, min_chars, min_exact=1):
    seen, out = [], {}
    for i, t in sorted((r[0], r[1]) for r in rows):
        kept, lines = [], t.split("\n") if t else []
        for x in lines:
            gone = len(x) >= min_exact and bool(x.strip()) and x in seen
            gone = gone or (len(x) >= min_chars and any(len(s) >= min_chars and within_one_edit(x, s) for s in seen))
            if x.strip():
                seen.append(x)
            if not gone:
                kept.append(x)
        out[i] = ("\n".join(kept) if len(kept) < len(lines) else t, len(lines), len(lines) - len(kept))
    return out


def test_within_one_edit():
    r = random.Random(2)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for _ in range(3000):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(0, 5))) for _ in range(2))
        assert within_one_edit(a, b) == (distance(a, b) <= 1)


def test_lines(spark):
    r = random.Random(3)
    base = ["".join(r.choice("abc dé") for _ in range(r.randint(8, 24))) for _ in range(25)]
    rows = documents(20)
    for k in range(200, 260):
        lines = []
        for _ in range(5):
            x = list(r.choice(base))
            for _ in range(r.randint(0, 2)):
                p, o = r.randrange(len(x)), r.randint(0, 2)
                x[p : p + (o != 2)] = [] if o == 1 else [r.choice("abé")]
            lines.append("".join(x))
        rows.append((k, "\n".join(lines), "en", "s", 0))
    df = frame(spark, rows).withColumnRenamed("lang", "n_lines")  # a clashing name
    out = line_dedup.dedup_lines(df, min_chars=10)
    assert out.columns == ["doc_id", "text", "source", "n_chars", "n_lines", "n_lines_removed"]
    assert {x.doc_id: (x.text, x.n_lines, x.n_lines_removed) for x in out.collect()} == lines_by_hand(rows, 10)
    assert line_dedup.dedup_lines(frame(spark, rows).limit(0)).count() == 0


def test_rows_without_id_stay(spark):
    line = "a line that is long enough"
    out = line_dedup.dedup_lines(frame(spark, [(None, line, "en", "s", 1), (1, line, "en", "s", 1), (2, line, "en", "s", 1)]))
    assert Counter(x.text for x in out.collect()) == {line: 2, "": 1}


def test_lines_of_rows_that_share_an_id(spark):
    """Each row loses its own lines only; names of further columns may clash."""
    shared = "a line that is in both of these"
    rows = [(5, f"{shared}\none more line of the first row"), (5, f"a second row has its own first line\n{shared}"), (5, None), (6, f"ok\n{shared}\nok\n \n ")]
    df = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(rows)], "doc_id long, text string, row int, key string")
    got = {x.row: (x.text, x.n_lines_removed, x.key) for x in line_dedup.dedup_lines(df).collect()}
    first = min((0, 1), key=lambda k: got[k][1])  # the order of rows of one id follows their texts' hashes
    assert got[first] == (rows[first][1], 0, "x")
    assert got[1 - first] == (rows[1 - first][1].replace(shared, "").strip("\n"), 1, "x")
    assert got[2] == (None, 0, "x") and got[3] == ("ok\n \n ", 2, "x")
    kept = {x.row: x.text for x in line_dedup.dedup_lines(df, min_exact=20).collect()}
    assert kept[3] == "ok\nok\n \n "


def sets_by_hand(rows, n, num):
    sets = {}
    for i, t, *_ in rows:
        w = ascii_lower(t).encode().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    u = Union(sets)
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                u.join(a, b)
    return {i: (len(sets[i]), u.top(i)) for i in sets}


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (1, 50)])
def test_ngram_join(spark, n, num):
    rows = documents(150, seed=num)
    out = ngram_join.near_duplicates(frame(spark, rows), n, num, 100)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in out.collect()} == sets_by_hand(rows, n, num)


@pytest.mark.parametrize("hot", [False, True])
def test_ngram_join_of_large_groups(spark, monkeypatch, hot):
    """Near copies that link only in chains, in trees of several blocks and levels, dealt before they are gathered or after."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 40)
    if hot:
        monkeypatch.setattr(ngram_join, "SEEN", 1)
        monkeypatch.setattr(ngram_join, "HOT_SHARE", 0)
    r = random.Random(5)
    w = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(150):
        w = list(w)
        w[r.randrange(len(w))] = f"x{k}"
        rows.append((k, " ".join(w), "en", "s", 0))
    out = ngram_join.near_duplicates(frame(spark, rows), 3, 90, 100)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in out.collect()} == sets_by_hand(rows, 3, 90)
    assert ngram_join.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_tree_loses_no_pair():
    r = np.random.default_rng(1)
    centre = r.integers(0, 6, (12, 32))
    v = np.maximum(centre[r.integers(0, 12, 600)] + r.integers(-1, 2, (600, 32)), 0).astype(np.uint8)
    sizes, group = v.sum(1).astype(np.int64), r.integers(0, 40, 600)
    got = set()
    for i, j in ngram_join.CountTree(v, sizes, group).pairs(80, 100):
        got |= {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    want = {
        (a, b) for a in range(600) for b in range(a + 1, 600)
        if group[a] != group[b] and 180 * int(np.minimum(v[a], v[b]).sum()) >= 80 * int(sizes[a] + sizes[b])
    }
    assert got == want and want


@pytest.mark.parametrize("hot", [1_000_000, 4])
def test_components(spark, hot):
    r = random.Random(7)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 440)] + [(500, 500 + k) for k in range(50)]
    u = Union(range(600))
    for a, b in edges:
        u.join(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long"), hot_edges=hot).collect()}
    assert got == {x: u.top(x) for e in edges for x in e if e[0] != e[1]} | {k: v for k, v in got.items() if u.top(k) == v}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def repeats_by_hand(rows, size):
    data = {r[0]: (r[1] or "").encode() for r in rows}
    seen = Counter(t[k : k + size] for t in data.values() for k in range(len(t) - size + 1))
    out = {}
    for i, t in data.items():
        gone = bytearray(len(t))
        for k in range(len(t) - size + 1):
            if seen[t[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        runs = sum(bool(g) and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("options", [{}, {"hot": 2}, {"shard_bytes": 500}])
def test_suffix_dedup(spark, options):
    rows = [r for r in documents(60, seed=4) if len(r[1] or "") < 20000] + [(900, "ab" * 300, "en", "s", 0), (901, "z" * 450, "en", "s", 0), (902, "é" * 120, "en", "s", 0)]
    want = repeats_by_hand(rows, 200)
    assert any(v[1] for v in want.values())
    out = suffix_dedup.remove_repeats(frame(spark, rows), **options)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in out.collect()}
    assert got == want
    assert suffix_dedup.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def test_suffix_arrays():
    r = random.Random(1)
    for trial in range(150):
        n, k = r.randint(1, 50), r.choice([1, 2, 3, 256])
        t = bytes(r.randrange(k) for _ in range(n))
        t = (t[:7] * 20)[:n] if trial % 5 == 0 else t
        a = np.frombuffer(t, np.uint8)
        sa = suffixes.suffix_array(a)
        assert sa.tolist() == sorted(range(n), key=lambda i: t[i:])
        lcp, before = suffixes.permuted_lcp(a, sa.astype(np.int64), 1000)
        for i, j in zip(sa[1:].tolist(), sa[:-1].tolist(), strict=True):
            c = next((c for c in range(n) if max(i, j) + c >= n or t[i + c] != t[j + c]), n)
            assert (lcp[i], before[i]) == (c, j)


def test_ngram_join_of_rows_without_id(spark):
    out = ngram_join.near_duplicates(frame(spark, [(None, "a b c d", "", "", 0), (None, "a b c d", "", "", 0), (4, "a b c d", "", "", 0), (4, "a b c d", "", "", 0)]), 3, 90, 100)
    assert sorted((x.doc_id is None, x.n_shingles, x.component_id) for x in out.collect()) == [(False, 2, 4)] * 2 + [(True, 2, 4)] * 2


def test_suffix_dedup_row_by_row(spark):
    """Rows that share an id lose their own bytes only; rows without an id and equal rows take part; long texts cross slices."""
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    shared, a, b = text(300), text(500), text(500)
    rows = [(1, a + shared), (1, b), (None, text(100) + shared), (2, b[:250]), (3, a[:150]), (4, "same" * 60), (4, "same" * 60), (None, None)]
    df = spark.createDataFrame([(*x, k, "z") for k, x in enumerate(rows)], "doc_id long, text string, key int, anchor string").repartition(3)
    got = sorted(str((x.doc_id, x.n_bytes, x.n_removed, x.kept_sha256)) for x in suffix_dedup.remove_repeats(df).collect())
    want = repeats_by_hand([(k, t) for k, (_, t) in enumerate(rows)], 200)
    assert got == sorted(str((rows[k][0], *(w[i] for i in (0, 1, 3)))) for k, w in want.items())
    long = "".join(f"{k:07x}" for k in range(700_000))  # longer than two slices; nothing repeats
    out = suffix_dedup.remove_repeats(spark.createDataFrame([(1, long + shared), (2, shared[:210])], "doc_id long, text string")).collect()
    assert {x.doc_id: x.n_removed for x in out} == {1: 210, 2: 210}
