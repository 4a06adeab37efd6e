"""Small inputs and brute-force versions for the tests of this folder."""

import random
import re

LONG = "lorem ipsum dolor sit amet " * 4000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(n=60, seed=1):
    """Documents with exact and near copies, shared passages, nulls, empty and blank texts."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(300)]
    passage = " ".join(r.choice(words) for _ in range(70))
    texts = []
    for k in range(n):
        u = r.random()
        if texts and u < 0.2:
            texts.append(r.choice(texts))
        elif texts and u < 0.45:
            w = r.choice(texts).split(" ")
            for _ in range(r.randint(1, 2)):
                w[r.randrange(len(w))] = r.choice(words)
            texts.append(" ".join(w))
        else:
            lines = [" ".join(r.choice(words) for _ in range(r.randint(3, 30))) for _ in range(r.randint(1, 5))]
            if u > 0.85:
                lines.insert(1, passage)
            texts.append("\n".join(lines))
    texts += [None, "", "  \n ", "one", "Two WORDS", "two words", LONG, LONG + " end", "é ü ß " * 50, "\x00a\x01", "a　b▁c"]
    return [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]


def frame(spark, rows, partitions=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


class Union:
    """Components by smallest member."""

    def __init__(self, items):
        self.up = {i: i for i in items}

    def top(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)
