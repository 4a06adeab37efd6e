"""Tokens, windows, personal data, language, scores and search against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import ascii_lower, documents, frame
from pyspark.sql import functions as F

from lexmill.llm import decontaminate, language_id, lm_score, pii, queries, sentencepieces, token_counts, topk
from lexmill.llm.pieces import chunks, loaded, model_bytes

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", " a  b ", "▁a", "\x00a", "a　b", "\n", "\n\n a", "a\x00b\x00", "x" * 700, "<s> </s> <0x0A>", "🎉 émoji", "a\r\nb\t\tc ", " " * 40, "naïve–déjà…"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_codec(spark, library):
    rows = documents(30) + [(500 + k, t, "en", "s", 0) for k, t in enumerate(ODD)] * 2
    out = sentencepieces.encode_texts(frame(spark, rows).withColumn("ids", F.lit(1)), PATH).collect()
    assert len(out) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for x in out:
        ids = library.encode(texts[x.doc_id])
        assert list(x.ids) == ids and x.n_tokens == len(ids) and x.decoded == library.decode(ids)
        assert x.ids_sha256 == sha(",".join(map(str, ids))) and x.decoded_sha256 == sha(library.decode(ids))
    assert sentencepieces.encode_texts(frame(spark, rows).limit(0), PATH).count() == 0


def test_agenda_equals_rows_and_library(library):
    model, r = loaded(model_bytes(PATH)), random.Random(1)
    some = ["▁" * r.randint(0, 3) + "".join(r.choice("etaoin.,-é1ß日") for _ in range(r.randint(1, 20))) for _ in range(3000)]
    own = model.encode(some)
    assert own == [model.agenda(s) for s in some]
    assert [model.ids_of(s) for s in own] == model.by_library(some)


def test_decode_of_any_ids(library):
    model, r = loaded(model_bytes(PATH)), random.Random(2)
    for _ in range(200):
        ids = [r.randrange(3, model.n) for _ in range(r.randint(0, 12))]
        assert sentencepieces.decode(model, ids) == library.decode(ids)


def test_counts_at_every_prefix(spark, library):
    rows = [(k, t, "en", "s", 0) for k, t in enumerate([*ODD, None, "The quick, brown fox — naïve café. " * 3])]
    out = token_counts.token_counts(frame(spark, rows), PATH, budget=5, whole=True).collect()
    assert len(out) == len(rows)
    for x in out:
        t = rows[x.doc_id][1] or ""
        want = [len(library.encode(t[:k])) for k in range(len(t) + 1)]
        assert list(x.prefix_tokens) == want and x.n_tokens == want[-1] and x.n_bytes == len(t.encode())
        assert x.fitting_chars == max(k for k in range(len(t) + 1) if want[k] <= 5)
    lean = token_counts.token_counts(frame(spark, rows), PATH, budget=5).collect()
    assert {x.doc_id: (x.n_tokens, x.fitting_chars) for x in lean} == {x.doc_id: (x.n_tokens, x.fitting_chars) for x in out}
    assert token_counts.token_counts(frame(spark, rows).limit(0), PATH, 5).count() == 0
    assert chunks("") == []


def test_codes_and_counts_of_odd_rows(spark):
    """Repeated rows, rows without an id or a text, further columns whose names clash."""
    rows = [(1, "two words"), (1, "two words"), (None, "two words"), (None, None), (2, "")]
    df = spark.createDataFrame([(*x, 7, "k") for x in rows], "doc_id long, text string, n_tokens int, key string")
    n = len(sentencepiece.SentencePieceProcessor(model_file=PATH).encode("two words"))
    for out in (sentencepieces.encode_texts(df, PATH), token_counts.token_counts(df, PATH, 3)):
        got = sorted(((x.doc_id is None, x.doc_id or 0, x.n_tokens) for x in out.collect()))
        assert got == [(False, 1, n), (False, 1, n), (False, 2, 0), (True, 0, 0), (True, 0, n)]


def windows_by_hand(rows, items):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(t))
    wins = {i: {tuple(w[k : k + min(10, len(w))]) for k in range(len(w) - min(10, len(w)) + 1)} for i, t in items if (w := split(t))}
    out = {}
    for i, t, *_ in rows:
        w, hit, found = split(t), set(), []
        for item, some in wins.items():
            n = len(next(iter(some)))
            at = [k for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in some]
            found += [str(item)] if at else []
            hit |= {p for k in at for p in range(k, k + n)}
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


@pytest.mark.parametrize("bits", [1 << 24, 64])  # 64: the filters let nearly all through
def test_decontamination(spark, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "BITS", bits)
    rows = documents(60, seed=9)
    r = random.Random(4)
    items = [(k, " ".join((rows[r.randrange(60)][1] or "x").split()[: r.randint(3, 25)])) for k in range(12)] + [(20, None), (21, ""), (22, "ONE"), (23, "one"), (24, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(frame(spark, rows), bench)
    got = {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in decontaminate.contamination_digest(found).collect()}
    assert got == windows_by_hand(rows, items)
    none = decontaminate.contamination_digest(decontaminate.contamination(frame(spark, rows), bench.limit(0)))
    assert not any(x.contaminated for x in none.collect())
    assert decontaminate.contamination(frame(spark, rows).limit(0), bench).count() == 0


def test_decontamination_row_by_row(spark):
    """Repeated ids, rows without an id and further columns: each row has its own result."""
    rows = [(1, "a b c d e"), (1, "a b c d e"), (1, "x a b c"), (None, "c d a b c"), (None, "c d a b c"), (None, None), (2, "b a")]
    docs = spark.createDataFrame([(*r, "n", 3) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    bench = spark.createDataFrame([("q", "A B C"), ("r", "b c"), ("q", "a b c"), (None, "d"), ("s", None)], "item_id string, text string")
    got = decontaminate.contamination(docs, bench, size=3)
    want = [(1, 5, [0, 4], ["q", "r"])] * 2 + [(1, 4, [1, 4], ["q", "r"])] + [(None, 5, [1, 5], ["q", "r"])] * 2 + [(None, 0, [], []), (2, 2, [], [])]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_by_hand(t):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m.group().split(".")),
                "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15,
            }[kind]
            out += [(kind, m.start(), m.end())] if good else []
    return out


def test_base_patterns():
    r = random.Random(5)
    some = ["".join(r.choice("01255..@@+-  ()ab4\né") for _ in range(r.randint(0, 60))) for _ in range(8000)]
    some += ["4111 1111 1111 1111, 4111-1111-1111-1111x", "a@b.c.d@e.f", "9" * 5000, "1.2.3.4.5.6.7.8", "0255.1.1.1"]
    assert [pii.base_spans(t) for t in some] == [base_by_hand(t) for t in some]


def test_tagger_gradients():
    x, y = pii.examples(4, 3)
    tagger = pii.Tagger()
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    _, g = tagger.gradients(x, y)
    for k, p in tagger.p.items():
        at = tuple(np.array(p.shape) // 2)
        p[at] += 1e-4
        up, _ = tagger.gradients(x, y)
        p[at] -= 2e-4
        down, _ = tagger.gradients(x, y)
        p[at] += 1e-4
        assert g[k][at] == pytest.approx((up - down) / 2e-4, rel=0.02, abs=1e-3)


def test_tagger_on_held_out_texts():
    """Spans that the base patterns miss, whole and exact: recall by kind, and precision."""
    r = np.random.default_rng(99)
    made = [pii.sample(r, 400) for _ in range(250)]
    texts, bases = [t for t, _ in made], [pii.base_spans(t) for t, _ in made]
    found = pii.added_spans(pii.trained(), texts, bases)
    met, all_, wrong = Counter(), Counter(), 0
    for (_, spans), base, added in zip(made, bases, found, strict=True):
        for s in spans:
            if all(b[2] <= s[1] or b[1] >= s[2] for b in base):
                all_[s[0]] += 1
                met[s[0]] += s in added
        wrong += sum(s not in spans for s in added)
    assert set(all_) == {*pii.KINDS} and all(met[k] >= 0.9 * n for k, n in all_.items())
    assert wrong <= 0.05 * sum(map(len, found))


def test_personal_data(spark):
    texts = [
        None, "", "no data here", "mail a.b@c.org now", "call (414) 555-7134 soon please", "+1 (578) 555-6437 4918187128635271 of", "10.1.2.3 and 4111 1111 1111 1111",
        "word " * 9000 + "last@mail.net", "3" * 3000,
    ]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    out = {x.doc_id: x for x in pii.personal_data(frame(spark, rows + rows[3:4])).collect()}
    for k, t in enumerate(texts):
        base = base_by_hand(t or "")
        joined = ",".join(f"{a}:{b}:{c}" for a, b, c in sorted(base, key=lambda s: (list(BASE).index(s[0]), s[1])))
        assert out[k].base_sha256 == sha(joined)
        assert [out[k][f"n_{kind}"] for kind in BASE] == [sum(s[0] == kind for s in base) for kind in BASE]
        assert set(filter(None, joined.split(","))) <= set(out[k].spans.split(","))
    assert out[4].n_added == 1 and out[4].spans.startswith("phone:") and out[2].spans == ""
    odd = spark.createDataFrame([(None, 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y', 1), (None, None, 2)], "doc_id long, text string, spans int")
    assert sorted((x.doc_id is None, x.spans, x.n_spans) for x in pii.personal_data(odd).collect()) == [(True, "", 0), (True, "secret:11:51", 1)]
    assert pii.personal_data(frame(spark, rows).limit(0)).count() == 0


def test_reconcile():
    assert pii.reconcile([(0, 0, 5, 1.0), (1, 4, 9, 3.0), (0, 9, 12, 1.0), (0, 9, 12, 1.0)]) == [(1, 4, 9), (0, 9, 12)]


class LineTagger:
    """Takes each line, up to 64 characters or more, for an e-mail."""

    def decode(self, x):
        inside = (x != 0) & (x != 5)
        first = inside & ~np.pad(inside, ((0, 0), (1, 0)))[:, :-1]
        return np.where(first, 1, np.where(inside, 2, 0)), inside.astype(np.float32)


@pytest.mark.parametrize("mail", ["firstname.lastname_01 (@) department-name . org", "a" * 90 + " (@) " + "b" * 150 + " . org", "a (@) b . org"])
def test_spans_longer_than_a_window_holds(mail):
    for off in range(70):
        for after in ("", "\n" * 80, "\nx"):
            text = "\n" * off + mail + after
            assert pii.added_spans(LineTagger(), [text], [[]]) == [[("email", off, off + len(mail))]]
    assert len(pii.added_spans(LineTagger(), ["1" * 30000 + "\n" + mail], [[]])[0]) == 1


TEXTS = {"en": "the house of the man and the river that was with them", "fr": "la maison de la femme et le chat dans les rues pour elle", "de": "das haus und der mann mit die frau auf dem weg ist nicht", "es": "la casa del hombre que con los perros por una calle muy"}


def test_language(spark):
    r = random.Random(1)
    rows = []
    for k in range(200):
        lang = r.choice(list(TEXTS))
        w = TEXTS[lang].split()
        rows.append((k, " ".join(r.choice(w) for _ in range(30)), lang, "host" + lang, 1))
    rows += [(300, None, "en", None, 0), (301, "", None, "s", 0), (302, "!!! 123", "en", "s", 0), (303, "the man", None, None, 0), (304, "la maison " * 9000, "fr", "s", 0)]
    df = frame(spark, rows).withColumn("language", F.lit("x"))
    out = {x.doc_id: x for x in language_id.identify(df, "doc_id", "text", declared=F.col("lang"), host=F.col("source")).collect()}
    assert len(out) == len(rows)
    assert all(out[k].language == rows[k][2] and not out[k].rejected for k in range(200))
    assert [out[k].rejected for k in (300, 301, 302, 303, 304)] == [True, True, True, False, False]
    assert language_id.identify(frame(spark, rows).limit(0), "doc_id", "text").count() == 0


def test_language_evidence(spark):
    df = spark.createDataFrame([("https://a.example.fr/x",), ("http://b.org/de/1?x",), ("http://c.com/",), (None,)], "u string")
    assert [x.h for x in df.select(language_id.address_hint(F.col("u")).alias("h")).collect()] == ["fr", "de", None, None]
    html = spark.createDataFrame([('<!doctype html><HTML class=a lang="fr-CA"><script>var x</script><p>bon&amp; jour</p>',)], "h string")
    got = html.select(language_id.markup_language(F.col("h")).alias("l"), F.trim(language_id.page_text(F.col("h"))).alias("t")).first()
    assert got.l == "fr" and got.t.split() == ["bon", "jour"]


def language_by_hand(rows, logp):
    """Language and confidence of rows (text, declared, address, host) by the fusion as documented, one row at a time."""
    classes, langs = language_id.CLASSES, language_id.LANGUAGES
    seen = []
    for text, *_ in rows:
        raw = (text or "").encode()
        ll = [float(sum(logp[c][g] for g in language_id._trigrams(np.frombuffer(raw, np.uint8)))) for c in range(5)]
        letters = sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in raw)
        seen.append((ll, int(np.argmax(ll)) if letters else None, letters))
    parts = lambda h: (h, m.group(1) if (m := re.search(r"([^.]+\.[^.]+)$", h)) else "", m.group(1) if (m := re.search(r"([^.]+)$", h)) else "")
    hosts = [parts(r[3].lower()) if r[3] is not None else None for r in rows]
    count = lambda level, name: np.array([sum(h is not None and h[level] == name and s[1] == c for h, s in zip(hosts, seen, strict=True)) for c in range(5)], float)
    every = np.array([sum(s[1] == c for s in seen) for c in range(5)], float)
    out = []
    for (_, declared, address, _), (ll, vote, letters), host in zip(rows, seen, hosts, strict=True):
        prior = (every + 1) / (every.sum() + 5)
        if host and count(0, host[0]).sum():
            for level in (2, 1, 0):
                n = count(level, host[level])
                if n.sum() and (level == 0 or any(s[1] is not None and h == host for h, s in zip(hosts, seen, strict=True))):
                    n[vote] -= vote is not None
                    prior = (n + language_id.SMOOTH * prior) / (n.sum() + language_id.SMOOTH)
        post = []
        for c, name in enumerate(classes):
            p = min(prior[c], language_id.NOISE) if name == "und" else prior[c]
            said = (declared or "").strip()[:2].lower()
            odds = 0 if said not in langs else np.log(language_id.RELIABLE) if said == name else np.log((1 - language_id.RELIABLE) / 4)
            hint = re.search(r"^[a-z]+://[^/]+/(?:.*/)?(en|fr|de|es)(?:[/?#]|$)", address or "") or re.search(r"^[a-z]+://[^/:?#]+\.(en|fr|de|es)(?=[/:?#]|$)", address or "")
            post.append(np.log(max(p, 1e-12)) + language_id.TEMPER * ll[c] + odds + (language_id.HINT if hint and hint.group(1) == name else 0))
        best = int(np.argmax(post))
        out.append((classes[best], 1 / np.exp(np.array(post) - max(post)).sum(), letters == 0 or classes[best] == "und"))
    return out


@pytest.mark.parametrize("hot_share", [500, 3])
def test_language_against_brute_force(spark, monkeypatch, hot_share):
    """Every source of evidence, few words a row, ties, repeated rows, and names that clash."""
    monkeypatch.setattr(language_id, "HOT_SHARE", hot_share)
    r = random.Random(9)
    sites = ["news.example.fr", "a.example.fr", "b.example.de", "one.com", "two.com", None, ""]
    rows = []
    for _ in range(120):
        t = " ".join(r.sample(TEXTS[r.choice(list(TEXTS))].split(), r.randint(1, 3)))
        site = r.choice(sites)
        path = r.choice(["/", "/fr/x", "/a/de?y", "/esx"])
        rows.append((r.choice([t, t, t, "12 !", None, "é"]), r.choice([None, "en", "fr-CA", " DE ", "xx"]), f"http://{site}{path}" if site else None, site))
    rows += rows[:10]
    df = spark.createDataFrame([(k, *x, "kept", 1) for k, x in enumerate(rows)], "k long, text string, said string, address string, site string, __row string, language int")
    found = language_id.identify(df.repartition(4), "k", "text", declared=F.col("said"), address=F.col("address"), host=F.col("site"))
    assert found.columns == ["k", "said", "address", "site", "__row", *language_id.RESULTS]
    train = df.select(F.col("text"), F.col("said").alias("l")).where(F.col("l").isin(*language_id.LANGUAGES))
    want = language_by_hand(rows, language_id.fit(train).astype(np.float32))
    for x in found.collect():
        language, confidence, rejected = want[x.k]
        assert (x.language, x.rejected, x["__row"]) == (language, rejected, "kept") and x.confidence == pytest.approx(confidence, rel=1e-3)


def test_pages_language(spark, tmp_path):
    page = lambda lang, text: f'<html lang="{lang}"><script>var the = 1</script><p>{text}</p></html>'
    rows = [(k, f"http://h{k % 3}.org/", page(c, " ".join(random.Random(k).choices(TEXTS[c].split(), k=15)))) for k, c in enumerate([*TEXTS] * 12)] + [(90, None, None), (91, "x", "<p></p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {x.page_id: x for x in queries.pages_language(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and all(got[k].language == c == got[k].declared_language for k, c in enumerate([*TEXTS] * 12))
    assert got[90].rejected and got[91].rejected


def test_held_out_language(spark):
    train = [(" ".join(random.Random(k).choices(t.split(), k=20)), c) for k in range(40) for c, t in TEXTS.items()]
    logp = language_id.fit(spark.createDataFrame(train, "t string, l string"))
    good = 0
    for k in range(100, 140):
        for c, t in TEXTS.items():
            grams = language_id._trigrams(np.frombuffer(" ".join(random.Random(k).choices(t.split(), k=12)).encode(), np.uint8))
            good += language_id.CLASSES[logp[:, grams].sum(1).argmax()] == c
    assert good == 160


def test_lm_scores_by_hand(spark):
    rows = documents(40)
    words, net = lm_score.fit(frame(spark, rows), rounds=1)
    got = {x.doc_id: x for x in lm_score.score(frame(spark, rows), words, net).collect()}
    for i, t, *_ in rows:
        buckets = [int(w) for b, _ in words.buckets(__import__("pyarrow").array([t or ""], "string")) for w in b]
        cls = [lm_score.CLASSES] * 2 + [int(words.cls[b]) for b in buckets] + [lm_score.CLASSES] * 2
        total = 0.0
        for k, b in enumerate(buckets[:300] if len(buckets) < 1000 else []):
            h = np.tanh(sum(net.p["E"][j][cls[k + 2 + o]] for j, o in enumerate(lm_score.OFFSETS)) + net.p["b"])
            z = (h @ net.p["O"] + net.p["o"]).astype(np.float64)
            total += z[cls[k + 2]] - np.log(np.exp(z).sum()) + words.within[b]
        assert got[i].n_tokens == len(buckets) == len((t or "").encode().split())
        if len(buckets) < 300:
            assert got[i].log_likelihood == pytest.approx(total, rel=1e-3, abs=1e-3)
    assert lm_score.lm_scores(frame(spark, rows).limit(0)).count() == 0


def test_lm_prefers_order(spark):
    r = random.Random(3)
    cycle = "alpha beta gamma delta epsilon".split()
    rows = [(k, " ".join((cycle * 60)[k % 5 :]), "en", "s", 0) for k in range(60)]
    words, net = lm_score.fit(frame(spark, rows))
    mixed = " ".join(r.sample(cycle * 60, 300))
    got = {x.doc_id: x.per_token for x in lm_score.score(frame(spark, [(1, " ".join(cycle * 60), "", "", 0), (2, mixed, "", "", 0)]), words, net).collect()}
    assert got[1] > got[2] + 0.5


def test_lm_trains_on_every_token(spark):
    texts = ["alpha", "alpha beta", "alpha beta gamma delta", "one two three four five six seven eight", "beta " * 40]
    words, net = lm_score.fit(frame(spark, [(k, t, "", "", 0) for k, t in enumerate(texts[:4])]), rounds=1)
    first = lm_score.Network()
    assert (net.p["E"][:, lm_score.CLASSES] != first.p["E"][:, lm_score.CLASSES]).any(1).all()
    column = __import__("pyarrow").array(texts, "string")
    for bucket, at in words.buckets(column):
        assert first.train(lm_score.lined(words.cls[bucket].astype(np.int64), at)[0], 0.05) == sum(len(t.split()) for t in texts)


def test_lm_beats_counts_on_held_out_texts(spark):
    """Sentences whose words fit those on both sides: bits a token against unigrams and smoothed bigrams."""
    r = random.Random(2)
    parts = {k: [f"{k}{j}" for j in range(60)] for k in ("noun", "verb", "adj", "sache", "tun")}
    frames = ["the {adj} {noun} and the {noun} {verb} it .", "it {verb} of the {noun} to the {adj} {noun} .", "die {sache} und der {sache} {tun} es .", "es {tun} mit der {sache} zu die {sache} ."]
    fill = lambda f: re.sub(r"\{(\w+)\}", lambda m: r.choice(parts[m.group(1)]), f)
    text = lambda: (lambda some: " ".join(fill(r.choice(some)) for _ in range(12)))(frames[:2] if r.random() < 0.5 else frames[2:])
    train, held = [text() for _ in range(400)], [text() for _ in range(40)]
    words, net = lm_score.fit(frame(spark, [(k, t, "", "", 0) for k, t in enumerate(train)]))
    got = lm_score.score(frame(spark, [(k, t, "", "", 0) for k, t in enumerate(held)]), words, net).agg(F.sum("log_likelihood"), F.sum("n_tokens")).first()
    one, two = Counter(w for t in train for w in t.split()), Counter(p for t in train for p in zip(t.split()[:-1], t.split()[1:], strict=True))
    total, vocabulary = sum(one.values()), len(one) + 1
    unigram = lambda w: (one[w] + 0.5) / (total + 0.5 * vocabulary)
    each = [(t.split()[k - 1] if k else "", w) for t in held for k, w in enumerate(t.split())]
    by_one = sum(np.log(unigram(w)) for _, w in each) / len(each)
    by_two = max(sum(np.log(a * (two[p, w] / one[p] if one[p] else unigram(w)) + (1 - a) * unigram(w)) for p, w in each) / len(each) for a in (0.3, 0.5, 0.7, 0.9))
    assert got[1] == len(each) and got[0] / got[1] > by_two + 0.1 > by_one + 0.1
    shared = {}
    for kind, names in parts.items():
        for bucket, _ in words.buckets(__import__("pyarrow").array(names)):
            for c in words.cls[bucket].tolist():
                shared.setdefault(c, Counter())[kind] += 1
    shared = [c for k, c in shared.items() if k >= lm_score.OWN_CLASS]
    assert sum(max(c.values()) for c in shared) > 0.9 * sum(sum(c.values()) for c in shared)  # a class holds words of one kind


def test_lm_rows(spark):
    """Repeated rows, rows without an id or text, names that clash; buckets grow with the words."""
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, None), (3, " "), (4, "x")]
    out = lm_score.lm_scores(spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, key string"))
    got = sorted((x.doc_id is None, x.doc_id or 0, x.n_tokens, round(x.log_likelihood, 4)) for x in out.collect())
    assert [g[:3] for g in got] == [(False, 1, 3), (False, 1, 3), (False, 2, 0), (False, 3, 0), (False, 4, 1), (True, 0, 3)]
    assert got[0][3] == got[1][3] == got[5][3] < 0 and got[2][3] == got[3][3] == 0
    assert [lm_score.bucket_bits(n) for n in (0, 10, 8192, 8193, 10**6, 10**9)] == [14, 14, 14, 15, 21, 22]


def search_by_hand(vectors, every, k, width=None):
    good = {i: np.floor(64 * np.array(v, float)) for i, v in vectors if v is not None and None not in v and np.isfinite(np.array(v, float)).all()}
    width = max((len(v) for v in good.values()), default=0)
    good = {i: np.pad(v, (0, width - len(v))) for i, v in good.items()}
    out = set()
    for q in (i for i in good if i % every == 0):
        best = sorted(((-int(v @ good[q]), i) for i, v in good.items() if i != q))[:k]
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize(("shard", "block", "scale"), [(1 << 20, 1024, 1), (800, 4, 1), (1 << 20, 1024, 3000)])
def test_top_k(spark, shard, block, scale):
    r = random.Random(6)
    vectors = [(k, [scale * r.gauss(0, 0.2) for _ in range(16)]) for k in range(400)]
    vectors += [(400 + k, [0.5] * 16) for k in range(30)] + [(500, None), (520, [None] * 16), (540, [float("nan")] * 16), (560, [float("inf")] * 16), (580, [0.1] * 3), (600, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    got = {(x.query_id, x["rank"], x.vec_id, x.score) for x in topk.top_k(df, every=20, k=7, shard_cells=shard, block=block).collect()}
    assert got == search_by_hand(vectors, 20, 7)
    assert topk.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize(("shard", "scale"), [(1 << 20, 1), (480, 1), (1 << 20, 3e6)])
def test_top_k_of_repeated_queries(spark, shard, scale):
    r = random.Random(8)
    vectors = [(k, [scale * r.gauss(0, 0.2) for _ in range(8)]) for k in range(1, 200)]
    vectors += [(0, [scale * 2.0] * 8)] * 25 + [vectors[19]] * 3
    rows = [(i, [int(x) for x in np.floor(64 * np.array(v))]) for i, v in vectors]
    want = []
    for q in range(0, 200, 20):
        own = next(v for i, v in rows if i == q)
        best = sorted((-sum(a * b for a, b in zip(v, own, strict=True)), i) for i, v in rows if i != q)[:7]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    got = [(x.query_id, x["rank"], x.vec_id, x.score) for x in topk.top_k(df, every=20, k=7, shard_cells=shard).collect()]
    assert sorted(got) == want


def test_search_by_proof_leaves_own_rows_out():
    r = np.random.default_rng(3)
    v = np.concatenate([np.zeros((5000, 8), np.int64), r.integers(32, 60, (40, 8)), np.full((30, 8), 99)])
    v[:5000, 0] = 1
    ids = np.concatenate([np.arange(1, 5041), np.zeros(30, np.int64)])
    index = topk.Shard(ids, v)
    lists = [p for some, _ in index.segments for p in some]
    assert sum(len(rows) for _, rows, _ in lists) == np.count_nonzero(v)
    index.segments[-1][0].clear()  # the components of 1, which the proof never reads
    row, col, score = index.search(np.array([0]), np.full((1, 8), 99), 20)
    want = sorted(((-int(x.sum()) * 99, i) for i, x in zip(ids, v, strict=True) if i))[:20]
    assert [(-s, i) for s, i in zip(score.tolist(), ids[col].tolist(), strict=True)] == want


def test_top_k_of_odd_rows(spark):
    """Rows without an id take no part, further columns may clash, scores beyond 64 bits are an error."""
    rows = [(0, [1.0, 0.0], 1), (None, [9.0, 9.0], 2), (1, [0.5, 0.5], 3), (2, [-1.0, 3.0], 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard int").withColumn("id", F.lit("x"))
    assert [tuple(x) for x in topk.top_k(df, k=2).collect()] == [(0, 1, 1, 2048), (0, 2, 2, -4096)]
    big = spark.createDataFrame([(0, [1e17]), (1, [1e17])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(big).collect()
