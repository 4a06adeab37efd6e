"""Rules of JSON records, walks, anonymisation, gates, and rows that earlier versions lost."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import dedup, evaluation, personal, sampling, scoring, validate
from lexmill.sources import records

GOOD = {
    "id": "1", "instruction": "q", "response": "a", "language": "fr", "task": "medical_qa", "source": {"dataset": "MedQuAD", "original_id": "7"},
    "clinical_context": {"clinical_case": "", "symptoms": [], "history": ["x"], "vitals": [], "diagnosis": None, "medications": [], "allergies": []},
    "source_specific": {"question_type": "", "question_focus": "", "synonyms": [], "umls_cui": "", "choices": {}, "correct_answers": [], "semantic_types": ["T1"], "semantic_group": None},
    "quality": {"confidence": None, "validated": False}, "provenance": {"source_license": None, "processing_version": "1"},
}


def broken(spark, rules, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "id int, raw string")
    out = {k: set() for k in range(len(rows))}
    for r in validate.errors(df, "id", rules(F.col("raw"))).collect():
        out[r.id].add(r.rule)
    return [out[k] for k in sorted(out)]


def changed(path, value):
    record = json.loads(json.dumps(GOOD))
    *parents, last = path.split(".")
    at = record
    for p in parents:
        at = at[p]
    at[last] = value
    return json.dumps(record)


def test_sft_rules(spark):
    own = {**GOOD["source_specific"], "semantic_types": [1], "semantic_group": 3}
    subject = {**GOOD["source_specific"], "medical_subject": 3, "semantic_group": 3}
    cases = [
        (json.dumps(GOOD), set()), ("[1]", {"record_object"}), ("no json", {"record_object"}), (changed("id", 3), {"id_blank"}),
        (changed("source_specific", own), {"semantic_types_strings", "semantic_group_string"}),
        (changed("quality.confidence", True), set()), (changed("quality.confidence", "1"), {"confidence_number"}),
        (changed("clinical_context.symptoms", ["a", None]), {"symptoms_strings"}), (changed("extra", 1), set()), (None, {"record_object"}),
    ]
    assert broken(spark, validate.sft_rules, [c for c, _ in cases]) == [want for _, want in cases]
    other = json.loads(changed("source_specific", subject))
    other["source"]["dataset"] = "MediQAl"
    assert broken(spark, validate.sft_rules, [json.dumps(other)]) == [{"medical_subject_string"}]


def test_shape_rules(spark):
    lists = changed("clinical_context.symptoms", [1, None])
    bare = changed("source_specific", {"choices": {}, "correct_answers": []})
    assert broken(spark, validate.shape_rules, [json.dumps(GOOD), lists, bare, changed("provenance", [])]) == [set(), set(), {"MedQuAD_keys"}, {"provenance_object"}]


def test_preference_metadata_rules(spark):
    good = {"source": {"dataset": validate.PREFERENCE_DATASET, "split": "train", "label_type": "hard"}, "quality": {"clinically_validated": False, "clinical_validation_status": "pending"}}
    rows = [good, {**good, "quality": {}}, {"source": "x"}, {**good, "source": {**good["source"], "split": "test", "label_type": None}}]
    rules = lambda raw: validate.preference_metadata_rules(raw, "train")
    assert broken(spark, rules, [json.dumps(r) for r in rows]) == [set(), {"clinically_validated", "clinical_validation_status"}, set(), {"split", "label_type"}]


def test_preference_rules(spark):
    df = spark.createDataFrame([(0, "p", "a", "a "), (1, " ", "a", None), (2, "p", "a", "b")], "id int, p string, c string, r string")
    rules = lambda exact: sorted(map(tuple, validate.errors(df, "id", validate.preference_rules(F.col("p"), F.col("c"), F.col("r"), exact)).collect()))
    assert rules(False) == [(0, "equal_answers"), (1, "prompt_blank"), (1, "rejected_blank")] or rules(False) == [(0, "equal_answers"), (1, "equal_answers"), (1, "prompt_blank"), (1, "rejected_blank")]
    assert (0, "equal_answers") not in rules(True)
    talk = lambda x: [("user", "q"), ("assistant", x)]
    kind = "id int, p string, c array<struct<role:string,content:string>>, r array<struct<role:string,content:string>>"
    both = spark.createDataFrame([(0, "p", talk("a"), talk("a ")), (1, "p", talk("a"), talk("a")), (2, "p", talk("a"), [("user", "q")])], kind)
    got = validate.errors(both, "id", validate.conversation_preference_rules(F.col("p"), F.col("c"), F.col("r"))).collect()
    assert {(r.id, r.rule) for r in got} == {(1, "equal_answers"), (2, "rejected_blank"), (2, "equal_answers"), (2, "rejected_invalid")}


def test_walk_and_protection(spark):
    record = {"id": "1", "a": [{"b": "x", "url": "y"}, "z"], "provenance": {"source_id": "s", "note": "n", "deep": [["v"]]}, "n": 3}
    df = spark.createDataFrame([(1, json.dumps(record)), (2, "no"), (3, None)], "k int, raw string")
    got = {(r.k, r.path, r.text) for r in personal.json_texts(df, "k", "raw").collect()}
    assert got == {(1, "a[0].b", "x"), (1, "a[0].url", "y"), (1, "a[1]", "z"), (1, "provenance.note", "n"), (1, "provenance.deep[0][0]", "v")}
    skip = personal.protects(("url",), ("source", "a.b"))
    assert [skip(*x) for x in (("m.url", "url"), ("source", "source"), ("source.x[0]", "x"), ("sources", "sources"), ("a.b[1].c", "c"), ("a.bc", "bc"))] == [True, True, True, False, True, False]


def test_licence_numbers_and_overlaps():
    find = personal.PatternRecogniser(persons=("Ann Lee", "Ann"), places=("Lyon",))
    text = "Ann Lee of Lyon, AB1234563 and AB1234567, ann.lee@x.org"
    spans = personal.resolved(find(text, "en"))
    assert [(text[a:b], e) for a, b, e in spans] == [("Ann Lee", "PERSON"), ("Lyon", "LOCATION"), ("AB1234563", "MEDICAL_LICENSE"), ("ann.lee@x.org", "EMAIL")]
    assert personal.rewritten(text, spans, "replace").startswith("[PERSON] of [LOCATION], [MEDICAL_LICENSE] and")
    assert personal.rewritten("x" * 3000, [(0, 2000, "URL")], "mask") == "*" * 1000 + "x" * 1000
    assert personal.rewritten("a b", [(0, 1, "URL")], "redact") == " b"
    assert personal.resolved([(0, 4, "A", 0.9), (2, 9, "B", 0.5), (8, 12, "C", 0.2), (9, 11, "D", 0.4)]) == [(2, 9, "B"), (9, 11, "D")]


def test_anonymised_json(spark):
    rows = [(1, "fr", {"url": "a@b.org", "t": ["a@b.org and c@d.org"], "source": {"t": "a@b.org"}}), (2, "it", {"t": "a@b.org"}), (3, "en", {"t": "none"})]
    df = spark.createDataFrame([(k, c, json.dumps(r)) for k, c, r in rows] + [(4, "en", "no json")], "k int, lang string, raw string")
    out = personal.anonymised_json(df, "raw", personal.PatternRecogniser(), "lang").withColumn("dataset", F.lit("d"))
    got = {r.k: (r.raw, r.found) for r in out.collect()}
    assert json.loads(got[1][0]) == {"url": "a@b.org", "t": ["[EMAIL] and [EMAIL]"], "source": {"t": "a@b.org"}} and got[1][1] == {"EMAIL": 2}
    assert json.loads(got[2][0]) == rows[1][2] and got[2][1] is None and got[3] == (json.dumps(rows[2][2]), {}) and got[4] == ("no json", None)
    report = {(r.dataset, r.entity): (r.n, r.n_records) for r in personal.anonymisation_report(out, "dataset").collect()}
    each = {"EMAIL": (2, 1), "any": (2, 1), "untouched": (0, 2)}
    assert report == {(d, e): v for d in ("d", "all") for e, v in each.items()}


ODD = ["06 12 34 56 78", "né a@b.org", "éa@b.org", "٠١٢٣٤", "tel 0612345678x", "\x1c12-03-1980", "HTTP://X.org", "May 2020", "1.2.3.4é", "(2A 123)", "00 33 6 12 34 56 78", None, ""]


def test_alerts_have_one_meaning(spark):
    """Counts in the JVM, alerts in Python and a plain scan agree on Unicode text."""
    r = random.Random(5)
    pieces = ["06", "12", " ", " ", "é", "@", "b.org", ".", "-", "/", "1980", "may", "http://", "٣", "x", "123", "45", "6789", "\x1d", "(", "+33", "192.168.1.7"]
    texts = ODD + ["".join(r.choice(pieces) for _ in range(r.randint(1, 14))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    want = {(k, n, m.start(), m.end()) for k, t in enumerate(texts) if t for n, p in personal.PATTERNS.items() for m in re.finditer(p, t)}
    found = personal.alerts(df, "k", ["text"]).collect()
    assert {(x.k, x.type, x.start, x.end) for x in found} == want
    counts = df.select("k", *(c.alias(n) for n, c in personal.counts(F.col("text")).items())).collect()
    assert {(x.k, n): x[n] for x in counts for n in personal.PATTERNS if x[n]} == {(k, n): sum(w[:2] == (k, n) for w in want) for k, n, _, _ in want}


def test_control_patterns(spark):
    df = spark.createDataFrame([(1, "12-03-1980"), (2, "HTTP://x.org"), (3, "le 1/2/2001."), (4, "a12/03/1980")], "k int, t string")
    got = {(r.k, r.type) for r in personal.control_findings(df, "k", F.col("t"), ("date", "url")).collect()}
    assert got == {(1, "date"), (2, "url"), (3, "date")}


def test_null_strata_keep_their_rows(spark):
    df = spark.createDataFrame([(k, None if k % 10 == 0 else f"s{k % 3}", float(k)) for k in range(100)], "id int, s string, score double")
    split = sampling.stratified_split(df, ["s"], "id", 1)
    assert sampling.require_complete(df, split, "id").count() == 100
    assert sum(r.actual for r in sampling.split_conformance(split, ["s"]).collect()) == 100
    assert all(r.expected == r.actual for r in sampling.split_conformance(split, ["s"]).collect())
    assert sampling.stratified_sample(df, "s", "id", 50, 1).count() == 50
    assert sampling.stratified_top(df, "s", "id", "score", 50, 1).count() == 50
    assert sampling.group_split(df, F.col("id").cast("string"), "id", "s", "score", 20, 40, 1).groupBy("split").count().collect().__len__() == 2
    for wrong in (split.where("id <> 3"), split.union(split.limit(1)), split.withColumn("id", F.when(F.col("id") == 5, 6).otherwise(F.col("id")))):
        with pytest.raises(ValueError, match="once over|several"):
            sampling.require_complete(df, wrong, "id")
    with pytest.raises(ValueError, match="from 100"):
        sampling.sample(df, "id", 101, 1, strict=True)


def test_keep_first_of_rows_without_order(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("a", None), ("b", None), (None, 5), (None, 4)], "k string, ord int")
    assert sorted(map(str, map(tuple, dedup.keep_first(df, F.col("k"), "ord").collect()))) == sorted(map(str, [(1, "a"), (None, "a"), (None, "b"), (4, None)]))


def test_gates(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "ord int, k string")
    assert dedup.require_known(df, F.col("k"), "ord", [F.lit("a")]).count() == 2
    with pytest.raises(ValueError, match="unexpected"):
        dedup.require_known(df, F.col("k"), "ord", [F.lit("b")])
    assert dedup.require_count(df, 3) is df
    with pytest.raises(ValueError, match="instead of"):
        dedup.require_count(df, 4)
    assert "b" in records.text_report("t", {"s": df})
    with pytest.raises(ValueError, match="more than 2"):
        records.text_report("t", {"s": df}, most_rows=2)
    records.write_json_lines(df, f"{tmp_path}/x", mode="errorifexists")
    with pytest.raises(Exception, match="already exists"):
        records.write_json_lines(df, f"{tmp_path}/x", mode="errorifexists")


def test_json_arrays_and_missing_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1, "y": "p"}, 3, null, {"x": 2}]')
    (tmp_path / "b.json").write_text('{"x": 1}')
    got = records.json_array(spark, f"{tmp_path}/a.json", "x int, y string").collect()
    assert sorted((r.x, r.y) for r in got) == [(1, "p"), (2, None)]
    with pytest.raises(Exception, match="no JSON array"):
        records.json_array(spark, f"{tmp_path}/b.json", "x int").collect()
    (tmp_path / "dev.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    with pytest.warns(UserWarning, match="test.jsonl"):
        good, bad = records.json_lines_of(spark, [f"{tmp_path}/dev.jsonl", f"{tmp_path}/test.jsonl"], "x int")
    assert {(r.row.x, r.split) for r in good.collect()} == {(1, "dev"), (2, "dev")} and bad.count() == 0


def test_values(spark):
    df = spark.createDataFrame([(1, '{"prediction": "", "response": "x"}'), (2, '{"prediction": 3, "answer": "y"}'), (3, "{}")], "k int, raw string")
    assert {r.k: r.p for r in df.select("k", T.first_string("raw", "prediction", "response", "generated_text", "answer").alias("p")).collect()} == {1: "", 2: "y", 3: ""}
    one = spark.createDataFrame([([" a ", "", None, "b  c"], [("user", " Hi "), ("", ""), (None, "x")])], "l array<string>, m array<struct<role:string,content:string>>")
    got = one.select(T.cleaned_list("l").alias("l"), T.conversation_key("m").alias("m"), T.prefixed_id("v1_", "l").alias("i")).first()
    assert got.l == ["a", "b c"] and got.m == "user:hi\n:x" and re.fullmatch("v1_[0-9a-f]{16}", got.i)


def test_generation_and_positions(spark):
    df = spark.createDataFrame([(k, f"ask {k}", "good", "bad") for k in range(200)], "id int, prompt string, chosen string, rejected string")
    p = scoring.positions(df, "id", "chosen", "rejected").collect()
    assert all((r.answer_a, r.answer_b) == (("good", "bad") if r.expected == "A" else ("bad", "good")) for r in p)
    assert 60 < sum(r.expected == "A" for r in p) < 140
    assert {r.prediction for r in scoring.generated(df, scoring.EchoGenerator(), "prompt").collect()} == {f"ask {k}" for k in range(200)}
    both = scoring.scored_pairs(df, scoring.HashScorer(), "prompt", "chosen", "rejected").collect()
    one = {r.id: r.score for r in scoring.scored(df, scoring.HashScorer(), "prompt", "chosen").collect()}
    assert all(r.chosen_score == one[r.id] for r in both)
    assert evaluation.accuracy(df, F.col("id") < 50, F.col("id") < 100).first().of_valid == 0.5
