"""Operators against plain Python, on rows that the driver tables don't hold."""

import json
import string
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import dedup, evaluation, leakage, personal, sampling, validate
from lexmill.sources import records
from lexmill.streaming import events

ODD = ["", " ", "a b", " x　y\u001c", "a​b", None, "A  B\r\nC\t\n\n\n\nD", "Σ İ", "x" * 5000]


def test_white_space_like_python(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(ODD)], "id int, x string")
    got = {r.id: (r.c, r.s, r.k) for r in df.select("id", T.clean("x").alias("c"), T.folded("x").alias("s"), T.comparison_key("x").alias("k")).collect()}
    for k, v in enumerate(ODD):
        v = v or ""
        assert got[k] == (" ".join(v.split()), v.strip().lower(), " ".join(v.split()).lower())


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("ab c.", max_size=12), st.text("ab c.", max_size=12)), min_size=1, max_size=20))
def test_token_f1(spark, pairs):
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "id int, p string, r string")
    got = {r.id: r for r in evaluation.token_f1(df, "id", "p", "r", "punctuation").collect()}
    for k, (p, r) in enumerate(pairs):
        a, b = ("".join(c for c in x.lower() if c not in string.punctuation).split() for x in (p, r))
        c = sum((Counter(a) & Counter(b)).values())
        want = 2 * (c / len(a)) * (c / len(b)) / (c / len(a) + c / len(b)) if c else 0.0
        assert got[k].f1 == pytest.approx(want) and got[k].exact_match == int(a == b)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 60), min_size=1, max_size=12))
def test_quotas_are_exact(spark, sizes):
    counts = spark.createDataFrame([(f"k{k:02d}", n) for k, n in enumerate(sizes)], "k string, n long")
    q = sampling.split_quotas(counts, ["k"]).collect()
    total = sum(sizes)
    assert all(r.train >= 0 and r.validation >= 0 and r.test >= 0 and r.train + r.validation + r.test == r.n for r in q)
    assert sum(r.train for r in q) == int(total * 0.8 + 0.5) and all(abs(r.train - 0.8 * r.n) < 1 for r in q)


def test_equal_remainders_go_to_the_smaller_stratum(spark):
    sizes = {"a": 2718, "b": 18, "c": 112623, "d": 23, "e": 237, "f": 2792, "g": 2_999_999_998}
    counts = spark.createDataFrame(list(sizes.items()), "k string, n long")
    total, want, left = sum(sizes.values()), {}, sizes
    for share in (Fraction(8, 10), Fraction(1, 10)):
        base = {k: min(int(n * share), left[k]) for k, n in sizes.items()}
        more = sorted((k for k in sizes if left[k] > base[k]), key=lambda k: (base[k] - sizes[k] * share, k))[: int(total * share + Fraction(1, 2)) - sum(base.values())]
        quota = {k: base[k] + (k in more) for k in sizes}
        left = {k: left[k] - quota[k] for k in sizes}
        want = {k: (*want.get(k, ()), quota[k]) for k in sizes}
    got = {r.k: (r.train, r.validation) for r in sampling.split_quotas(counts, ["k"]).collect()}
    assert got == want
    assert got != {r.k: (r.train, r.validation) for r in sampling.split_quotas(counts, ["k"], 0.8, 0.1).collect()}


def test_quota_of_a_known_case(spark):
    counts = spark.createDataFrame([("easy", 237), ("hard", 196), ("length", 180)], "label string, n long")
    assert {r.label: r.quota for r in sampling.proportional_quotas(counts, "label", 100, ties="count").collect()} == {"easy": 39, "hard": 32, "length": 29}


def test_ranks_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 3)
    one = sorted(map(tuple, sampling.ranked(df.repartition(1), ["g"], "id", 7).select("id", "__rank").collect()))
    assert one == sorted(map(tuple, sampling.ranked(df.repartition(17), ["g"], "id", 7).select("id", "__rank").collect()))
    by = {}
    for i, r in one:
        by.setdefault(i % 3, []).append(r)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by.values())


def test_split_is_complete_and_disjoint(spark):
    df = spark.range(400).withColumn("g", F.when(F.col("id") < 300, "hot").otherwise("cold"))
    s = sampling.stratified_split(df, ["g"], "id", 1)
    assert s.count() == 400 and s.select("id").distinct().count() == 400
    assert {(r.g, r.split): r.n for r in s.groupBy("g", "split").agg(F.count("*").alias("n")).collect()} == {
        ("hot", "train"): 240, ("hot", "validation"): 30, ("hot", "test"): 30, ("cold", "train"): 80, ("cold", "validation"): 10, ("cold", "test"): 10
    }


def test_group_split_keeps_groups_apart(spark):
    df = spark.range(200).select("id", (F.col("id") % 20).alias("g"), F.lit("x").alias("l"), (F.col("id") * 1.0).alias("s"))
    s = sampling.group_split(df, F.col("g").cast("string"), "id", "l", "s", 10, 50, 3)
    sides = {}
    for r in s.collect():
        sides.setdefault(r.split, set()).add(r.g)
    assert not sides["train"] & sides["validation"]


def test_keep_first_and_empty(spark):
    df = spark.createDataFrame([(3, "A "), (1, "a"), (2, "b")], "id int, x string")
    assert sorted(r.id for r in dedup.keep_first(df, T.folded("x"), "id").collect()) == [1, 2]
    assert dedup.keep_first(df.limit(0), T.folded("x"), "id").count() == 0
    with pytest.raises(ValueError):
        dedup.require_distinct(df.select(F.lower(F.trim("x")).alias("x")), T.record_hash("x"))
    assert leakage.without_leaks(df, T.folded("x"), df.where("id = 1"), T.folded("x")).count() == 1


def test_phone_quirk_and_mask(spark):
    df = spark.createDataFrame([("+33 06 12 34 56",), ("+33 6 12 34 56 78",), ("mail a@b.io, a@b.ioé",)], "x string")
    assert [r.n for r in df.select(personal.counts(F.col("x"), ["phone_international"])["phone_international"].alias("n")).collect()] == [1, 0, 0]
    masked = [r.m for r in df.select(personal.anonymised(F.col("x"), "mask").alias("m")).collect()]
    assert masked[0] == "*" * 15 and masked[2] == "mail ******, a@b.ioé"
    once = df.select(personal.anonymised(F.col("x")).alias("x"))
    assert once.select(personal.anonymised(F.col("x")).alias("x")).collect() == once.collect()
    assert all(r.n == 0 for r in personal.residual(once, F.col("x")).collect())


def test_alerts_have_places(spark):
    df = spark.createDataFrame([(1, "see 10.0.0.1 and x@y.org", None), (2, None, "")], "id int, a string, b string")
    got = {(r.type, r.start, r.end, r.match, r.context) for r in personal.alerts(df, "id", ["a", "b"]).collect()}
    assert got == {("ip_address", 4, 12, "10.0.0.1", "see [PII] and x@y.org"), ("email", 17, 24, "x@y.org", "see 10.0.0.1 and [PII]")}


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "choices": {}}\n\nnot json\n[1, 2]\n{"id": "2", "source": "s"}\n')
    good, bad = records.json_lines(spark, str(tmp_path / "a.jsonl"), "id string, choices map<string,string>, source string")
    assert [(r.row.id, r.row.choices, r.row.source) for r in good.orderBy("ord").collect()] == [("1", {}, None), ("2", None, "s")]
    assert [r.raw for r in bad.orderBy("ord").collect()] == ["not json", "[1, 2]"]
    with pytest.raises(Exception, match="no JSON object in .*a.jsonl from byte 0 line 3: not json"):
        records.json_lines_strict(spark, str(tmp_path / "a.jsonl"), "id string").collect()
    out = str(tmp_path / "out")
    assert records.write_once(good.select("row.*"), out) and not records.write_once(good.select("row.*"), out)
    again = str(tmp_path / "batches")
    assert [records.write_incrementally(good.select("row.*"), again, "id", 3) for _ in range(2)] == [3, 0]
    assert spark.read.json(again).count() == 2
    assert '"choices":null' in "".join(r.value for r in spark.read.text(out).collect())
    assert records.first_existing(spark, [str(tmp_path / "none"), out]) == out
    (tmp_path / "b.json").write_text(json.dumps([{"id": "é"}, {"id": "2"}]))
    assert records.json_array(spark, str(tmp_path / "b.json"), "id string").count() == 2
    assert json.loads(records.report(records.json_array(spark, str(tmp_path / "b.json"), "id string")))[0]["id"] == "é"


def test_xml(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.xml").write_text(
        '<Document source="S" url="u"><Focus>F</Focus><QAPairs><QAPair><Question qid="1" qtype="t">What <b>is</b> it?</Question><Answer>That.</Answer></QAPair>'
        "<QAPair><Question qid='2'>x</Question></QAPair></QAPairs><Synonym>y</Synonym></Document>"
    )
    (tmp_path / "d" / "b.xml").write_text("<Document>")
    good, bad = records.xml_pairs(spark, str(tmp_path))
    assert [(r.question, r.answer, r.source, r.synonyms) for r in good.collect()] == [("What is it?", "That.", "S", ["y"])]
    assert bad.count() == 1


def test_missing_keys_and_waterfall(spark):
    df = spark.createDataFrame([('{"a": 1, "b": null}',), ("[1]",), (None,)], "raw string")
    assert [sorted(r.m) for r in df.select(validate.missing_keys(F.col("raw"), ["a", "b", "c"]).alias("m")).collect()] == [["c"], ["a", "b", "c"], ["a", "b", "c"]]
    reason = validate.drop_reason({"one": F.col("raw").isNull(), "two": F.length("raw") < 4})
    assert [r.r for r in df.select(reason.alias("r")).collect()] == ["usable", "two", "one"]


def test_stream_equals_batch(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "1.json").write_text("\n".join(json.dumps({"timestamp_utc": f"2024-01-01T0{k % 3}:10:00Z", "event": "triage", "status": "success", "latency_ms": k}) for k in range(9)))
    out = events.latency(events.log_stream(spark, str(log)), "timestamp_utc", ["event", "status"], "latency_ms", late="10 minutes")
    q = out.writeStream.format("memory").outputMode("complete").queryName("latencies").start()
    q.processAllAvailable()
    q.stop()
    batch = events.latency(spark.read.schema(events.EVENT).json(str(log)), "timestamp_utc", ["event", "status"], "latency_ms")
    assert sorted(spark.table("latencies").collect()) == sorted(batch.collect()) and batch.count() == 3
