"""The whole flows, and gates that fail, on small rows."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import joins, scoring, validate
from lexmill.plans import flows
from lexmill.sources.schemas import RAW_PREFERENCE


def test_instruction_corpus(spark):
    def part(name, n):
        return spark.createDataFrame(
            [(f"{name}{k}", k, f"Question {name} {k % (n - 5)}", f"mail me{k % (n - 5)}@x.org", "en" if k % 3 else "fr", "qa") for k in range(n)],
            "id string, ord int, instruction string, response string, language string, task string",
        )

    c = flows.instruction_corpus({"a": part("a", 60), "b": part("b", 40)}, {"a": 50, "b": 30})
    assert c.splits.count() == 80
    assert c.conformance.where("expected <> actual").count() == 0
    assert c.overlaps.count() == 0
    assert all(r.n == 0 for r in c.residual.collect())
    assert c.splits.where(F.col("response") == "mail [EMAIL]").count() == 80
    assert {r.split for r in c.fingerprints.collect()} == {"train", "validation", "test"}


def test_preference_data(spark):
    def talk(prompt, answer):
        return [("user", prompt), ("assistant", answer)]

    rows = []
    for k in range(40):
        p = f"prompt {k % 30}"
        meta = ((5.0, 1, "accurate"), (3.0, 2, "wrong"), None)
        rows.append((k, p, None, ("easy", "hard", "length")[k % 3], talk(p, f"good {k}"), talk(p, f"bad {k}"), None, meta, "train"))
    rows += [
        (40, "", None, "easy", talk("", "a"), talk("", "b"), None, None, "train"), (41, "q", None, "odd", talk("q", "a"), talk("q", "b"), None, None, "dev"),
        (42, "Known ", None, "easy", talk("q", "a"), talk("q", "b"), None, None, "dev"), (43, "bench", None, "easy", talk("q", "a"), talk("q", "b"), None, None, "dev"),
        (44, "q2", None, "easy", talk("q", "a"), talk("q", "b"), "final verdict: [[B]]", None, "dev"), (45, "prompt 1", None, "hard", talk("p", "good 1"), talk("p", "bad 1"), None, None, "dev"),
    ]
    raw = spark.createDataFrame(rows, "ord int, " + RAW_PREFERENCE)
    one = lambda x: spark.createDataFrame([(x,)], "prompt string")
    out = flows.preference_data(raw, one("known"), one("bench"), train=12, validation=6)
    assert {r.reason: r.n for r in out.reasons.collect()} == {
        "usable": 40, "invalid": 1, "invalid_label": 1, "sft_leakage": 1, "benchmark_leakage": 1, "incoherent_preference": 1, "duplicate_id": 1
    }
    got = out.rows.collect()
    assert sum(r.split == "validation" for r in got) == 6 and sum(r.split == "train" for r in got) == 12
    assert not {r.prompt for r in got if r.split == "train"} & {r.prompt for r in got if r.split == "validation"}


def test_evaluated(spark):
    df = spark.createDataFrame([(1, "a b", "a b", "en", "qa"), (2, "x", "y", "fr", "qa")], "id int, prediction string, reference string, language string, task string")
    _, means = flows.evaluated(df)
    assert {(r.dimension, r.value): (r.n, r.mean_f1) for r in means.collect()} == {("all", "all"): (2, 0.5), ("language", "en"): (1, 1.0), ("language", "fr"): (1, 0.0), ("task", "qa"): (2, 0.5)}


def test_gates(spark):
    df = spark.createDataFrame([(1, "a"), (2, " ")], "id int, x string")
    with pytest.raises(Exception, match="row 2: x_blank"):
        validate.require_valid(df, "id", {"x_blank": T.clean("x") != ""}).collect()
    with pytest.raises(ValueError):
        validate.require_schema(df, "id long, x string")
    assert validate.require_schema(df, "x string, id int") is df
    with pytest.raises(Exception, match="no row for 2"):
        joins.strict_lookup(df, df.where("id = 1").withColumnRenamed("x", "y"), "id", F.col("y")).collect()
    assert joins.by_position(df, df.withColumnRenamed("x", "y"), "id").count() == 2


def test_scorer_is_reproducible(spark):
    df = spark.createDataFrame([("p", "a"), ("p", "b")], "p string, a string")
    one = scoring.scored(df, scoring.HashScorer(), "p", "a").collect()
    assert one == scoring.scored(df.repartition(2), scoring.HashScorer(), "p", "a").orderBy("a").collect()
    assert "score" not in df.columns
