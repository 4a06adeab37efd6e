"""Row-level metrics and preference scores as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import col

# Terms of evaluations and their weights.
POSITIVE_TERMS = {
    "accurate": 2.0, "accuracy": 2.0, "correct": 2.0, "correctly": 2.0, "evidence-based": 2.0, "evidence based": 2.0,
    "relevant": 1.5, "clinically relevant": 2.0, "appropriate": 1.0, "appropriate terminology": 1.5, "comprehensive": 1.0,
    "thorough": 1.0, "detailed": 0.75, "well-structured": 0.75, "well structured": 0.75, "informative": 0.75,
    "addresses": 0.5, "adheres": 1.0, "clear": 0.5,
}
NEGATIVE_TERMS = {
    "incorrect": -2.0, "inaccurate": -2.0, "error": -1.5, "errors": -1.5, "misleading": -2.0, "irrelevant": -2.0,
    "not relevant": -2.0, "hallucination": -2.5, "hallucinations": -2.5, "unsupported": -2.0, "unsafe": -2.5,
    "dangerous": -2.5, "wrong": -2.0, "fails to address": -1.5, "fails to answer": -1.5,
}
# Verdicts in feedback.
VERDICT_FIRST, VERDICT_SECOND = "final verdict: [[a]]", "final verdict: [[b]]"
TIE = 1e-8


def set_comparison(answer: Column | str, truth: Column | str) -> dict[str, Column]:
    """Category, precision, recall and F1 of two sets; two empty sets are EXACT with zeros."""
    a, t = col(answer), col(truth)
    common = F.size(F.array_intersect(a, t))
    ratio = lambda n: F.when(n > 0, common / n).otherwise(0.0)
    p, r = ratio(F.size(a)), ratio(F.size(t))
    same_a, same_t = common == F.size(a), common == F.size(t)
    return {
        "category": F.when(same_a & same_t, "EXACT").when(same_a, "UNDER").when(same_t, "OVER").otherwise("WRONG"),
        "precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0),
    }


def cardinality(truth: Column | str) -> Column:
    return F.when(F.size(col(truth)) == 1, "SINGLE").otherwise("MULTI")


def lexical_score(x: Column | str) -> Column:
    """Sum of the weights of the terms that occur in an evaluation, each once."""
    low = F.lower(F.coalesce(col(x), F.lit("")))
    total = F.lit(0.0)
    for term, weight in (POSITIVE_TERMS | NEGATIVE_TERMS).items():
        total = total + F.when(F.contains(low, F.lit(term)), weight).otherwise(0.0)
    return total


def blame(x: Column | str) -> Column:
    """Weight of the negative terms that occur, as a positive number."""
    low = F.lower(F.coalesce(col(x), F.lit("")))
    total = F.lit(0.0)
    for term, weight in NEGATIVE_TERMS.items():
        total = total + F.when(F.contains(low, F.lit(term)), -weight).otherwise(0.0)
    return total


def selection_score(chosen: Column, rejected: Column, feedback: Column) -> Column:
    """How clearly the chosen side is better; sides are structs of score, rank and evaluation."""
    c, r = chosen["score"], rejected["score"]
    by_score = F.when(c.isNotNull() & r.isNotNull(), 5 * (c - r) + c - F.when(c < 4, 3.0).otherwise(0.0)).otherwise(0.0)
    gap = rejected["rank"] - chosen["rank"]
    by_rank = F.when(gap > 0, 1.5 * F.least(gap, F.lit(5))).when(gap < 0, -5.0).otherwise(0.0)
    low = F.lower(F.coalesce(feedback, F.lit("")))
    verdict = F.when(F.contains(low, F.lit(VERDICT_FIRST)), 3.0).when(F.contains(low, F.lit(VERDICT_SECOND)), -8.0).otherwise(0.0)
    return (
        by_score + by_rank + 1.5 * lexical_score(chosen["evaluation"])
        + F.least(blame(rejected["evaluation"]), F.lit(5.0)) + lexical_score(feedback) + verdict
    )


def is_coherent(chosen: Column, rejected: Column, feedback: Column) -> Column:
    """No score, rank or verdict speaks against the chosen side; what is missing doesn't."""
    against = F.coalesce(chosen["score"] < rejected["score"], F.lit(False)) | F.coalesce(chosen["rank"] > rejected["rank"], F.lit(False))
    return ~(against | F.contains(F.lower(F.coalesce(feedback, F.lit(""))), F.lit(VERDICT_SECOND)))


def decision(chosen: Column | str, rejected: Column | str) -> Column:
    d = col(chosen) - col(rejected)
    return F.when(F.abs(d) < TIE, "tie").when(d > 0, "chosen").otherwise("rejected")


def mean_answer_score(values: Column | str, prompt_size: Column | str) -> Column:
    """Mean of the values after the prompt's; minus infinity if none are left."""
    tail = F.slice(col(values), col(prompt_size) + 1, F.greatest(F.size(col(values)) - col(prompt_size), F.lit(0)))
    return F.when(F.size(tail) > 0, F.aggregate(tail, F.lit(0.0), lambda s, x: s + x) / F.size(tail)).otherwise(float("-inf"))


#: The judge's four criteria.
CRITERIA = ("faithfulness", "answer_relevancy", "correctness", "completeness")


def judge_scores(raw: Column | str) -> Column:
    """The criteria's scores as a struct, or null: a JSON object, fenced or not, of just the
    four criteria, each with an integer score from 0 to 5 and a reason."""
    bare = F.trim(F.regexp_replace(F.trim(F.coalesce(col(raw), F.lit(""))), r"^```(?:json)?\s*|\s*```$", ""))
    schema = "map<string,struct<score:string,reason:string>>"
    parsed = F.from_json(bare, schema)
    keys = F.array_sort(F.map_keys(parsed))
    good = keys == F.array_sort(F.array(*map(F.lit, CRITERIA)))
    for c in CRITERIA:
        item = F.try_element_at(parsed, F.lit(c))
        good = good & item["score"].rlike("^[0-5]$") & item["reason"].isNotNull()
        # a string in quotes is no integer
        good = good & ~F.coalesce(F.get_json_object(bare, f"$.{c}").rlike(r'"score"\s*:\s*"'), F.lit(False))
    return F.when(F.coalesce(good, F.lit(False)), F.struct(*(F.try_element_at(parsed, F.lit(c))["score"].cast("int").alias(c) for c in CRITERIA)))
