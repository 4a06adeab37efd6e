"""Queries over records as JSON: rules of whole records, walks over their texts, anonymisation, answer positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import scores as S
from lexmill.functions import text as T
from lexmill.operators import evaluation, personal, sampling, scoring, validate
from lexmill.plans.queries import _CONV, _PAIRS, conversations, docs, pairs
from lexmill.plans.registry import query

#: Parts of a record as JSON, of which each document takes one by its id, and the rules that the part breaks.
PARTS: dict[str, list[tuple[str, str]]] = {
    "id": [('"x"', ""), ('""', "id_blank"), ("7", "id_blank")],
    "instruction": [('"q"', ""), ('" \\t"', "instruction_blank")],
    "response": [('"a"', ""), ("null", "response_blank"), ('"b"', "")],
    "task": [('"medical_qa"', ""), ('"medical_mcq"', ""), ('"clinical_reasoning"', ""), ('"else"', "task_allowed"), ('["medical_qa"]', "task_allowed")],
    "source": [
        ('{"dataset":"MedQuAD","original_id":"1"}', ""), ('{"dataset":"FrenchMedMCQA","original_id":"1"}', ""), ('"MediQAl"', "source_object"),
        ('{"dataset":"MediQAl"}', "source_keys original_id_blank"), ('{"dataset":"other","original_id":" "}', "dataset_allowed original_id_blank"),
        ("{}", "source_keys dataset_allowed original_id_blank"), ("[]", "source_object"),
    ],
    "clinical_context": [
        ('{"clinical_case":"","symptoms":["a"],"history":[],"vitals":[],"diagnosis":null,"medications":[],"allergies":[]}', ""),
        ('{"clinical_case":"","symptoms":["a",1],"history":"b","vitals":[null],"diagnosis":null,"medications":[],"allergies":[]}', "symptoms_strings history_strings vitals_strings"),
        ('{"symptoms":[]}', "clinical_context_keys"), ("null", "clinical_context_object"),
    ],
    "source_specific": [
        ('{"question_type":"","question_focus":"","synonyms":[],"umls_cui":"","choices":{"A":"v"},"correct_answers":["A"]}', ""),
        ('{"question_type":"","question_focus":"","synonyms":{},"umls_cui":"","choices":{"A":1},"correct_answers":"A"}', "synonyms_strings choices_strings correct_answers_strings"),
        ('{"choices":[],"correct_answers":[]}', "source_specific_keys choices_object"),
    ],
    "quality": [('{"confidence":0.5,"validated":true}', ""), ('{"confidence":"high","validated":0}', "confidence_number validated_boolean"), ('{"confidence":null,"validated":false}', "")],
    "provenance": [('{"source_license":"x","processing_version":"v1"}', ""), ('{"processing_version":""}', "provenance_keys processing_version_blank"), ("1", "provenance_object")],
}


def _part(name: str, options: list[tuple[str, str]]):
    """The document's part of that name; the divisor differs by name, so that parts meet in many ways."""
    pick = F.get(F.array(*(F.lit(p) for p, _ in options)), F.pmod(F.floor(F.col("doc_id") / (1 + len(name))), F.lit(len(options))).cast("int"))
    return F.concat(F.lit(f'"{name}":'), pick)


def sft_records(spark, d):
    language = F.concat(F.lit('"language":'), F.to_json(F.array("lang")).substr(F.lit(2), F.length(F.to_json(F.array("lang"))) - 2))
    return docs(spark, d).select("doc_id", F.concat(F.lit("{"), F.concat_ws(",", language, *(_part(n, o) for n, o in PARTS.items())), F.lit("}")).alias("raw"))


def _broken(parts: list[str], rules: dict[str, str] | None = None) -> str:
    """SQL rows (name, divisor, options, option, rule) of what the parts break."""
    rows = [(n, 1 + len(n), len(PARTS[n]), k, r) for n in parts for k, (_, broken) in enumerate(PARTS[n]) for r in broken.split() if rules is None or r in rules]
    return ", ".join(f"('{n}', {v}, {m}, {k}, '{rules[r] if rules else r}')" for n, v, m, k, r in rows)


@query(f"""with b(name, v, m, k, rule) as (values {_broken([*PARTS])})
    select doc_id, rule from documents join b on (doc_id // v) % m = k union all select doc_id, 'language_allowed' from documents where lang is null or lang not in ('fr', 'en')""")
def sft_record_errors(spark, d):
    return validate.errors(sft_records(spark, d), "doc_id", validate.sft_rules(F.col("raw")))


_SHAPES = {
    "clinical_context_object": "clinical_context_object", "clinical_context_keys": "clinical_context_keys", "history_strings": "history_array",
    "provenance_object": "provenance_object", "provenance_keys": "provenance_keys",
}


@query(f"""with b(name, v, m, k, rule) as (values {_broken(["clinical_context", "provenance"], _SHAPES)}),
    s as (select doc_id, (doc_id // 7) % 7 as source, (doc_id // 16) % 3 as own from documents)
    select doc_id, rule from documents join b on (doc_id // v) % m = k
    union all select doc_id, 'source_known' from s where source not in (0, 1, 3)
    union all select doc_id, 'MedQuAD_keys' from s where source = 0""")
def record_shape_errors(spark, d):
    return validate.errors(sft_records(spark, d), "doc_id", validate.shape_rules(F.col("raw")))


@query("""select doc_id, unnest(list_filter([case when doc_id % 7 = 1 then 'dataset' end, case when doc_id % 5 = 2 then 'split' end,
      case when source not in ('src1', 'src2', 'src3') then 'label_type' end, case when doc_id % 3 = 0 then 'clinically_validated' end,
      case when doc_id % 4 = 0 then 'clinical_validation_status' end], lambda x: x is not null)) as rule from documents where doc_id % 11 <> 0""")
def preference_metadata_errors(spark, d):
    i = F.col("doc_id")
    label = F.element_at(F.create_map(*(F.lit(x) for x in ("src1", "easy", "src2", "hard", "src3", "length"))), F.col("source"))
    source = F.struct(
        F.when(i % 7 == 1, "Else").otherwise(validate.PREFERENCE_DATASET).alias("dataset"), F.when(i % 5 == 2, "test").otherwise("train").alias("split"), label.alias("label_type"),
    )
    quality = F.struct((i % 3 == 0).alias("clinically_validated"), F.when(i % 4 != 0, "pending").alias("clinical_validation_status"))
    raw = F.to_json(F.struct(F.when(i % 11 != 0, source).alias("source"), quality.alias("quality")))
    return validate.errors(docs(spark, d).select("doc_id", raw.alias("raw")), "doc_id", validate.preference_metadata_rules(F.col("raw"), "train"))


@query(f"""with {_PAIRS}, h as (select *, substr(sha256(concat('42_', conv_id)), 1, 1) < '8' as f from p)
    select conv_id, case when f then 'A' else 'B' end as expected, sha256(case when f then chosen else rejected end) as a, sha256(case when f then rejected else chosen end) as b from h""")
def answer_positions(spark, d):
    p = scoring.positions(pairs(spark, d), "conv_id", "chosen", "rejected")
    return p.select("conv_id", "expected", F.sha2("answer_a", 256).alias("a"), F.sha2("answer_b", 256).alias("b"))


@query(f"""with {_PAIRS}, h as (select conv_id, substr(sha256(concat('42_', conv_id)), 1, 1) < '8' as f,
      cast(concat('0x', substr(sha256(prompt), 1, 8)) as bigint) % 3 as g from p)
    select count(*) as n, count(*) filter (g < 2) as n_valid, count(*) filter (g < 2 and f = (g = 0)) as n_correct,
      count(*) filter (g < 2 and f = (g = 0)) / count(*) filter (g < 2) as of_valid, count(*) filter (g < 2 and f = (g = 0)) / count(*) as of_all from h""")
def position_accuracy(spark, d):
    """Choices of a stand-in judge between A and B, against where the chosen answer was put."""
    p = scoring.positions(pairs(spark, d), "conv_id", "chosen", "rejected").select("prompt", "expected")
    judged = scoring.generated(p, scoring.EchoGenerator(("Answer: A", "B.", "maybe")), "prompt", "raw").withColumn("choice", T.parsed_choice("raw"))
    return evaluation.accuracy(judged, F.col("choice") == F.col("expected"), F.col("choice").isNotNull())


@query(f"""with {_PAIRS}, s as (select conv_id, -2 * cast(concat('0x', substr(sha256(concat(prompt, chr(10), chosen)), 1, 12)) as bigint) / 281474976710656.0 as c,
      -2 * cast(concat('0x', substr(sha256(concat(prompt, chr(10), rejected)), 1, 12)) as bigint) / 281474976710656.0 as r from p)
    select conv_id, case when abs(c - r) < 1e-8 then 'tie' when c > r then 'chosen' else 'rejected' end as preferred from s""")
def pair_decisions(spark, d):
    s = scoring.scored_pairs(pairs(spark, d), scoring.HashScorer(), "prompt", "chosen", "rejected")
    return s.select("conv_id", S.decision("chosen_score", "rejected_score").alias("preferred"))


_STRATA = "case when doc_id % 3 = 0 then null else lang end"


@query(f"""with c as (select *, {_STRATA} as label from documents), g as (select label, count(*) as n from c group by label),
    s as (select *, n * 0.8::double as st, sum(n) over () as total from g), b as (select *, floor(st) as bt, st - floor(st) as ft from s),
    t as (select *, bt + case when row_number() over (order by ft desc, label nulls first) <= round(total * 0.8::double) - sum(bt) over () then 1 else 0 end as train from b),
    sv as (select *, n * 0.1::double as s2 from t), bv as (select *, least(floor(s2), n - train) as b2, s2 - floor(s2) as f2 from sv),
    v as (select *, b2 + case when n - train > b2 and row_number() over (partition by n - train > b2 order by f2 desc, label nulls first) <= round(total * 0.1::double) - sum(b2) over () then 1 else 0 end as validation from bv)
    select label, cast(n as bigint) as n, cast(train as bigint) as train, cast(validation as bigint) as validation, cast(n - train - validation as bigint) as test from v""")
def null_stratum_split(spark, d):
    """A split by strata of which one is null; each row is in one split. Its quotas, like its SQL's, are computed in doubles."""
    x = docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("label"))
    split = sampling.stratified_split(x, ["label"], "doc_id", 7, train=0.8, validation=0.1)
    count = lambda s: F.count_if(F.col("split") == s).alias(s)
    return split.groupBy("label").agg(F.count("*").alias("n"), *map(count, sampling.SPLITS))


@query(f"""with {_CONV}, t as (select conv_id, messages, unnest(range(1, len(messages) + 1)) as k from m)
    select conv_id, concat('messages[', k - 1, '].content') as path, sha256(messages[k].content) as text_sha256 from t
    union all select conv_id, concat('messages[', k - 1, '].role'), sha256(messages[k].role) from t
    union all select conv_id, 'provenance.note', sha256('x') from m""")
def json_field_walk(spark, d):
    """Every string in JSON records, but the excluded paths."""
    provenance = F.struct(F.lit("s1").alias("source_id"), F.lit("x").alias("note"))
    r = conversations(spark, d).select("conv_id", F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), "messages", provenance.alias("provenance"))).alias("raw"))
    return personal.json_texts(r, "conv_id", "raw").select("conv_id", "path", F.sha2("text", 256).alias("text_sha256"))


def _documents_json(spark, d):
    inner = F.struct(F.col("text").alias("content"), F.col("text").alias("note"))
    record = F.struct(F.col("doc_id").cast("string").alias("id"), F.struct(F.col("text").alias("dataset")).alias("source"), F.array(inner).alias("chosen"), F.struct(F.col("text").alias("url")).alias("meta"))
    return docs(spark, d).select("doc_id", "lang", F.col("source").alias("dataset"), F.to_json(record).alias("raw"))


_EMAILS = r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"


@query(rf"""with t as (select *, coalesce(lang in ('en', 'fr'), false) as mine, regexp_replace(text, '{_EMAILS}', '[EMAIL]', 'g') as new, len(regexp_extract_all(text, '{_EMAILS}')) as n from documents)
    select doc_id, sha256(case when mine then new else text end) as content, sha256(case when mine then new else text end) as note, sha256(text) as url, sha256(text) as dataset,
      case when mine then 2 * n end as n_email from t""")
def anonymised_records(spark, d):
    """JSON records with protected keys and paths at several depths, anonymised in two languages."""
    out = personal.anonymised_json(_documents_json(spark, d), "raw", personal.PatternRecogniser(("EMAIL",)), "lang")
    at = lambda path: F.sha2(F.get_json_object("raw", path), 256)
    n = F.when(F.col("found").isNotNull(), F.coalesce(F.try_element_at("found", F.lit("EMAIL")), F.lit(0)))
    return out.select("doc_id", at("$.chosen[0].content").alias("content"), at("$.chosen[0].note").alias("note"), at("$.meta.url").alias("url"), at("$.source.dataset").alias("dataset"), n.alias("n_email"))


@query(rf"""with t as (select source, coalesce(lang in ('en', 'fr'), false) as mine, 2 * len(regexp_extract_all(text, '{_EMAILS}')) as n from documents),
    b as (select source as dataset, mine, n from t union all select 'all', mine, n from t)
    select dataset, 'EMAIL' as entity, cast(sum(n) as bigint) as n, count(*) as n_records from b where mine and n > 0 group by all
    union all select dataset, 'any', cast(coalesce(sum(n) filter (mine), 0) as bigint), count(*) filter (mine and n > 0) from b group by all
    union all select dataset, 'untouched', 0, count(*) from b where not mine group by all""")
def anonymisation_report(spark, d):
    out = personal.anonymised_json(_documents_json(spark, d), "raw", personal.PatternRecogniser(("EMAIL",)), "lang")
    return personal.anonymisation_report(out, "dataset")


@query(rf"""with m as (select doc_id, source, 'text' as field, unnest(regexp_extract_all(text, '{_EMAILS}')) as x from documents union all
      select doc_id, source, 'source', unnest(regexp_extract_all(concat(source, '@example.org'), '{_EMAILS}')) from documents)
    select 'all' as dimension, 'all' as value, count(*) as n, count(distinct doc_id) as n_records from m union all
    select 'field', field, count(*), count(distinct doc_id) from m group by field union all
    select 'dataset', source, count(*), count(distinct doc_id) from m group by source""")
def email_alert_summary(spark, d):
    x = docs(spark, d).select("doc_id", F.col("source").alias("dataset"), "text", F.concat("source", F.lit("@example.org")).alias("source"))
    found = personal.alerts(x, "doc_id", ["text", "source"]).where("type = 'email'").join(x.select("doc_id", "dataset"), "doc_id")
    return personal.alert_summary(found, "doc_id", ("field", "dataset"))
