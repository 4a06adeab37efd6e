"""Validation: rules become error rows, or the first reason a row is dropped for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import LETTERS, clean, first_content, is_conversation


def errors(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule): one row for each rule that a row breaks. A rule that is null counts as broken."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return df.select(key, F.explode(broken).alias("rule"))


def drop_reason(reasons: dict[str, Column]) -> Column:
    """The first reason that applies, in the order given, else usable."""
    out = None
    for name, bad in reasons.items():
        bad = F.coalesce(bad, F.lit(False))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out.otherwise("usable")


def missing_keys(raw: Column, required: list[str]) -> Column:
    """Required top-level keys that a JSON object lacks; all of them if it isn't one."""
    have = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    return F.array_except(F.array(*map(F.lit, required)), have)


def filled(x: Column | str) -> Column:
    return clean(F.col(x) if isinstance(x, str) else x) != ""


def repeated_ids(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows after the first of their id."""
    first = df.groupBy(key).agg(F.min(order).alias("__first"))
    return df.join(first, key).where(F.col(order) > F.col("__first")).drop("__first")


def mcq_rules(choices: Column, answers: Column) -> dict[str, Column]:
    """Structure of a multiple-choice record."""
    names = F.array(*map(F.lit, LETTERS))
    return {
        "choices_keys": F.array_sort(F.map_keys(choices)) == names,
        **{f"choice_{k}_blank": clean(F.try_element_at(choices, F.lit(k))) != "" for k in LETTERS},
        "answers_empty": F.size(answers) > 0,
        "answers_unknown": F.size(F.array_except(answers, names)) == 0,
        "answers_blank": F.forall(answers, lambda k: clean(F.try_element_at(choices, k)) != ""),
    }


def source_language_rule(source: Column, language: Column, expected: dict[str, str]) -> Column:
    """Sources with a stated language have it; others pass."""
    out = F.lit(True)
    for name, lang in expected.items():
        out = out & ((source != name) | (language == lang))
    return out


def expectations(actual: DataFrame, name: str, expected: dict[str, int]) -> DataFrame:
    """(name, expected, actual) where counts differ from, or lack in, the expected ones."""
    want = actual.sparkSession.createDataFrame(list(expected.items()), f"{name} string, expected long")
    both = want.join(actual.select(name, F.col("n").alias("actual")), name, "full").na.fill(0)
    return both.where("expected <> actual")


def changed_fields(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field) of protected fields that differ, or whole rows that one side lacks (field `row`)."""
    a, b = before.select(key, F.struct(*fields).alias("a")), after.select(key, F.struct(*fields).alias("b"))
    both = a.join(b, key, "full")
    changed = F.filter(
        F.array(
            F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit("row")),
            *(F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields),
        ),
        lambda x: x.isNotNull(),
    )
    return both.select(key, F.explode(changed).alias("field"))


def quality_rules(confidence: Column, validated: Column) -> dict[str, Column]:
    """Confidence missing or between 0 and 1, validated stated."""
    return {"confidence_range": confidence.isNull() | confidence.between(0, 1), "validated_stated": validated.isNotNull()}


def kind_rules(raw: Column, kinds: dict[str, str]) -> dict[str, Column]:
    """The JSON value at each top-level key has the stated kind (as in STRING, BOOLEAN, ARRAY, OBJECT); absent fails."""
    value = F.try_parse_json(raw)
    out = {}
    for name, kind in kinds.items():
        found = F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
        out[f"{name}_is_{kind.lower()}"] = F.coalesce(found.startswith(kind), F.lit(False))
    return out


def training_rules(messages: Column, roles: tuple[str, ...] = ("user", "assistant", "system")) -> dict[str, Column]:
    """A conversation that can be trained on."""
    return {
        "messages_missing": F.coalesce(F.size(messages), F.lit(0)) > 0,
        "role_unknown": F.forall(messages, lambda m: m["role"].isin(*roles)),
        "content_blank": F.forall(messages, lambda m: clean(m["content"]) != ""),
    }


def preference_rules(prompt: Column, chosen: Column, rejected: Column, exact: bool = False) -> dict[str, Column]:
    """A prompt and two complete answers that differ: beyond white space, or exactly as they are."""
    differ = chosen != rejected if exact else clean(chosen) != clean(rejected)
    return {"prompt_blank": clean(prompt) != "", "chosen_blank": clean(chosen) != "", "rejected_blank": clean(rejected) != "", "equal_answers": differ}


def conversation_preference_rules(prompt: Column, chosen: Column, rejected: Column) -> dict[str, Column]:
    """As preference_rules for two conversations: both valid, and the first assistant messages exactly different."""
    rules = preference_rules(prompt, first_content(chosen, "assistant"), first_content(rejected, "assistant"), exact=True)
    return {**rules, "chosen_invalid": is_conversation(chosen), "rejected_invalid": is_conversation(rejected)}


# ---- rules for records as JSON text; paths are dotted keys

# What an instruction record must hold, and the values allowed.
SFT_KEYS = {
    "": ("id", "instruction", "response", "language", "task", "source", "clinical_context", "source_specific", "quality", "provenance"),
    "source": ("dataset", "original_id"),
    "clinical_context": ("clinical_case", "symptoms", "history", "vitals", "diagnosis", "medications", "allergies"),
    "source_specific": ("question_type", "question_focus", "synonyms", "umls_cui", "choices", "correct_answers"),
    "quality": ("confidence", "validated"),
    "provenance": ("source_license", "processing_version"),
}
SFT_ALLOWED = {
    "language": ("fr", "en"),
    "task": ("medical_qa", "medical_mcq", "clinical_reasoning"),
    "source.dataset": ("MedQuAD", "FrenchMedMCQA", "MediQAl"),
}
SFT_LISTS = ("symptoms", "history", "vitals", "medications", "allergies")
# Keys that each source's own part must hold in the control of shapes.
SHAPE_COMMON = ("choices", "correct_answers")
SHAPE_SOURCES = {
    "MedQuAD": ("question_type", "question_focus", "synonyms", "umls_cui", "semantic_types", "semantic_group", "choices", "correct_answers"),
    "FrenchMedMCQA": (),
    "MediQAl": (),
}
# Labels and states of preference records.
PREFERENCE_LABELS = ("easy", "hard", "length")
PREFERENCE_DATASET, PREFERENCE_STATUS = "UltraMedical-Preference", "pending"


class Json:
    """What a column of JSON texts holds at dotted paths; all answers are true or false, never null."""

    def __init__(self, raw: Column) -> None:
        self.raw, self.value = raw, F.try_parse_json(raw)

    def at(self, path: str, kind: str = "variant") -> Column:
        return F.try_variant_get(self.value, f"$.{path}" if path else "$", kind)

    def kind(self, path: str, *kinds: str) -> Column:
        """Whether the value there has one of the kinds (OBJECT, ARRAY, STRING, BOOLEAN, BIGINT, VOID for null, ...)."""
        found = F.schema_of_variant(self.at(path))
        return F.coalesce(F.array_contains(F.array(*map(F.lit, kinds)), F.regexp_extract(found, "^[A-Z]+", 0)), F.lit(False))

    def has(self, path: str) -> Column:
        return self.at(path).isNotNull()

    def keys(self, path: str, wanted: tuple[str, ...]) -> Column:
        text = F.get_json_object(self.raw, f"$.{path}") if path else self.raw
        return F.size(missing_keys(text, [*wanted])) == 0

    def string(self, path: str) -> Column:
        """A string with more than white space."""
        return self.kind(path, "STRING") & F.coalesce(clean(self.at(path, "string")) != "", F.lit(False))

    def one_of(self, path: str, values: tuple[str, ...]) -> Column:
        return self.kind(path, "STRING") & F.coalesce(self.at(path, "string").isin(*values), F.lit(False))

    def strings(self, path: str) -> Column:
        """An array of nothing but strings."""
        return F.coalesce(F.forall(self.at(path, "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING"), F.lit(False))

    def string_values(self, path: str) -> Column:
        return F.coalesce(F.forall(F.map_values(self.at(path, "map<string,variant>")), lambda x: F.schema_of_variant(x) == "STRING"), F.lit(False))


NUMBERS = ("TINYINT", "SMALLINT", "INT", "BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN")


def sft_rules(raw: Column) -> dict[str, Column]:
    """Every rule of an instruction record (JSON); only what isn't an object at all breaks a single rule."""
    j = Json(raw)
    record = j.kind("", "OBJECT")
    rules: dict[str, Column] = {"record_object": record}
    later: dict[str, Column] = {"top_keys": j.keys("", SFT_KEYS[""])}
    for name in ("id", "instruction", "response"):
        later[f"{name}_blank"] = j.string(name)
    for name in ("language", "task"):
        later[f"{name}_allowed"] = j.one_of(name, SFT_ALLOWED[name])
    for part in ("source", "clinical_context", "source_specific", "quality", "provenance"):
        whole = j.kind(part, "OBJECT")
        later[f"{part}_object"] = whole
        later[f"{part}_keys"] = ~whole | j.keys(part, SFT_KEYS[part])
    inside = lambda part, ok: ~j.kind(part, "OBJECT") | ok
    later["dataset_allowed"] = inside("source", j.one_of("source.dataset", SFT_ALLOWED["source.dataset"]))
    later["original_id_blank"] = inside("source", j.string("source.original_id"))
    for name in SFT_LISTS:
        path = f"clinical_context.{name}"
        later[f"{name}_strings"] = inside("clinical_context", ~j.has(path) | j.strings(path))
    own, dataset = "source_specific", j.at("source.dataset", "string")
    later["synonyms_strings"] = inside(own, ~j.has(f"{own}.synonyms") | j.strings(f"{own}.synonyms"))
    later["choices_object"] = inside(own, j.kind(f"{own}.choices", "OBJECT"))
    later["choices_strings"] = inside(own, ~j.kind(f"{own}.choices", "OBJECT") | j.string_values(f"{own}.choices"))
    later["correct_answers_strings"] = inside(own, j.strings(f"{own}.correct_answers"))
    of = lambda *names: F.coalesce(dataset.isin(*names), F.lit(False))
    later["semantic_types_strings"] = inside(own, ~of("MedQuAD") | ~j.has(f"{own}.semantic_types") | j.strings(f"{own}.semantic_types"))
    optional = lambda path: ~j.has(path) | j.kind(path, "VOID", "STRING")
    later["semantic_group_string"] = inside(own, ~of("MedQuAD") | optional(f"{own}.semantic_group"))
    later["medical_subject_string"] = inside(own, ~of("FrenchMedMCQA", "MediQAl") | optional(f"{own}.medical_subject"))
    later["confidence_number"] = inside("quality", ~j.has("quality.confidence") | j.kind("quality.confidence", "VOID", *NUMBERS))
    later["validated_boolean"] = inside("quality", j.kind("quality.validated", "BOOLEAN"))
    later["processing_version_blank"] = inside("provenance", j.string("provenance.processing_version"))
    return rules | {name: ~record | ok for name, ok in later.items()}


def shape_rules(raw: Column) -> dict[str, Column]:
    """Shapes of clinical context, the source's own part and provenance of an instruction record (JSON)."""
    j = Json(raw)
    out = {}
    for part, wanted in (("clinical_context", SFT_KEYS["clinical_context"]), ("source_specific", SHAPE_COMMON), ("provenance", SFT_KEYS["provenance"])):
        whole = j.kind(part, "OBJECT")
        out[f"{part}_object"], out[f"{part}_keys"] = whole, ~whole | j.keys(part, wanted)
    for name in SFT_LISTS:
        path = f"clinical_context.{name}"
        out[f"{name}_array"] = ~j.kind("clinical_context", "OBJECT") | ~j.has(path) | j.kind(path, "ARRAY")
    dataset, whole = j.at("source.dataset", "string"), j.kind("source_specific", "OBJECT")
    out["source_known"] = ~whole | F.coalesce(dataset.isin(*SHAPE_SOURCES), F.lit(False))
    for name, wanted in SHAPE_SOURCES.items():
        if wanted:
            out[f"{name}_keys"] = ~whole | ~F.coalesce(dataset == name, F.lit(False)) | j.keys("source_specific", wanted)
    return out


def preference_metadata_rules(raw: Column, split: str) -> dict[str, Column]:
    """Source and state of a preference record (JSON) of a split; records without a source object are left to other rules."""
    j = Json(raw)
    source = j.kind("source", "OBJECT")
    validated = j.kind("quality.clinically_validated", "BOOLEAN") & ~F.coalesce(j.at("quality.clinically_validated", "boolean"), F.lit(True))
    rules = {
        "dataset": j.one_of("source.dataset", (PREFERENCE_DATASET,)), "split": j.one_of("source.split", (split,)),
        "label_type": j.one_of("source.label_type", PREFERENCE_LABELS), "clinically_validated": validated,
        "clinical_validation_status": j.one_of("quality.clinical_validation_status", (PREFERENCE_STATUS,)),
    }
    return {name: ~source | ok for name, ok in rules.items()}


def require_valid(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """`df`; the query fails at the first row that breaks a rule, and names it."""
    broken = drop_reason({name: ~F.coalesce(ok, F.lit(False)) for name, ok in rules.items()})
    message = F.concat(F.lit("row "), F.col(key).cast("string"), F.lit(": "), broken)
    return df.withColumn(key, F.when(broken == "usable", F.col(key)).otherwise(F.raise_error(message)))


def require_schema(df: DataFrame, ddl: str) -> DataFrame:
    """`df`, or an error if its names or types differ from the stated ones."""
    want = df.sparkSession.createDataFrame([], ddl).schema
    plain = lambda s: sorted((f.name, f.dataType.simpleString()) for f in s.fields)
    if plain(df.schema) != plain(want):
        raise ValueError(f"schema {plain(df.schema)} instead of {plain(want)}")
    return df
