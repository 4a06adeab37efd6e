"""Personal data: counts and flags in the JVM, alerts with places, anonymisation of columns and of JSON records, reports, re-scan.

Patterns have one meaning everywhere, that of Unicode text: `jvm` gives the form
in which Java's engine reads them as Python's does.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import once

# The ten patterns, in report order.
PATTERNS = {
    "email": r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone_international": r"(?<!\w)(?:\+|00)\d{1,3}(?:[\s().-]*\d{2,4}){2,6}(?!\w)",
    "phone_french": r"(?<!\d)(?:0[1-9])(?:[\s.-]?\d{2}){4}(?!\d)",
    "ip_address": r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",
    "url": r"(?i)\b(?:https?://|www\.)[^\s<>\"]+",
    "date_numeric": r"(?<!\d)(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2})(?!\d)",
    "date_month_year": r"(?i)\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+\d{4}\b",
    "social_security_like": r"(?<!\d)\d{3}[-\s]\d{2}[-\s]\d{4}(?!\d)",
    "us_zip_code": r"(?<!\d)\d{5}(?:-\d{4})?(?!\d)",
    "french_postal_code": r"(?<!\d)(?:0[1-9]|[1-8]\d|9[0-5]|2A|2B)\s?\d{3}(?!\d)",
}
# Tokens that stand for entities.
TOKENS = {"EMAIL": "[EMAIL]", "PHONE": "[PHONE]", "IP": "[IP]", "URL": "[URL]"}
ENTITY_PATTERNS = {"EMAIL": "email", "URL": "url", "IP": "ip_address", "PHONE": "phone_international"}
CONTEXT = 80


def jvm(pattern: str) -> str:
    """The pattern for Java's engine: Unicode classes, and white space with the four separators that they leave out."""
    out, inside, k = [], False, 0
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two == r"\s":
            out.append(r"\s\x1c-\x1f" if inside else r"[\s\x1c-\x1f]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or (inside and two[0] != "]")
            out.append(two[0])
            k -= 1
        k += 2
    return "(?U)" + "".join(out)


#: What every match of a pattern holds, cheap to look for: most texts have none and are left at that. Others hold a digit.
NEEDED = {"email": "@", "url": "(?i)http|www", "phone_international": r"\+|00"}


def _can_hold(text: Column, name: str) -> Column:
    return text.contains("@") if name == "email" else text.rlike(NEEDED.get(name, r"(?U)\d"))


def _of(f: Callable[[Column, str], Column], name: str) -> Callable[[Column], Column]:
    return lambda x: f(x, name)


def counts(text: Column, names: list[str] | None = None) -> dict[str, Column]:
    """Number of matches of each pattern, without leaving the JVM."""
    x = F.coalesce(text, F.lit(""))
    return {n: F.when(_can_hold(x, n), F.regexp_count(x, F.lit(jvm(PATTERNS[n])))).otherwise(0).cast("long") for n in names or PATTERNS}


def flags(text: Column, names: list[str]) -> Column:
    """Names of the patterns that occur."""
    x = F.coalesce(text, F.lit(""))
    found = F.array(*(F.when(_can_hold(x, n) & x.rlike(jvm(PATTERNS[n])), F.lit(n)) for n in names))
    return F.filter(found, lambda x: x.isNotNull())


def alerts(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, type, start, end, match, context): every match of every pattern with its surroundings.

    The engine has no expression that returns the places of all matches, so
    this runs in Arrow batches. Rows without a digit, an at sign or the start of
    an address, one of which every match has, are left out before.
    """
    long = df.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))).alias("x"))
    long = long.select(F.col(key).alias("key"), "x.field", "x.text").where(F.col("text").rlike(r"(?U)[@\d]|(?i:http|www)"))
    patterns = {n: re.compile(p) for n, p in PATTERNS.items()}

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (k, f, n, m.start(), m.end(), m.group(), f"{t[max(0, m.start() - CONTEXT):m.start()]}[PII]{t[m.end():m.end() + CONTEXT]}")
                for k, f, t in zip(b["key"], b["field"], b["text"], strict=True)
                for n, p in patterns.items()
                for m in p.finditer(t)
            ]
            yield pd.DataFrame(rows, columns=["key", "field", "type", "start", "end", "match", "context"])

    kind = long.schema["key"].dataType.simpleString()
    out = long.mapInPandas(scan, f"key {kind}, field string, type string, start long, end long, match string, context string")
    return out.withColumnRenamed("key", key)


def _starred(match: Column, after: Column) -> Column:
    return F.concat(F.repeat(F.lit("*"), F.length(match)), after)


def anonymised(text: Column, strategy: str = "replace", entities: tuple[str, ...] = tuple(ENTITY_PATTERNS)) -> Column:
    """Text with the entities replaced by their token, masked by as many stars, or removed."""

    def without(x: Column, entity: str) -> Column:
        pattern = jvm(PATTERNS[ENTITY_PATTERNS[entity]])
        if strategy == "mask":
            # matches and the text between them, put together with stars of each match's length
            hits = F.regexp_extract_all(x, F.lit(pattern), 0)
            rest = F.split(x, pattern, -1)
            new = F.concat(F.get(rest, F.lit(0)), F.array_join(F.zip_with(hits, F.slice(rest, 2, F.size(hits)), _starred), ""))
        else:
            new = F.regexp_replace(x, pattern, "" if strategy == "redact" else TOKENS[entity].replace("[", r"\["))
        return F.when(_can_hold(x, ENTITY_PATTERNS[entity]), new).otherwise(x)

    out = text
    for e in entities:
        out = once(out, _of(without, e))
    return out


def residual(df: DataFrame, text: Column, entities: tuple[str, ...] = tuple(ENTITY_PATTERNS)) -> DataFrame:
    """(entity, n): matches that are left; all zero after anonymising."""
    n = counts(text, [ENTITY_PATTERNS[e] for e in entities])
    sums = [F.coalesce(F.sum(n[ENTITY_PATTERNS[e]]), F.lit(0)).alias(e) for e in entities]
    return df.agg(*sums).select(F.explode(F.create_map(*(x for e in entities for x in (F.lit(e), F.col(e))))).alias("entity", "n"))


# The patterns of the quick controls.
CONTROL_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone": r"(?<!\d)(?:\+?\d[\d .()-]{7,}\d)(?!\d)",
    "url": r"(?i)https?://\S+|www\.\S+",
    "french_phone": r"(?<!\d)(?:\+33|0)[1-9](?:[\s.-]?\d{2}){4}(?!\d)",
    "date": r"\b(?:0?[1-9]|[12]\d|3[01])[/-](?:0?[1-9]|1[0-2])[/-](?:19|20)\d{2}\b",
}


def control_findings(df: DataFrame, key: str, text: Column, names: tuple[str, ...] = ("email", "phone", "url")) -> DataFrame:
    """(key, type): one row for each control pattern that occurs; text may be a record as JSON."""
    found = F.array(*(F.when(F.coalesce(text, F.lit("")).rlike(jvm(CONTROL_PATTERNS[n])), F.lit(n)) for n in names))
    return df.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("type"))


def first_contexts(df: DataFrame, key: str, text: str, pattern: str = "email", around: int = 150) -> DataFrame:
    """(key, match, context): each match with what surrounds its first occurrence in the text."""
    hits = df.select(key, text, F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(jvm(PATTERNS[pattern])), 0)).alias("match"))
    at = F.instr(F.col(text), F.col("match"))
    start = F.greatest(at - around, F.lit(1))
    return hits.select(key, "match", F.substr(F.col(text), start, at - start + F.length("match") + around).alias("context"))


def anonymised_messages(messages: Column, strategy: str = "replace") -> Column:
    """Contents anonymised, roles kept."""
    return F.transform(messages, lambda m: m.withField("content", anonymised(m["content"], strategy)))


# ---- records as JSON text: a walk over all their strings, whatever their depth

# Paths that hold no text of a person, for scans; and keys and paths that anonymising leaves as they are.
SCAN_EXCLUDED = ("id", "provenance.source_id", "provenance.processing_version")
PROTECTED_KEYS = (
    "id", "original_id", "dataset", "source", "url", "source_license", "source_id", "processing_version", "language", "lang", "task", "type", "quality",
    "dpo_split", "split", "label_type", "preference_valid", "clinically_validated", "clinical_validation_status", "expert_reviewed_labels",
)
PROTECTED_PATHS = ("id", "source", "provenance", "quality")
#: Masked spans have at most so many stars.
MOST_STARS = 1000
#: Findings of recognisers below this score are left.
LEAST_SCORE = 0.35

Leaf = Callable[[str, str], Any]


def walk(value: Any, leaf: Leaf, skip: Callable[[str, str], bool], path: str = "", key: str = "") -> Any:
    """`value` with each string replaced by leaf(path, text); subtrees with skip(path, key) stay. Paths are like a.b[0].c."""
    if path and skip(path, key):
        return value
    if isinstance(value, str):
        return leaf(path, value)
    if isinstance(value, dict):
        return {k: walk(v, leaf, skip, f"{path}.{k}" if path else k, k) for k, v in value.items()}
    if isinstance(value, list):
        return [walk(v, leaf, skip, f"{path}[{k}]", key) for k, v in enumerate(value)]
    return value


def protects(keys: tuple[str, ...] = (), paths: tuple[str, ...] = ()) -> Callable[[str, str], bool]:
    """Whether a key at any depth, or a path or one that it begins with, is protected."""
    held, below = {*keys}, tuple(f"{p}." for p in paths) + tuple(f"{p}[" for p in paths)
    return lambda path, key: key in held or path in paths or path.startswith(below)


def json_texts(df: DataFrame, key: str, raw: str, excluded: tuple[str, ...] = SCAN_EXCLUDED) -> DataFrame:
    """(key, path, text) of every string in JSON records but at excluded paths; text that is no JSON has none."""
    skip = lambda path, _: path in excluded

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for k, text in zip(b[key], b[raw], strict=True):
                walk(_parsed(text), lambda path, t, k=k: rows.append((k, path, t)), skip)
            yield pd.DataFrame(rows, columns=[key, "path", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, raw).mapInPandas(run, f"`{key}` {kind}, path string, text string")


def _parsed(text: str | None) -> Any:
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


class Recogniser(Protocol):
    """Finds entities in a text (a tagger, a service, patterns); loaded once a Python worker."""

    def __call__(self, text: str, language: str | None) -> list[tuple[int, int, str, float]]:
        """(start, end, entity, score) of each finding."""


# Shape of a medical licence number; its last digit checks the others.
LICENCE = r"\b[abcdefghjklmprstuxABCDEFGHJKLMPRSTUX][a-zA-Z9]\d{7}\b"


def licence_holds(number: str) -> bool:
    d = [int(x) for x in number[2:]]
    return (d[0] + d[2] + d[4] + 2 * (d[1] + d[3] + d[5])) % 10 == d[6]


class PatternRecogniser:
    """E-mail, address, phone and licence numbers by pattern, names and places by stated lists; a stand-in for a tagger."""

    def __init__(self, entities: tuple[str, ...] = ("EMAIL", "PHONE", "IP", "URL", "MEDICAL_LICENSE"), persons: tuple[str, ...] = (), places: tuple[str, ...] = ()) -> None:
        self.patterns = [(e, re.compile(PATTERNS[ENTITY_PATTERNS[e]])) for e in entities if e in ENTITY_PATTERNS]
        self.licence = re.compile(LICENCE) if "MEDICAL_LICENSE" in entities else None
        lists = (("PERSON", persons), ("LOCATION", places))
        self.lists = [(e, re.compile(r"(?<!\w)(?:%s)(?!\w)" % "|".join(map(re.escape, sorted(names, key=len, reverse=True))))) for e, names in lists if names]

    def __call__(self, text: str, language: str | None) -> list[tuple[int, int, str, float]]:
        found = [(m.start(), m.end(), e, 0.5) for e, p in self.patterns for m in p.finditer(text)]
        found += [(m.start(), m.end(), e, 0.85) for e, p in self.lists for m in p.finditer(text)]
        if self.licence:
            found += [(m.start(), m.end(), "MEDICAL_LICENSE", 1.0) for m in self.licence.finditer(text) if licence_holds(m.group())]
        return found


def resolved(found: list[tuple[int, int, str, float]], least: float = LEAST_SCORE) -> list[tuple[int, int, str]]:
    """Findings that don't overlap: the longest first, of equals the higher score, then the leftmost."""
    out: list[tuple[int, int, str]] = []
    for s, e, entity, score in sorted(found, key=lambda x: (x[0] - x[1], -x[3], x[0], x[2])):
        if score >= least and s < e and all(e <= a or s >= b for a, b, _ in out):
            out.append((s, e, entity))
    return sorted(out)


def rewritten(text: str, spans: list[tuple[int, int, str]], strategy: str) -> str:
    """Text with each span replaced by its token, masked by stars, or removed (redact)."""
    mark = {"replace": lambda s, e, x: f"[{x}]", "mask": lambda s, e, x: "*" * min(e - s, MOST_STARS), "redact": lambda s, e, x: ""}[strategy]
    out, at = [], 0
    for s, e, x in spans:
        out += [text[at:s], mark(s, e, x)]
        at = e
    return "".join([*out, text[at:]])


def anonymised_json(
    df: DataFrame, raw: str, recogniser: Recogniser, language: str | None = None, languages: tuple[str, ...] = ("en", "fr"),
    strategy: str = "replace", keys: tuple[str, ...] = PROTECTED_KEYS, paths: tuple[str, ...] = PROTECTED_PATHS,
) -> DataFrame:
    """`df` with its JSON records anonymised, and `found`: how often each entity was replaced.

    Protected keys (at any depth) and paths keep their whole subtree. Records in
    another language than the stated ones, or that are no JSON, stay as they are
    and have `found` null.
    """
    skip = protects(keys, paths)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, found = [], []
            tongues = b[language] if language else [None] * len(b)
            for text, tongue in zip(b[raw], tongues, strict=True):
                record = _parsed(text)
                if record is None or (language and tongue not in languages):
                    texts.append(text), found.append(None)
                    continue
                seen: Counter[str] = Counter()

                def leaf(_: str, t: str, tongue=tongue, seen=seen) -> str:
                    spans = resolved(recogniser(t, tongue))
                    seen.update(x for _, _, x in spans)
                    return rewritten(t, spans, strategy)

                new = walk(record, leaf, skip)
                texts.append(json.dumps(new, ensure_ascii=False) if seen else text), found.append(dict(seen))
            yield b.assign(**{raw: texts, "found": found})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, found map<string,bigint>")


def anonymisation_report(df: DataFrame, dataset: str) -> DataFrame:
    """(dataset, entity, n, n_records): replacements of each entity by dataset and in all; entity `any` counts changed
    records, `untouched` those left for their language."""
    row = lambda entity, n, records: F.named_struct(F.lit("entity"), entity, F.lit("n"), n.cast("long"), F.lit("n_records"), records.cast("long"))
    found = F.coalesce("found", F.create_map().cast("map<string,bigint>"))
    total = F.aggregate(F.map_values(found), F.lit(0).cast("long"), lambda s, x: s + x)
    rows = F.concat(
        F.transform(F.map_entries(found), lambda e: row(e["key"], e["value"], F.lit(1))), F.array(row(F.lit("any"), total, total > 0)),
        F.when(F.col("found").isNull(), F.array(row(F.lit("untouched"), F.lit(0), F.lit(1)))).otherwise(F.array().cast("array<struct<entity:string,n:bigint,n_records:bigint>>")),
    )
    each = df.select(F.explode(F.array(F.col(dataset), F.lit("all"))).alias("dataset"), rows.alias("rows")).select("dataset", F.explode("rows").alias("x"))
    return each.groupBy("dataset", "x.entity").agg(F.sum("x.n").alias("n"), F.sum("x.n_records").alias("n_records"))


def alert_summary(found: DataFrame, key: str, by: tuple[str, ...]) -> DataFrame:
    """(dimension, value, n, n_records) of alerts over all and by each of some columns (type, field, dataset), most first."""
    sides = [("all", F.lit("all")), *((c, F.col(c).cast("string")) for c in by)]
    long = found.select(key, F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in sides))).alias("x"))
    counted = long.groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_records"))
    return counted.orderBy("dimension", F.desc("n"), "value")
