"""Column functions: normalisers, keys, renderers and parsers of text. All run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, with the four separators that Java's class leaves out.
WS = r"(?U)[\s\x1c-\x1f]+"
# ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Language markers, looked for between spaces.
FRENCH_MARKERS = (
    "le", "la", "les", "des", "une", "un", "avec", "pour", "dans", "est", "sont", "patient", "symptômes", "médecin", "traitement", "maladie",
)
ENGLISH_MARKERS = ("the", "a", "an", "with", "for", "in", "is", "are", "patient", "symptoms", "doctor", "treatment", "disease")
# Answer letters.
LETTERS = ("A", "B", "C", "D", "E")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def strip(x: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col(x), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def clean(x: Column | str) -> Column:
    """Runs of white space become one space, ends are trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(col(x), F.lit("")), WS, " "))


def folded(x: Column | str) -> Column:
    """Stripped and in lower case; inner white space stays."""
    return F.lower(strip(F.coalesce(col(x), F.lit(""))))


def comparison_key(x: Column | str) -> Column:
    """Key for comparing texts: lower case, white space collapsed."""
    return F.lower(clean(x))


def storage_form(x: Column | str) -> Column:
    """Form for storing: line ends unified, blanks collapsed, at most one empty line, case kept."""
    y = F.regexp_replace(F.coalesce(col(x), F.lit("")), "\r\n?", "\n")
    y = F.regexp_replace(F.regexp_replace(y, "[ \t]+", " "), "\n{3,}", "\n\n")
    return strip(y)


def metric_form(x: Column | str, form: str) -> Column:
    """Normal forms of the metrics: `words` drops non-word characters after collapsing,
    `punctuation` deletes ASCII punctuation before it, `plain` keeps punctuation."""
    low = F.lower(F.coalesce(col(x), F.lit("")))
    if form == "words":
        return strip(F.regexp_replace(F.regexp_replace(low, WS, " "), r"(?U)[^\w\s]", ""))
    if form == "punctuation":
        return clean(F.translate(low, PUNCTUATION, ""))
    if form == "plain":
        return clean(low)
    raise ValueError(form)


def tokens(x: Column) -> Column:
    """Words of a normalised text; none of an empty one."""
    return F.filter(F.split(x, r"\s+"), lambda t: t != "")


def stable_id(*parts: Column | str) -> Column:
    """16 hex digits that name a record by its source and its id there."""
    return F.substring(F.sha1(F.concat_ws(":", *(F.coalesce(col(p).cast("string"), F.lit("")) for p in parts))), 1, 16)


def joined_hash(*parts: Column | str, form=storage_form) -> Column:
    """40 hex digits of the parts' normal forms, one a line; null counts as empty."""
    return F.sha1(F.concat_ws("\n", *(form(col(p).cast("string")) for p in parts)))


def pair_hash(question: Column | str, answer: Column | str) -> Column:
    """64 hex digits of a question and answer, without case and outer white space."""
    return F.sha2(F.concat_ws("\n", folded(question), folded(answer)), 256)


def record_hash(*fields: str) -> Column:
    """64 hex digits of a whole record as canonical JSON: fields by name, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)


def seeded(seed: int, x: Column | str) -> Column:
    """A reproducible order: hex digits of seed and id."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), col(x).cast("string")), 256)


def as_list(x: Column | str) -> Column:
    """A comma-separated string as its trimmed non-empty parts; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(col(x), F.lit("")), ","), lambda v: clean(v)), lambda v: v != "")


def cleaned_list(x: Column | str) -> Column:
    """The elements of an array as cleaned non-empty strings; null gives none."""
    parts = F.transform(F.coalesce(col(x), F.array().cast("array<string>")), lambda v: clean(v.cast("string")))
    return F.filter(parts, lambda v: v != "")


def marker_language(x: Column | str) -> Column:
    """fr if more French than English markers occur between spaces, else en."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(col(x), F.lit(""))), F.lit(" "))

    def hits(markers: tuple[str, ...]) -> Column:
        total = F.lit(0)
        for m in markers:
            total = total + F.contains(padded, F.lit(f" {m} ")).cast("int")
        return total

    return F.when(hits(FRENCH_MARKERS) > hits(ENGLISH_MARKERS), "fr").otherwise("en")


# ---- multiple choice


def option_lines(choices: Column | str) -> Column:
    """`L. text` for each letter whose choice isn't blank; choices is a map."""
    pick = lambda k: F.concat(k, F.lit(". "), clean(F.try_element_at(col(choices), k)))
    return F.transform(F.filter(F.array(*map(F.lit, LETTERS)), lambda k: clean(F.try_element_at(col(choices), k)) != ""), pick)


def mcq_instruction(question: Column | str, choices: Column | str) -> Column:
    return F.concat_ws("\n", clean(question), F.lit(""), F.lit("Options:"), option_lines(choices))


def mcq_response(choices: Column | str, answers: Column | str) -> Column:
    """The stated answers, with the texts of those that are options."""
    named = F.transform(
        col(answers),
        lambda k: F.when(clean(F.try_element_at(col(choices), k)) != "", F.concat(k, F.lit(". "), clean(F.try_element_at(col(choices), k)))).otherwise(k),
    )
    return (
        F.when(F.coalesce(F.size(answers), F.lit(0)) == 0, "Réponse correcte non renseignée.")
        .when(F.size(answers) == 1, F.concat(F.lit("Réponse correcte : "), F.get(named, F.lit(0))))
        .otherwise(F.concat(F.lit("Réponses correctes :\n"), F.array_join(named, "\n")))
    )


def letters(x: Column) -> Column:
    """Sorted distinct valid answer letters of an array."""
    up = F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda v: F.upper(strip(v)))
    return F.array_sort(F.array_distinct(F.filter(up, lambda v: v.isin(*LETTERS))))


def parsed_answers(x: Column | str) -> Column:
    """Answer letters of a free text: in its answer section, letters at line starts, else inline ones."""
    text = F.coalesce(col(x), F.lit(""))
    french = F.regexp_extract(text, r"(?is)réponses?\s+correctes?\s*:(.*)", 1)
    english = F.regexp_extract(text, r"(?is)correct\s+answers?\s*:(.*)", 1)
    part = F.when(french != "", french).when(english != "", english).otherwise(text)
    lines = F.regexp_extract_all(part, F.lit(r"(?im)^\s*([A-E])\s*[.):\-]"), 1)
    inline = F.regexp_extract_all(part, F.lit(r"(?i)\b([A-E])[.):\-]"), 1)
    return letters(F.when(F.size(lines) > 0, lines).otherwise(inline))


def parsed_choice(x: Column | str) -> Column:
    """A or B if a free text names just one of them, else null."""
    y = F.upper(F.coalesce(col(x), F.lit("")))
    for word in ("YOUR CHOICE", "ANSWER", "CHOICE", "OR"):
        y = F.regexp_replace(y, word, "")
    y = F.regexp_replace(y, r"(?U)[:<,.\s]|\\N", "")
    return F.when(y.isin("A", "B"), y)


# ---- conversations: arrays of (role, content)


def valid_messages(messages: Column | str) -> Column:
    """Messages that have a role and a content."""
    full = lambda m: (clean(m["role"]) != "") & (clean(m["content"]) != "")
    return F.filter(F.coalesce(col(messages), F.array().cast("array<struct<role:string,content:string>>")), full)


def first_content(messages: Column | str, role: str) -> Column:
    return F.get(F.filter(col(messages), lambda m: m["role"] == role), F.lit(0))["content"]


def last_content(messages: Column | str) -> Column:
    return F.try_element_at(col(messages), F.lit(-1))["content"]


def conversation_text(messages: Column | str, sep: str = ": ") -> Column:
    return F.array_join(F.transform(col(messages), lambda m: F.concat(m["role"], F.lit(sep), m["content"])), "\n")


def conversation_key(messages: Column | str) -> Column:
    """For comparing conversations: comparison keys of role and content, messages with either, one a line."""
    keys = F.transform(col(messages), lambda m: F.struct(comparison_key(m["role"]).alias("r"), comparison_key(m["content"]).alias("c")))
    kept = F.filter(keys, lambda m: (m["r"] != "") | (m["c"] != ""))
    return F.coalesce(F.array_join(F.transform(kept, lambda m: F.concat(m["r"], F.lit(":"), m["c"])), "\n"), F.lit(""))


def chat_template(messages: Column | str) -> Column:
    return F.array_join(F.transform(col(messages), lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("\n"))), "")


def is_conversation(messages: Column | str, strict: bool = False) -> Column:
    """Strict: not empty and every message complete. Else: two complete messages with a user and an assistant."""
    m = col(messages)
    if strict:
        return (F.coalesce(F.size(m), F.lit(0)) > 0) & F.forall(m, lambda x: (clean(x["role"]) != "") & (clean(x["content"]) != ""))
    good = valid_messages(m)
    return (F.size(good) >= 2) & F.exists(good, lambda x: x["role"] == "user") & F.exists(good, lambda x: x["role"] == "assistant")


# ---- values and renderers


def safe_number(x: Column | str, kind: str) -> Column:
    """The value as a number of that kind, or null where it isn't one."""
    return col(x).try_cast(kind)


def first_filled(*values: Column | str) -> Column:
    """The first value that is neither null nor an empty string."""
    return F.coalesce(*(F.nullif(col(v).cast("string"), F.lit("")) for v in values))


def first_string(raw: Column | str, *keys: str) -> Column:
    """The value of the first top-level key that holds a string, be it empty; an empty string if none does."""
    value = F.try_parse_json(col(raw))
    at = lambda k: F.when(F.schema_of_variant(F.try_variant_get(value, f"$.{k}", "variant")) == "STRING", F.try_variant_get(value, f"$.{k}", "string"))
    return F.coalesce(*map(at, keys), F.lit(""))


def json_paths(raw: Column | str, *paths: str) -> Column:
    """The first filled value at one of several paths of a JSON text, e.g. source.dataset, then dataset."""
    return first_filled(*(F.get_json_object(col(raw), f"$.{p}") for p in paths))


def prefixed_id(prefix: str, *fields: str) -> Column:
    """An id of a record's canonical JSON: prefix and 16 hex digits."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})), 1, 16))


def question_prompt(question: Column | str, system: str = "", answer: Column | str | None = None) -> Column:
    """System text, question and, for training, the answer, in labelled paragraphs."""
    parts = [F.lit(system)] if system else []
    parts.append(F.concat(F.lit("Question:\n"), clean(question)))
    parts.append(F.concat(F.lit("Answer:\n"), clean(answer)) if answer is not None else F.lit("Answer:\n"))
    return F.concat_ws("\n\n", *parts)


def checkpoint_number(path: Column | str) -> Column:
    """The number at the end of a checkpoint's name, for ordering."""
    return F.regexp_extract(col(path), r"(\d+)/?$", 1).try_cast("long")
