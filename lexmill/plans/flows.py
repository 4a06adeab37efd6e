"""Whole flows as plans: an instruction corpus, preference data, and an evaluation.

Each is one lineage of operators with checkpoints where later gates would
otherwise compute everything again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import scores as S
from lexmill.functions import text as T
from lexmill.operators import dedup, evaluation, leakage, personal, sampling, validate
from lexmill.session import cut

LABELS = ("easy", "hard", "length")


@dataclass
class Corpus:
    splits: DataFrame
    conformance: DataFrame
    overlaps: DataFrame
    residual: DataFrame
    fingerprints: DataFrame


def instruction_corpus(parts: dict[str, DataFrame], sizes: dict[str, int], seed: int = 42, split_seed: int = 3407) -> Corpus:
    """From records (id, ord, instruction, response, language, task) by source: keep-first deduplication in each
    source and over all, a sample of each, anonymised text, an 80/10/10 split by source, language and task."""
    picked = {}
    for name, df in parts.items():
        kept = dedup.keep_first(df, T.pair_hash("instruction", "response"), "ord")
        picked[name] = sampling.sample(kept, "id", sizes[name], seed)
    place = {name: k for k, name in enumerate(parts)}  # the order in which the sources are merged
    merged = evaluation.union_tagged({n: x.withColumn("ord", F.struct(F.lit(place[n]).alias("part"), F.col("ord").alias("ord"))) for n, x in picked.items()}, "dataset")
    unique = dedup.keep_first(merged, T.pair_hash("instruction", "response"), "ord").drop("ord")
    clean = cut(unique.withColumns({c: personal.anonymised(F.col(c)) for c in ("instruction", "response")}))
    strata = ["dataset", "language", "task"]
    split = sampling.require_complete(clean, cut(sampling.stratified_split(clean, strata, "id", split_seed)), "id")
    return Corpus(
        split, sampling.split_conformance(split, strata), leakage.overlap_matrix(split, F.col("split"), T.pair_hash("instruction", "response")),
        personal.residual(split, F.concat_ws("\n", "instruction", "response")), sampling.fingerprint(split, "split", "id"),
    )


@dataclass
class Preferences:
    rows: DataFrame
    reasons: DataFrame


def preference_data(raw: DataFrame, known_prompts: DataFrame, benchmark_prompts: DataFrame, train: int, validation: int, seed: int = 42) -> Preferences:
    """From raw preference rows with a unique `ord`: each row is dropped for the first reason that applies (invalid,
    label, leakage, incoherence, repeats); of the rest the best-scored pairs by label, with disjoint prompts."""
    df = raw.withColumns(
        {
            "c": T.first_content("chosen", "assistant"), "r": T.first_content("rejected", "assistant"),
            "cm": F.col("metadata.chosen"), "rm": F.col("metadata.rejected"), "key": T.comparison_key("prompt"),
        }
    )
    df = leakage.leak_flag(df, F.col("key"), known_prompts, T.comparison_key("prompt"), "known")
    df = leakage.leak_flag(df, F.col("key"), benchmark_prompts, T.comparison_key("prompt"), "benchmark")
    valid = validate.filled("prompt") & T.is_conversation("chosen") & T.is_conversation("rejected") & (F.col("c") != F.col("r"))
    first = validate.drop_reason(
        {
            "invalid": ~F.coalesce(valid, F.lit(False)), "invalid_label": ~F.coalesce(F.col("label_type").isin(*LABELS), F.lit(False)),
            "sft_leakage": F.col("known"), "benchmark_leakage": F.col("benchmark"),
            "incoherent_preference": ~S.is_coherent(F.col("cm"), F.col("rm"), F.col("feedback")),
        }
    )
    pair = T.joined_hash("prompt", "c", "r")
    df = cut(df.withColumns({"reason": first, "id": T.first_filled("prompt_id", T.joined_hash("prompt_id", "prompt", "c", "r")), "pair": pair}))
    alive = dedup.duplicate_reasons(df.where("reason = 'usable'"), F.col("id"), F.col("pair"), "ord")
    alive = cut(alive.withColumn("reason", F.coalesce("duplicate_reason", "reason")).drop("duplicate_reason"))
    reasons = df.where("reason <> 'usable'").select("reason").union(alive.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    usable = alive.where("reason = 'usable'").withColumn("score", S.selection_score(F.col("cm"), F.col("rm"), F.col("feedback")))
    rows = sampling.group_split(usable, F.col("key"), "id", "label_type", "score", validation, train, seed)
    return Preferences(rows.select("id", T.storage_form("prompt").alias("prompt"), "chosen", "rejected", "label_type", "split"), reasons)


def evaluated(predictions: DataFrame, form: str = "punctuation") -> tuple[DataFrame, DataFrame]:
    """From (id, prediction, reference, language, task): scores of each row, and means over all and by language and task."""
    scored = evaluation.token_f1(predictions, "id", "prediction", "reference", form, "language", "task")
    return scored, evaluation.grouped_means(scored, ["f1", "exact_match"], ["language", "task"])
