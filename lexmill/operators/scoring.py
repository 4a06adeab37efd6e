"""Scorers and generators that live outside the engine (models, services), with reproducible stand-ins."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Scorer(Protocol):
    """Scores a batch of prompts and answers; loaded once a Python worker."""

    def __call__(self, prompts: pd.Series, answers: pd.Series) -> pd.Series: ...


class HashScorer:
    """A reproducible number between -2 and 0 for each prompt and answer."""

    def __call__(self, prompts: pd.Series, answers: pd.Series) -> pd.Series:
        digest = lambda p, a: int.from_bytes(hashlib.sha256(f"{p}\n{a}".encode()).digest()[:6], "big")
        return pd.Series([-2 * digest(p, a) / 2**48 for p, a in zip(prompts, answers, strict=True)], dtype="float64")


class Generator(Protocol):
    """Writes a text for each prompt of a batch (a model, a judge); loaded once a Python worker."""

    def __call__(self, prompts: pd.Series) -> pd.Series: ...


class EchoGenerator:
    """A reproducible stand-in: the prompt's last line, or with `choices` one of them by the prompt's hash."""

    def __init__(self, choices: tuple[str, ...] = ()) -> None:
        self.choices = choices

    def __call__(self, prompts: pd.Series) -> pd.Series:
        digest = lambda p: int(hashlib.sha256(p.encode()).hexdigest()[:8], 16)
        if self.choices:
            return prompts.fillna("").map(lambda p: self.choices[digest(p) % len(self.choices)])
        return prompts.fillna("").map(lambda p: p.rsplit("\n", 1)[-1])


def generated(df: DataFrame, generator: Generator, prompt: str, name: str = "prediction") -> DataFrame:
    """`df` with the generator's text for each row's prompt, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{name: generator(b[prompt])})

    return df.mapInPandas(run, StructType(df.schema.fields[:]).add(name, "string"))


def positions(df: DataFrame, key: str, chosen: str, rejected: str, seed: int = 42) -> DataFrame:
    """`df` with answer_a, answer_b and expected: which of A and B is the chosen answer, by a bit of the hash of seed and id."""
    first = F.substring(F.sha2(F.concat_ws("_", F.lit(str(seed)), F.col(key).cast("string")), 256), 1, 1) < "8"
    return df.withColumns({
        "answer_a": F.when(first, F.col(chosen)).otherwise(F.col(rejected)), "answer_b": F.when(first, F.col(rejected)).otherwise(F.col(chosen)),
        "expected": F.when(first, "A").otherwise("B"),
    })


def scored_pairs(df: DataFrame, scorer: Scorer, prompt: str, chosen: str, rejected: str) -> DataFrame:
    """`df` with chosen_score and rejected_score, both sides in one pass over the rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(chosen_score=scorer(b[prompt], b[chosen]), rejected_score=scorer(b[prompt], b[rejected]))

    return df.mapInPandas(run, StructType(df.schema.fields[:]).add("chosen_score", "double").add("rejected_score", "double"))


def scored(df: DataFrame, scorer: Scorer, prompt: str, answer: str, name: str = "score") -> DataFrame:
    """`df` with the scorer's number for each row, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{name: scorer(b[prompt], b[answer])})

    return df.mapInPandas(run, StructType(df.schema.fields[:]).add(name, "double"))
