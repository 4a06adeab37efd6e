"""Corpus preparation in five stages, from documents to token ids.

Each stage takes (spark, docs, sf_dir), works on all rows of `docs` and returns
a DataFrame; all but the last return the columns of `documents`. Rows are taken
out by anti-joins on the rows a stage decides against, so clean documents pass
untouched. Language, near copies and contamination are decided row by row: where
an id occurs more than once, its rows get keys of their own for the stage. Null
texts have no language and go in the first stage; an empty table stays empty;
rows without an id are kept and not compared. What a stage wrote is removed once
the next one is written; the folder of the last but one stage is what the
result is read from, and stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import decontaminate, language_id, line_dedup, ngram_join, sentencepieces
from lexmill.llm.common import cut, table
from lexmill.llm.queries import tokenizer_path
from lexmill.session import dealt, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with `row`: the id while no id repeats, else a written number in the ids' order; null for rows without an id."""
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not repeated:
        return docs.select(*COLUMNS, F.col("doc_id").alias("row"))
    # the second column deals the rows of a frequent id over several ranges
    placed = docs.withColumn("place", F.monotonically_increasing_id()).orderBy("doc_id", "place")
    return cut(placed.select(*COLUMNS, F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id()).alias("row")))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of keyed docs whose `row` is not listed."""
    return docs.join(gone.select("row").distinct(), "row", "left_anti").select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have no letter, or look like none of the languages, go."""
    docs = keyed(docs)
    found = language_id.identify(docs, "row", "text", declared=F.col("lang"), host=F.col("source"))
    return without(docs, found.where("rejected"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, or are within an edit of one, go; so do documents of which nothing is left."""
    left = line_dedup.dedup_lines(docs.select(*COLUMNS))
    left = left.where((F.col("n_lines_removed") == 0) | F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the smallest id stays."""
    docs = keyed(docs)
    found = ngram_join.near_duplicates(docs.where("row is not null"), n=5, num=80, den=100, key="row")
    return without(docs, found.where("component_id <> row"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    docs = keyed(docs)
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), key="row")
    return without(docs, found.where(F.size("spans") > 0))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, decoded text, their number and digests, of each remaining document."""
    return sentencepieces.encode_texts(docs, tokenizer_path(), whole=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: Edit distances, components and token ids are beyond SQL; the tests hold it against brute force.
ORACLE_SQL = None


def removed(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    base, path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    docs = dealt(table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        before, path = path, f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            removed(spark, before)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
