"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import decontaminate, language_id, line_dedup, lm_score, ngram_join, pii, sentencepieces, suffix_dedup, token_counts, topk
from lexmill.llm.common import table
from lexmill.session import dealt

PIECES = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096


def tokenizer_path(name: str = PIECES) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "documents"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id", "n_lines", "n_lines_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_texts(documents(spark, sf_dir), tokenizer_path(), whole=False)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir), n=3, num=90, den=100)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination_digest(found)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.token_counts(documents(spark, sf_dir), tokenizer_path(), TOKEN_LIMIT)
    return found.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), whole=False)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    found = language_id.identify(docs, "doc_id", "text", declared=F.col("lang"), host=F.col("source"))
    return found.select("doc_id", "language", "confidence", "text_language", "declared_language", "rejected")


def pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over raw web pages: markup, address and host are evidence."""
    pages = dealt(table(spark, sf_dir, "pages")).select("page_id", "url", F.col("html"), language_id.page_text(F.col("html")).alias("text"))
    pages = pages.withColumn("declared", language_id.markup_language(F.col("html"))).drop("html")
    found = language_id.identify(pages, "page_id", "text", declared=F.col("declared"), address=F.col("url"))
    return found.select("page_id", "language", "confidence", "text_language", "declared_language", "rejected")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_ngram_join": op3_ngram_join,
    "op4_decontamination": op4_decontamination,
    "op5_lm_score": op5_lm_score,
    "op6_pii": op6_pii,
    "op7_token_counts": op7_token_counts,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_language_id": op9_language_id,
    "pages_language": pages_language,
    "op10_topk": op10_topk,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op3_ngram_join": rf"""
        with recursive w as (select doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) as w from documents),
        s as (select doc_id, case when len(w) >= 3 then list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))
          when len(w) > 0 then [array_to_string(w, ' ')] else [] end as sh from w),
        x as (select doc_id, unnest(sh) as g from s),
        i as (select a.doc_id as a, b.doc_id as b, count(*) as c from x a join x b on a.g = b.g and a.doc_id < b.doc_id group by all),
        l as (select a, b from i join s p on p.doc_id = a join s q on q.doc_id = b where 100 * c >= 90 * (len(p.sh) + len(q.sh) - c)),
        e as (select a, b from l union all select b, a from l),
        r(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, e.b from r join e on r.other = e.a)
        select doc_id, cast(any_value(len(sh)) as bigint) as n_shingles, min(other) as component_id from r join s using (doc_id) group by doc_id""",
    "op4_decontamination": f"""
        with d as (select doc_id, coalesce({_ITEM_WORDS}, []) as w from documents),
        i as (select item_id, {_ITEM_WORDS} as w from benchmark),
        iw as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') as win
          from (select *, unnest(range(1, len(w) - least(10, len(w)) + 2)) as k from i where len(w) > 0)),
        dw as (select doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') as win
          from (select *, unnest(range(1, len(w) - n + 2)) as k from d, (select distinct n from iw))),
        h as (select doc_id, item_id, k, n from dw join iw using (n, win)),
        p as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(k, k + n)) as q from h) group by doc_id),
        t as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items
          from (select distinct doc_id, cast(item_id as varchar) as item_id from h) group by doc_id)
        select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
          sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join p using (doc_id) left join t using (doc_id)""",
    "op10_topk": """
        with v as (
          select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e
          from embeddings
          where embedding is not null and list_count(embedding) = len(embedding)
            and len(list_filter(embedding, lambda x: not isfinite(x))) = 0),
        s as (
          select q.vec_id as query_id, v.vec_id, cast(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) as bigint) as score
          from v q join v on q.vec_id <> v.vec_id where q.vec_id % 20 = 0)
        select query_id, cast(rank as int) as rank, vec_id, score from (
          select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20""",
}
