"""Queries over the driver tables for the curation and evaluation operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import scores as S
from lexmill.functions import text as T
from lexmill.operators import dedup, evaluation, joins, leakage, personal, sampling, scoring, validate
from lexmill.plans.registry import QUERIES, SQL, query
from lexmill.session import dealt, table
from lexmill.sources import records
from lexmill.streaming import events

SEED = 3407

# Parts of the SQL that several queries share.
_KEY = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"
_ORDER = "sha256(concat('3407:', doc_id))"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return dealt(table(spark, d, "documents"))


# ---- keys, normal forms, deduplication


@query(f"""
    select doc_id, lang, source from (select *, row_number() over (partition by {_KEY} order by doc_id) r from documents) where r = 1""")
def dedup_exact_keep_first(spark, d):
    return dedup.keep_first(docs(spark, d), T.comparison_key("text"), "doc_id").select("doc_id", "lang", "source")


@query(f"""
    select lang, source, count(*) as n from (select *, row_number() over (partition by {_KEY} order by doc_id) r from documents)
    where r = 1 group by all""")
def distinct_by_language_source(spark, d):
    kept = dedup.keep_first(docs(spark, d), T.comparison_key("text"), "doc_id")
    return kept.groupBy("lang", "source").agg(F.count("*").alias("n"))


@query(f"select sha256({_KEY}) as key_hash, count(*) as n, min(doc_id) as first from documents group by {_KEY} having count(*) > 1")
def duplicate_groups(spark, d):
    return dedup.duplicate_groups(docs(spark, d), T.comparison_key("text"), "doc_id")


@query(f"""
    with k as (select doc_id, row_number() over (partition by source, {_KEY} order by doc_id) a, row_number() over (partition by {_KEY} order by doc_id) b from documents)
    select doc_id, case when a > 1 then 'duplicate_id' when b > 1 then 'duplicate_pair' end as duplicate_reason from k""")
def duplicate_reasons(spark, d):
    first = F.concat_ws("\n", "source", T.comparison_key("text"))
    return dedup.duplicate_reasons(docs(spark, d), first, T.comparison_key("text"), "doc_id").select("doc_id", "duplicate_reason")


@query("""
    select conv_id, role, text from (select *, row_number() over (partition by conv_id order by turn desc) r from conversations) where r = 1""")
def keyed_last_wins(spark, d):
    return dedup.keep_last(table(spark, d, "conversations"), "conv_id", F.col("turn")).select("conv_id", "role", "text")


@query("""
    select doc_id, substr(sha1(concat(source, ':', doc_id)), 1, 16) as stable_id,
      sha256(concat(lower(trim(source, ' ' || chr(10) || chr(9) || chr(13))), chr(10), lower(trim(text, ' ' || chr(10) || chr(9) || chr(13))))) as pair_hash
    from documents""")
def stable_ids(spark, d):
    return docs(spark, d).select("doc_id", T.stable_id("source", "doc_id").alias("stable_id"), T.pair_hash("source", "text").alias("pair_hash"))


@query(r"""
    with s as (select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) as y, source from documents)
    select doc_id, sha256(y) as storage_sha256, sha1(concat(source, chr(10), y)) as preference_id from s""")
def storage_forms(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(T.storage_form("text"), 256).alias("storage_sha256"), T.joined_hash("source", "text").alias("preference_id"))


@query(r"""
    select doc_id,
      sha256(trim(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '[^\p{L}\p{M}\p{N}_\s]', '', 'g'))) as words_sha256,
      sha256(trim(regexp_replace(translate(lower(text), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '\s+', ' ', 'g'))) as punctuation_sha256,
      sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) as plain_sha256
    from documents""")
def metric_forms(spark, d):
    return docs(spark, d).select("doc_id", *(F.sha2(T.metric_form("text", f), 256).alias(f"{f}_sha256") for f in ("words", "punctuation", "plain")))


@query("select count(*) as n_rows, count(distinct (doc_id, lang, source, n_chars, text)) as n_distinct from documents")
def record_hash_gate(spark, d):
    return dedup.duplicate_records(docs(spark, d), T.record_hash("doc_id", "lang", "source", "n_chars", "text"))


@query("select doc_id, list_filter(list_transform(string_split(text, ','), lambda v: trim(regexp_replace(v, '\\s+', ' ', 'g'))), lambda v: v <> '') as parts from documents")
def listed_values(spark, d):
    return docs(spark, d).select("doc_id", T.as_list("text").alias("parts"))


# ---- distributions


@query("select lang, source, count(*) as n, 100 * count(*) / sum(count(*)) over () as percent from documents group by all")
def lang_source_distribution(spark, d):
    return evaluation.distribution(docs(spark, d), ["lang", "source"])


@query("select lang, source, count(*) as n from documents group by grouping sets ((lang), (source), (lang, source))")
def strata_grouping_sets(spark, d):
    return evaluation.combinations(docs(spark, d), ["lang", "source"])


@query("""
    with j as (select d.text, d.lang, l.quality, l.toxic from documents d left join labels l using (doc_id))
    select unnest(['text', 'lang', 'quality', 'toxic']) as field,
      unnest([count(*) filter (text is null or trim(text) = ''), count(*) filter (lang is null or trim(lang) = ''), count(*) filter (quality is null), count(*) filter (toxic is null)]) as missing,
      count(*) as total from j""")
def missing_counts(spark, d):
    return evaluation.missing_counts(docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left"), ["text", "lang", "quality", "toxic"])


@query("""
    select lang, count(*) as n, min(n_chars) as minimum, quantile_cont(n_chars, .25) as p25, quantile_cont(n_chars, .5) as p50, quantile_cont(n_chars, .75) as p75,
      quantile_cont(n_chars, .95) as p95, avg(n_chars) as mean, max(n_chars) as maximum from documents group by lang""")
def length_stats(spark, d):
    return evaluation.describe(docs(spark, d), "n_chars", "lang")


@query(r"""
    with t as (select source, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) as k from documents)
    select source, count(*) as n, count(*) filter (k > 1000) as over_1000, 100 * count(*) filter (k > 1000) / count(*) as percent_over_1000,
      count(*) filter (k > 2048) as over_2048, 100 * count(*) filter (k > 2048) / count(*) as percent_over_2048 from t group by source""")
def over_limit_rate(spark, d):
    t = docs(spark, d).select("source", F.size(T.tokens(F.col("text"))).alias("k"))
    return evaluation.over_limits(t, "k", [1000, 2048], "source")


@query("select doc_id, n_chars from documents order by n_chars desc, doc_id limit 20")
def longest_topk(spark, d):
    return evaluation.top(docs(spark, d).select("doc_id", "n_chars"), 20, F.desc("n_chars"), F.col("doc_id"))


@query("select source, doc_id, cast(place as int) as place from (select *, row_number() over (partition by source order by doc_id) as place from documents) where place <= 3")
def first_k_per_source(spark, d):
    return evaluation.first_per_group(docs(spark, d).select("source", "doc_id"), "source", 3, F.col("doc_id"))


@query("select user_id, event_id, avg(value) over (partition by user_id order by event_id rows unbounded preceding) as running_mean from events")
def running_means(spark, d):
    return evaluation.running_mean(table(spark, d, "events"), "user_id", "value", F.col("event_id")).select("user_id", "event_id", "running_mean")


@query("select doc_id, lang from documents order by doc_id limit 50 offset 100")
def positional_slice(spark, d):
    return records.position_slice(docs(spark, d).select("doc_id", "lang"), "doc_id", 100, 50)


@query("""
    select l.doc_id, l.quality, d.doc_id is not null as found from labels l left join documents d using (doc_id)""")
def selected_and_missing(spark, d):
    labels = table(spark, d, "labels").select("doc_id", "quality")
    found, missing = leakage.selected(labels, docs(spark, d).select("doc_id"), "doc_id")
    gone = labels.join(found.select("doc_id"), "doc_id", "left_anti")
    return evaluation.union_tagged({"yes": found, "no": gone}, "__t").select("doc_id", "quality", (F.col("__t") == "yes").alias("found"))


# ---- validation


@query(r"""
    with r as (select doc_id, [case when not coalesce(lang in ('en', 'fr'), false) then 'language' end, case when not (length(trim(text, ' ' || chr(10))) >= 200) then 'short_text' end,
      case when not regexp_matches(source, '^src[0-9]$') then 'source' end, case when length(text) <> n_chars then 'n_chars' end] as e from documents)
    select * from (select doc_id, unnest(e) as rule from r) where rule is not null""")
def schema_errors(spark, d):
    rules = {
        "language": F.col("lang").isin("en", "fr"), "short_text": F.length(T.strip("text")) >= 200,
        "source": F.col("source").rlike("^src[0-9]$"), "n_chars": F.length("text") == F.col("n_chars"),
    }
    return validate.errors(docs(spark, d), "doc_id", rules)


@query("""
    with k as (select props, list_filter(['page', 'ref', 'missing'], lambda x: not list_contains(json_keys(props), x)) as missing from events)
    select missing, count(*) as n from k group by missing""")
def missing_json_keys(spark, d):
    rows = table(spark, d, "events").select(validate.missing_keys(F.col("props"), ["page", "ref", "missing"]).alias("missing"))
    return rows.groupBy("missing").agg(F.count("*").alias("n"))


_WATERFALL = f"""
    with j as (select d.doc_id, d.lang, l.quality, l.toxic, length(trim(text, ' ' || chr(10))) as n, {_KEY} as k,
        {_KEY} in (select lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g'))) from benchmark b) as leak
      from documents d left join labels l using (doc_id)),
    r as (select *, case when n < 200 then 'short' when quality is null then 'no_label' when toxic = 1 then 'toxic' when leak then 'leakage' when lang not in ('en', 'fr') then 'language' else 'usable' end as reason from j),
    a as (select *, case when reason = 'usable' and row_number() over (partition by k, reason order by doc_id) > 1 then 'duplicate' else reason end as drop_reason from r)
    select drop_reason, count(*) as n from a group by drop_reason"""


@query(_WATERFALL)
def drop_reason_waterfall(spark, d):
    # each text is read once and left behind: a row goes on with its key's hash, a flag, language and labels
    k = F.sha2(T.comparison_key("text"), 256)
    j = docs(spark, d).select("doc_id", "lang", k.alias("k"), (F.length(T.strip("text")) < 200).alias("short"))
    j = j.join(table(spark, d, "labels"), "doc_id", "left")
    known = table(spark, d, "benchmark").select(k.alias("k")).distinct().withColumn("leak", F.lit(True))
    j = j.join(known, "k", "left").withColumn("leak", F.coalesce("leak", F.lit(False)))
    reason = validate.drop_reason(
        {
            "short": F.col("short"), "no_label": F.col("quality").isNull(), "toxic": F.col("toxic") == 1,
            "leakage": F.col("leak"), "language": ~F.col("lang").isin("en", "fr"),
        }
    )
    # of the rows still alive, those after the first of their key are duplicates
    alive = F.when(F.col("reason") == "usable", F.col("k"))
    counted = j.select("k", reason.alias("reason")).groupBy("reason", alive.alias("k")).agg(F.count("*").alias("n"))
    first = F.when(F.col("reason") == "usable", 1).otherwise(F.col("n"))
    both = F.array(F.struct(F.col("reason").alias("drop_reason"), first.alias("n")), F.struct(F.lit("duplicate").alias("drop_reason"), (F.col("n") - first).alias("n")))
    return counted.select(F.explode(both).alias("x")).groupBy("x.drop_reason").agg(F.sum("x.n").alias("n")).where("n > 0")


@query("""
    with e(lang, expected) as (values ('en', 620), ('fr', 145), ('it', 5)), a as (select lang, count(*) as actual from documents group by lang)
    select lang, coalesce(expected, 0) as expected, coalesce(actual, 0) as actual from e full join a using (lang) where coalesce(expected, 0) <> coalesce(actual, 0)""")
def count_expectations(spark, d):
    actual = docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"))
    return validate.expectations(actual, "lang", {"en": 620, "fr": 145, "it": 5})


@query("""
    select doc_id, 'row' as field from documents where doc_id % 17 = 0
    union all select doc_id, 'lang' from documents where doc_id % 17 <> 0 and doc_id % 10 = 0
    union all select doc_id, 'n_chars' from documents where doc_id % 17 <> 0 and doc_id % 6 = 0 and n_chars is not null""")
def protected_fields(spark, d):
    """Fields that a faulty step changed, beside texts that it was free to change."""
    before = docs(spark, d)
    i = F.col("doc_id")
    after = before.where(i % 17 != 0).withColumns({
        "text": personal.anonymised(F.col("text")), "lang": F.when(i % 10 == 0, "xx").otherwise(F.col("lang")), "n_chars": F.when(i % 6 != 0, F.col("n_chars")),
    })
    return validate.changed_fields(before, after, "doc_id", ["lang", "source", "n_chars"])


# ---- leakage


@query(f"""
    select doc_id, lang from documents where {_KEY} not in (select lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g'))) from benchmark b)""")
def leakage_exact_anti(spark, d):
    left = leakage.without_leaks(docs(spark, d), T.comparison_key("text"), table(spark, d, "benchmark"), T.comparison_key("text"))
    return left.select("doc_id", "lang")


@query(f"""
    with k as (select distinct source, {_KEY} as k from documents)
    select a.source as left_set, b.source as right_set, count(*) as n_shared from k a join k b on a.k = b.k and a.source < b.source group by all""")
def leakage_matrix(spark, d):
    return leakage.overlap_matrix(docs(spark, d), F.col("source"), T.comparison_key("text"))


@query(f"""
    with a as (select distinct {_KEY} as k from documents where lang = 'en'), b as (select distinct {_KEY} as k from documents where source = 'src1'),
    j as (select case when a.k is null then 'right_only' when b.k is null then 'left_only' else 'both' end as relation from a full join b on a.k = b.k)
    select relation, count(*) as n from j group by relation union all select 'union', count(*) from j""")
def key_set_relations(spark, d):
    key = F.sha2(T.comparison_key("text"), 256)
    return leakage.set_relation(docs(spark, d).where("lang = 'en'").select(key), docs(spark, d).where("source = 'src1'").select(key))


# ---- quotas, samples, splits

_QUOTA = """
    c as (select lang, source, count(*) as n from documents group by all),
    t0 as (select *, sum(n) over () as total, cast(floor(n * 0.8) as bigint) as b, n * 0.8 - floor(n * 0.8) as f from c),
    t1 as (select *, b + case when row_number() over (order by f desc, lang, source) <= round(total * 0.8) - sum(b) over () then 1 else 0 end as train from t0),
    v0 as (select *, least(cast(floor(n * 0.1) as bigint), n - train) as vb, n * 0.1 - floor(n * 0.1) as vf from t1),
    v1 as (select *, vb + case when n - train > vb and row_number() over (partition by n - train > vb order by vf desc, lang, source) <= round(total * 0.1) - sum(vb) over () then 1 else 0 end as validation from v0),
    q as (select lang, source, n, cast(train as bigint) as train, cast(validation as bigint) as validation, cast(n - train - validation as bigint) as test from v1)"""
_SPLIT = f"""with {_QUOTA},
    s as (select d.doc_id, d.text, d.lang, d.source, case when r <= train then 'train' when r <= train + validation then 'validation' else 'test' end as split
      from (select *, row_number() over (partition by lang, source order by {_ORDER}, doc_id) as r from documents) d join q using (lang, source))"""


@query(f"with {_QUOTA} select * from q")
def split_quota_table(spark, d):
    return sampling.split_quotas(docs(spark, d).groupBy("lang", "source").agg(F.count("*").alias("n")), ["lang", "source"])


@query("""
    with c as (select lang, count(*) as n from documents group by lang), s as (select *, 100 * n / sum(n) over () as share from c),
    b as (select *, cast(floor(share) as bigint) as base, share - floor(share) as f from s)
    select lang, n, base + case when row_number() over (order by f desc, lang) <= 100 - sum(base) over () then 1 else 0 end as by_label,
      base + case when row_number() over (order by f desc, n desc, lang desc) <= 100 - sum(base) over () then 1 else 0 end as by_count from b""")
def proportional_quota(spark, d):
    counts = docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"))
    one = sampling.proportional_quotas(counts, "lang", 100).withColumnRenamed("quota", "by_label")
    two = sampling.proportional_quotas(counts, "lang", 100, ties="count").select("lang", F.col("quota").alias("by_count"))
    return one.join(two, "lang")


def _split(spark, d):
    return sampling.stratified_split(docs(spark, d), ["lang", "source"], "doc_id", SEED)


@query(f"{_SPLIT} select doc_id, split from s")
def stratified_split(spark, d):
    return _split(spark, d).select("doc_id", "split")


@query(f"""{_SPLIT}, a as (select lang, source, split, count(*) as actual from s group by all),
    e as (select lang, source, 'train' as split, train as expected from q union all select lang, source, 'validation', validation from q union all select lang, source, 'test', test from q)
    select lang, source, split, coalesce(expected, 0) as expected, coalesce(actual, 0) as actual from e full join a using (lang, source, split)""")
def split_conformance(spark, d):
    return sampling.split_conformance(_split(spark, d), ["lang", "source"])


@query(f"""{_SPLIT}, k as (select distinct split, {_KEY} as k from s)
    select a.split as left_set, b.split as right_set, count(*) as n_shared from k a join k b on a.k = b.k and a.split < b.split group by all""")
def split_leakage(spark, d):
    return leakage.overlap_matrix(_split(spark, d), F.col("split"), T.comparison_key("text"))


@query(f"""{_SPLIT}, p as (select split, substr(sha256(cast(doc_id as varchar)), 1, 4) as p, sha256(string_agg(cast(doc_id as varchar), ',' order by doc_id)) as d from s group by all)
    select split, sha256(string_agg(d, ',' order by p)) as fingerprint from p group by split""")
def split_fingerprint(spark, d):
    return sampling.fingerprint(_split(spark, d), "split", "doc_id")


@query(f"select doc_id, lang from documents order by {_ORDER}, doc_id limit 100")
def random_sample(spark, d):
    return sampling.sample(docs(spark, d).select("doc_id", "lang"), "doc_id", 100, SEED)


_PROPORTIONAL = """c as (select lang, count(*) as n from {rows} group by lang), s as (select *, {size} * n / sum(n) over () as share from c),
    b as (select *, cast(floor(share) as bigint) as base, share - floor(share) as f from s),
    q as (select lang, base + case when row_number() over (order by {ties}) <= {size} - sum(base) over () then 1 else 0 end as quota from b)"""


@query(f"""with {_PROPORTIONAL.format(rows="documents", size=150, ties="f desc, lang")}
    select doc_id, lang from (select *, row_number() over (partition by lang order by {_ORDER}, doc_id) as r from documents) join q using (lang) where r <= quota""")
def stratified_random_sample(spark, d):
    return sampling.stratified_sample(docs(spark, d), "lang", "doc_id", 150, SEED).select("doc_id", "lang")


@query(f"""with l as (select d.doc_id, d.lang, d.n_chars * 0.001 + 5 * quality as score from documents d join labels using (doc_id)),
    {_PROPORTIONAL.format(rows="l", size=60, ties="f desc, n desc, lang desc")}
    select doc_id, lang, cast(r as int) as place from (select *, row_number() over (partition by lang order by score desc, {_ORDER}, doc_id) as r from l) join q using (lang) where r <= quota""")
def stratified_topk_by_score(spark, d):
    j = docs(spark, d).join(table(spark, d, "labels"), "doc_id").withColumn("score", F.col("n_chars") * F.lit(0.001) + 5 * F.col("quality"))
    return sampling.stratified_top(j, "lang", "doc_id", "score", 60, SEED).select("doc_id", "lang", "place")


_CONV = """m as (select conv_id, list({'role': role, 'content': text} order by turn) as messages from conversations group by conv_id)"""


def conversations(spark, d):
    """(conv_id, messages): turns of each conversation in order."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def pairs(spark, d):
    """Preference pairs: the first user turn, the first and the last assistant turn where they differ."""
    answer = F.filter("messages", lambda m: m["role"] == "assistant")
    p = conversations(spark, d).select(
        "conv_id", T.first_content("messages", "user").alias("prompt"), F.get(answer, F.lit(0))["content"].alias("chosen"), T.last_content(answer).alias("rejected")
    )
    return p.where("prompt is not null and chosen <> rejected")


_PAIRS = _CONV + """, a as (select conv_id, list_filter(messages, lambda x: x.role = 'user') as u, list_filter(messages, lambda x: x.role = 'assistant') as s from m),
    p as (select conv_id, u[1].content as prompt, s[1].content as chosen, s[-1].content as rejected from a where len(u) > 0 and s[1].content <> s[-1].content)"""


@query(f"""with {_PAIRS},
    k as (select conv_id, lower(trim(regexp_replace(prompt, '\\s+', ' ', 'g'))) as g, case when length(prompt) > 60 then 'long' else 'short' end as label, length(chosen) * 1.0 as score from p),
    cv as (select label, count(*) as n from k group by label), sv as (select *, 10 * n / sum(n) over () as share from cv), bv as (select *, cast(floor(share) as bigint) as base, share - floor(share) as f from sv),
    qv as (select label, base + case when row_number() over (order by f desc, n desc, label desc) <= 10 - sum(base) over () then 1 else 0 end as quota from bv),
    v as (select k.* exclude (score), r from (select *, row_number() over (partition by label order by score desc, sha256(concat('3407:', conv_id)), conv_id) as r from k) k join qv using (label) where r <= quota),
    rest as (select * from k where g not in (select g from v)),
    ct as (select label, count(*) as n from rest group by label), st as (select *, 30 * n / sum(n) over () as share from ct), bt as (select *, cast(floor(share) as bigint) as base, share - floor(share) as f from st),
    qt as (select label, base + case when row_number() over (order by f desc, n desc, label desc) <= 30 - sum(base) over () then 1 else 0 end as quota from bt)
    select conv_id, label, 'validation' as split from v union all
    select conv_id, label, 'train' from (select *, row_number() over (partition by label order by score desc, sha256(concat('3408:', conv_id)), conv_id) as r from rest) join qt using (label) where r <= quota""")
def group_aware_split(spark, d):
    p = pairs(spark, d).select(
        "conv_id", "prompt", F.when(F.length("prompt") > 60, "long").otherwise("short").alias("label"), (F.length("chosen") * F.lit(1.0)).alias("score")
    )
    return sampling.group_split(p, T.comparison_key("prompt"), "conv_id", "label", "score", 10, 30, SEED).select("conv_id", "label", "split")


# ---- conversations and preferences


@query(f"""with {_CONV}
    select conv_id, list_filter(messages, lambda x: x.role = 'user')[1].content as first_user, list_filter(messages, lambda x: x.role = 'assistant')[1].content as first_assistant,
      messages[-1].content as last_content, len(messages) as n_messages from m""")
def first_user_assistant(spark, d):
    return conversations(spark, d).select(
        "conv_id", T.first_content("messages", "user").alias("first_user"), T.first_content("messages", "assistant").alias("first_assistant"),
        T.last_content("messages").alias("last_content"), F.size("messages").cast("long").alias("n_messages"),
    )


@query(f"""with {_CONV}
    select conv_id, array_to_string(list_transform(messages, lambda x: concat('<|', x.role, '|>', chr(10), x.content, chr(10))), '') as rendered,
      array_to_string(list_transform(messages, lambda x: concat(x.role, ': ', x.content)), chr(10)) as plain from m""")
def chat_render(spark, d):
    return conversations(spark, d).select("conv_id", T.chat_template("messages").alias("rendered"), T.conversation_text("messages").alias("plain"))


@query(f"""with {_CONV}
    select conv_id, len(list_filter(messages, lambda x: trim(x.role) <> '' and trim(x.content) <> '')) = len(messages) as strict,
      len(list_filter(messages, lambda x: trim(x.content) <> '')) >= 2 and list_contains(list_transform(messages, lambda x: x.role), 'user')
      and list_contains(list_transform(messages, lambda x: x.role), 'assistant') as lenient from m""")
def valid_conversation(spark, d):
    return conversations(spark, d).select("conv_id", T.is_conversation("messages", strict=True).alias("strict"), T.is_conversation("messages").alias("lenient"))


@query(f"with {_PAIRS} select * from p")
def preference_pairs(spark, d):
    return pairs(spark, d)


RAW = [
    (1, 5.0, 3.0, 1, 3, None, None, None), (2, 2.0, 4.0, 1, 2, "accurate and clear", "wrong", None), (3, None, None, 3, 1, None, None, "Final verdict: [[A]]"),
    (4, 4.0, 4.0, None, None, "incorrect", "errors, unsafe, misleading", "Final verdict: [[B]]"), (5, 3.5, 3.0, 2, 9, "Accurate accurate, detailed", "fails to answer", "relevant"),
    (6, None, 2.0, 1, 1, "", "", ""), (7, None, None, None, None, None, None, None),
]


def raw_preferences(spark):
    rows = spark.createDataFrame(RAW, "id int, cs double, rs double, cr int, rr int, ce string, re string, feedback string")
    side = lambda p: F.struct(F.col(f"{p}s").alias("score"), F.col(f"{p}r").alias("rank"), F.col(f"{p}e").alias("evaluation"))
    return rows.select("id", side("c").alias("chosen"), side("r").alias("rejected"), "feedback")


def _sql_rows() -> str:
    lit = lambda v: "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in RAW)


def _sql_terms(x: str, terms: dict[str, float], sign: int = 1) -> str:
    return "(" + " + ".join(f"case when contains(lower(coalesce({x}, '')), '{t}') then {sign * w} else 0.0 end" for t, w in terms.items()) + ")"


_BOTH = S.POSITIVE_TERMS | S.NEGATIVE_TERMS


@query(f"""
    with r(id, cs, rs, cr, rr, ce, re, feedback) as (values {_sql_rows()})
    select cast(id as int) as id,
      cast(case when cs is not null and rs is not null then 5 * (cs - rs) + cs - case when cs < 4 then 3.0 else 0.0 end else 0.0 end
      + case when rr - cr > 0 then 1.5 * least(rr - cr, 5) when rr - cr < 0 then -5.0 else 0.0 end
      + 1.5 * {_sql_terms("ce", _BOTH)} + least({_sql_terms("re", S.NEGATIVE_TERMS, -1)}, 5.0) + {_sql_terms("feedback", _BOTH)}
      + case when contains(lower(coalesce(feedback, '')), 'final verdict: [[a]]') then 3.0 when contains(lower(coalesce(feedback, '')), 'final verdict: [[b]]') then -8.0 else 0.0 end as double) as score,
      not (coalesce(cs < rs, false) or coalesce(cr > rr, false) or contains(lower(coalesce(feedback, '')), 'final verdict: [[b]]')) as coherent from r""")
def preference_score(spark, d):
    c, r, f = F.col("chosen"), F.col("rejected"), F.col("feedback")
    return raw_preferences(spark).select("id", S.selection_score(c, r, f).alias("score"), S.is_coherent(c, r, f).alias("coherent"))


DECISIONS = [(1, -1.192527, -1.134541), (2, -0.8, -1.2), (3, -0.5, -0.5), (4, -0.5, -0.5 + 1e-12)]


@query("""
    with r(id, c, r) as (values (1, -1.192527::double, -1.134541::double), (2, -0.8, -1.2), (3, -0.5, -0.5), (4, -0.5, -0.499999999999))
    select cast(id as int) as id, case when abs(c - r) < 1e-8 then 'tie' when c > r then 'chosen' else 'rejected' end as preferred from r""")
def preference_decision(spark, d):
    return spark.createDataFrame(DECISIONS, "id int, c double, r double").select("id", S.decision("c", "r").alias("preferred"))


_SCORE = "-2 * cast(concat('0x', substr(sha256(concat(prompt, chr(10), {})), 1, 12)) as bigint) / 281474976710656.0"


@query(f"""with {_PAIRS}, s as (select {_SCORE.format("chosen")} as c, {_SCORE.format("rejected")} as r from p)
    select count(*) as n, count(*) as n_valid, count(*) filter (c > r) as n_correct, count(*) filter (c > r) / count(*) as of_valid, count(*) filter (c > r) / count(*) as of_all from s""")
def preference_accuracy(spark, d):
    s = scoring.scored_pairs(pairs(spark, d), scoring.HashScorer(), "prompt", "chosen", "rejected")
    return evaluation.accuracy(s, F.col("chosen_score") > F.col("rejected_score"), F.col("chosen_score").isNotNull())


CHOICES = ["Answer: A", "b.", "A or B", "maybe", "Your choice: B", "", None]


@query("""
    with r(id, raw, choice) as (values (0, 'Answer: A', 'A'), (1, 'b.', 'B'), (2, 'A or B', null), (3, 'maybe', null), (4, 'Your choice: B', 'B'), (5, '', null), (6, null, null))
    select cast(id as int) as id, choice from r""")
def choice_parse(spark, d):
    return spark.createDataFrame(list(enumerate(CHOICES)), "id int, raw string").select("id", T.parsed_choice("raw").alias("choice"))


# ---- predictions: each document's text against the next one's


def predictions(spark, d):
    a = docs(spark, d).select("doc_id", "lang", "source", F.col("text").alias("prediction"))
    b = docs(spark, d).select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("reference"))
    return a.join(b, "doc_id")


_F1 = r"""
    p as (select a.doc_id, a.lang, a.source, {a} as p, {b} as r from documents a join documents b on b.doc_id = a.doc_id + 1),
    tp as (select doc_id, t, count(*) as n from (select doc_id, unnest(regexp_split_to_array(p, '\s+')) as t from p) where t <> '' group by all),
    tr as (select doc_id, t, count(*) as n from (select doc_id, unnest(regexp_split_to_array(r, '\s+')) as t from p) where t <> '' group by all),
    c as (select tp.doc_id, sum(least(tp.n, tr.n)) as c from tp join tr using (doc_id, t) group by tp.doc_id),
    np as (select doc_id, sum(n) as n from tp group by doc_id), nr as (select doc_id, sum(n) as n from tr group by doc_id),
    x as (select p.doc_id, p.lang, p.source, coalesce(c.c / np.n, 0) as precision, coalesce(c.c / nr.n, 0) as recall, cast(p.p = p.r as int) as exact_match
      from p left join c using (doc_id) left join np using (doc_id) left join nr using (doc_id)),
    f as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end as f1 from x)"""
_FORM = {
    "plain": lambda x: rf"trim(regexp_replace(lower({x}.text), '\s+', ' ', 'g'))",
    "punctuation": lambda x: rf"""trim(regexp_replace(translate(lower({x}.text), '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', ''), '\s+', ' ', 'g'))""",
    "words": lambda x: rf"trim(regexp_replace(regexp_replace(lower({x}.text), '\s+', ' ', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', '', 'g'))",
}


def _f1(form: str) -> str:
    return "with " + _F1.format(a=_FORM[form]("a"), b=_FORM[form]("b"))


for _form in _FORM:

    def _token_f1(spark, d, form=_form):
        return evaluation.token_f1(predictions(spark, d), "doc_id", "prediction", "reference", form)

    QUERIES[f"token_f1_{_form}"] = _token_f1
    SQL[f"token_f1_{_form}"] = f"{_f1(_form)} select doc_id, precision, recall, f1, exact_match from f"


def _scored_predictions(spark, d):
    p = predictions(spark, d)
    return evaluation.token_f1(p, "doc_id", "prediction", "reference", "punctuation", "lang", "source")


_GROUPED = """select 'all' as dimension, 'all' as value, count(*) as n, avg(f1) as mean_f1, avg(exact_match) as mean_exact_match from f
    union all select 'lang', lang, count(*), avg(f1), avg(exact_match) from f group by lang
    union all select 'source', source, count(*), avg(f1), avg(exact_match) from f group by source"""


@query(f"{_f1('punctuation')} {_GROUPED}")
def metric_by_dimension(spark, d):
    return evaluation.grouped_means(_scored_predictions(spark, d), ["f1", "exact_match"], ["lang", "source"])


def _deltas(spark, d):
    """Difference of two normal forms' F1, as of a base and a candidate model."""
    f1 = lambda form: evaluation.token_overlap("prediction", "reference", form)["f1"]
    both = predictions(spark, d).select("doc_id", "source", f1("plain").alias("base"), f1("punctuation").alias("candidate"))
    return both.withColumn("delta", F.round(F.col("candidate") - F.col("base"), 9))


_DELTA = f"""with a as ({_f1('plain')} select doc_id, source, f1 from f), b as ({_f1('punctuation')} select doc_id, f1 from f),
    e as (select a.doc_id, a.source, round(b.f1 - a.f1, 9) as delta from a join b using (doc_id))"""


@query(f"{_DELTA} select source, count(*) filter (delta > 0) as improved, count(*) filter (delta < 0) as regressed, count(*) filter (delta = 0) as unchanged, avg(delta) as mean_delta from e group by source")
def delta_by_source(spark, d):
    return evaluation.change_counts(_deltas(spark, d), F.col("delta"), "source")


@query(f"{_DELTA} select doc_id, delta from e order by delta, doc_id limit 10")
def most_regressed(spark, d):
    return evaluation.top(_deltas(spark, d).select("doc_id", "delta"), 10, F.col("delta"), F.col("doc_id"))


# ---- multiple choice

MCQ_TEXTS = [
    "Réponses correctes :\nB. x\nC. y\nD. z", "RÉPONSE CORRECTE : A. foo", "Correct answers: a) b) c)", "The answer is B. because C: d", "none",
    "Réponse correcte non renseignée.", "é. A-",
]
MCQ_PARSED = [["B", "C", "D"], ["A"], ["A"], ["B", "C"], [], [], ["A"]]
MCQ_SETS = [([], []), (["A"], ["A", "B"]), (["A", "B"], ["A"]), (["A", "C"], ["A", "B"]), ([], ["A"]), (["B"], ["B"]), (["A", "B", "C"], ["A", "B", "C"])]


def _sql_list(x: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in x) + "]::varchar[]"


@query(f"select cast(id as int) as id, answers from (values {', '.join(f'({k}, {_sql_list(v)})' for k, v in enumerate(MCQ_PARSED))}) t(id, answers)")
def mcq_parse(spark, d):
    return spark.createDataFrame(list(enumerate(MCQ_TEXTS)), "id int, raw string").select("id", T.parsed_answers("raw").alias("answers"))


def _mcq(spark):
    rows = spark.createDataFrame([(k, f"s{k % 2}", a, t) for k, (a, t) in enumerate(MCQ_SETS)], "id int, source string, answer array<string>, truth array<string>")
    return rows.select("id", "source", "answer", "truth", S.cardinality("truth").alias("cardinality"), *(v.alias(k) for k, v in S.set_comparison("answer", "truth").items()))


_MCQ = f"""with r as (select cast(id as int) as id, concat('s', id % 2) as source, a, t, len(list_intersect(a, t)) as c from (values {', '.join(f'({k}, {_sql_list(a)}, {_sql_list(t)})' for k, (a, t) in enumerate(MCQ_SETS))}) v(id, a, t)),
    m as (select *, case when c = len(a) and c = len(t) then 'EXACT' when c = len(a) then 'UNDER' when c = len(t) then 'OVER' else 'WRONG' end as category,
      case when len(a) > 0 then c / len(a) else 0.0 end as precision, case when len(t) > 0 then c / len(t) else 0.0 end as recall, case when len(t) = 1 then 'SINGLE' else 'MULTI' end as cardinality from r),
    x as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end as f1 from m)"""


@query(f"{_MCQ} select id, category, precision, recall, f1, cardinality from x")
def mcq_compare(spark, d):
    return _mcq(spark).select("id", "category", "precision", "recall", "f1", "cardinality")


@query(f"""{_MCQ} select source, cardinality, count(*) as n, avg(cast(category = 'EXACT' as int)) as exact, avg(precision) as mean_precision, avg(recall) as mean_recall, avg(f1) as mean_f1 from x group by all""")
def mcq_breakdown(spark, d):
    return _mcq(spark).groupBy("source", "cardinality").agg(
        F.count("*").alias("n"), F.avg((F.col("category") == "EXACT").cast("int")).alias("exact"), *(F.avg(m).alias(f"mean_{m}") for m in ("precision", "recall", "f1"))
    )


@query(f"""{_MCQ} select cast(len(t) as int) as reference, {', '.join(f"count(*) filter (len(a) = {k}) as prediction_{k}" for k in range(6))} from x where cardinality = 'MULTI' group by len(t)""")
def cardinality_matrix(spark, d):
    m = _mcq(spark).where("cardinality = 'MULTI'").select(F.size("truth").alias("reference"), F.size("answer").alias("prediction"))
    return evaluation.matrix(m, "reference", "prediction", list(range(6)))


@query(f"{_MCQ} select cast(len(t) as int) as n_answers, count(*) as n from x group by len(t)")
def answer_count_distribution(spark, d):
    return _mcq(spark).groupBy(F.size("truth").alias("n_answers")).agg(F.count("*").alias("n"))


@query("""select 1 as id, concat_ws(chr(10), 'Which one?', '', 'Options:', 'A. red', 'C. blue') as instruction, 'Réponse correcte : A. red' as response
    union all select 2, concat_ws(chr(10), 'Q', '', 'Options:', 'B. b'), concat_ws(chr(10), 'Réponses correctes :', 'B. b', 'E')
    union all select 3, concat_ws(chr(10), 'Q', '', 'Options:'), 'Réponse correcte non renseignée.'""")
def mcq_render(spark, d):
    rows = [(1, " Which  one?", {"A": "red", "B": " ", "C": "blue"}, ["A"]), (2, "Q", {"B": "b"}, ["B", "E"]), (3, "Q", {}, [])]
    df = spark.createDataFrame(rows, "id int, question string, choices map<string,string>, answers array<string>")
    return df.select("id", T.mcq_instruction("question", "choices").alias("instruction"), T.mcq_response("choices", "answers").alias("response"))


@query("""select * from (values (1, 'choice_C_blank'), (1, 'choice_D_blank'), (1, 'choice_E_blank'), (1, 'choices_keys'), (2, 'answers_empty'), (3, 'answers_unknown'), (3, 'answers_blank')) t(id, rule)""")
def mcq_structure(spark, d):
    full = dict(zip("ABCDE", "vwxyz", strict=True))
    rows = [(0, full, ["A"]), (1, {"A": "v", "B": "w"}, ["A"]), (2, full, []), (3, full, ["A", "F"])]
    df = spark.createDataFrame(rows, "id int, choices map<string,string>, answers array<string>")
    return validate.errors(df, "id", validate.mcq_rules(F.col("choices"), F.col("answers")))


# ---- judges, logs, training curves

_GOOD = '{"faithfulness": {"score": 4, "reason": "a"}, "answer_relevancy": {"score": 3, "reason": "b"}, "correctness": {"score": 5, "reason": "c"}, "completeness": {"score": 2, "reason": "d"}}'
JUDGED = [(1, "en", _GOOD), (2, "fr", f"```json\n{_GOOD.replace('4', '0')}\n```"), (3, "en", _GOOD.replace("5", "6")), (4, "fr", '{"faithfulness": 1}'), (5, "en", "none"), (6, "en", _GOOD.replace("5", '"5"'))]


@query("""select 'all' as dimension, 'all' as value, 2 as n, 2.0::double as mean_faithfulness, 3.0::double as mean_overall
    union all select 'language', 'en', 1, 4.0, 3.5 union all select 'language', 'fr', 1, 0.0, 2.5""")
def judge_summary(spark, d):
    df = spark.createDataFrame(JUDGED, "id int, language string, raw string").withColumn("s", S.judge_scores("raw")).where("s is not null")
    overall = F.round(sum((F.col(f"s.{c}") for c in S.CRITERIA[1:]), F.col(f"s.{S.CRITERIA[0]}")) / 4, 3)
    return evaluation.grouped_means(df.select("language", F.col("s.faithfulness").alias("faithfulness"), overall.alias("overall")), ["faithfulness", "overall"], ["language"])


@query("""select * from (values (1, -0.75::double), (2, '-infinity'::double)) t(id, mean_score)""")
def answer_log_probability(spark, d):
    df = spark.createDataFrame([(1, [-3.0, -1.0, -0.5], 1), (2, [-3.0], 1)], "id int, v array<double>, n int")
    return df.select("id", S.mean_answer_score("v", "n").alias("mean_score"))


@query("select * from (values ('a', 20, 0.5::double), ('b', 10, 0.7::double)) t(run, step, eval_loss)")
def best_checkpoint(spark, d):
    rows = [("a", 10, 0.6), ("a", 20, 0.5), ("a", 30, 0.5), ("a", 40, None), ("b", 10, 0.7)]
    return evaluation.best_step(spark.createDataFrame(rows, "run string, step int, eval_loss double"), "run", "step", "eval_loss")


@query("""select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n, avg(value) as mean_latency, max(value) as max_latency from events group by all""")
def event_latency(spark, d):
    return events.latency(table(spark, d, "events"), "ts", ["event_type"], "value")


# ---- markup, languages, personal data


@query(r"""select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) as title,
    sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) as text_sha256 from pages""")
def html_title_text(spark, d):
    return dealt(table(spark, d, "pages")).select("page_id", records.html_title("html").alias("title"), F.sha2(records.html_text("html"), 256).alias("text_sha256"))


def _sql_hits(markers: tuple[str, ...]) -> str:
    return " + ".join(f"cast(contains(x, ' {m} ') as int)" for m in markers)


@query(f"""with p as (select doc_id, concat(' ', lower(text), ' ') as x from documents)
    select doc_id, case when {_sql_hits(T.FRENCH_MARKERS)} > {_sql_hits(T.ENGLISH_MARKERS)} then 'fr' else 'en' end as language from p""")
def marker_language(spark, d):
    return docs(spark, d).select("doc_id", T.marker_language("text").alias("language"))


_EMAIL, _IP = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", personal.PATTERNS["ip_address"]


@query(rf"""select doc_id, len(regexp_extract_all(text, '(?i){_EMAIL}')) as email, len(regexp_extract_all(text, '{_IP}')) as ip_address,
    len(regexp_extract_all(text, '(?i)\b(?:https?://|www\.)[^\s<>"]+')) as url from documents""")
def pii_counts(spark, d):
    return docs(spark, d).select("doc_id", *(v.alias(k) for k, v in personal.counts(F.col("text"), ["email", "ip_address", "url"]).items()))


@query(r"""select doc_id, list_filter([
      case when regexp_matches(text, '(^|[^0-9])(0[1-9])([\s.-]?[0-9]{2}){4}([^0-9]|$)') then 'phone_french' end,
      case when regexp_matches(text, '(^|[^0-9])[0-9]{5}(-[0-9]{4})?([^0-9]|$)') then 'us_zip_code' end,
      case when regexp_matches(text, '(^|[^0-9])[0-9]{3}[-\s][0-9]{2}[-\s][0-9]{4}([^0-9]|$)') then 'social_security_like' end], lambda x: x is not null) as found from documents""")
def pii_flags(spark, d):
    return docs(spark, d).select("doc_id", personal.flags(F.col("text"), ["phone_french", "us_zip_code", "social_security_like"]).alias("found"))


@query()
def pii_alerts(spark, d):
    return personal.alerts(docs(spark, d), "doc_id", ["text"])


# DuckDB's patterns can't look around a match: they take its neighbours instead, in texts whose other characters are all doubled
_OUTSIDE = r"[^\pL\pN_]"
_ALERT_SQL = {
    "email": ("text", r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    "phone_international": ("words", rf"(?:^|{_OUTSIDE})(?:\+\+|00)[0-9]{{1,3}}(?:[\s().-]*[0-9]{{2,4}}){{2,6}}(?:{_OUTSIDE}|$)"),
    "phone_french": ("digits", r"(?:^|[^0-9])0[1-9](?:(?:[\s.-]{2})?[0-9]{2}){4}(?:[^0-9]|$)"),
    "ip_address": ("text", _IP),
    "url": ("text", r"(?i)\b(?:https?://|www\.)[^\s<>\"]+"),
    "date_numeric": ("digits", r"(?:^|[^0-9])(?:[0-9]{1,2}[/-]{2}[0-9]{1,2}[/-]{2}[0-9]{2,4}|[0-9]{4}[/-]{2}[0-9]{1,2}[/-]{2}[0-9]{1,2})(?:[^0-9]|$)"),
    "date_month_year": ("text", personal.PATTERNS["date_month_year"]),
    "social_security_like": ("digits", r"(?:^|[^0-9])[0-9]{3}[-\s]{2}[0-9]{2}[-\s]{2}[0-9]{4}(?:[^0-9]|$)"),
    "us_zip_code": ("digits", r"(?:^|[^0-9])[0-9]{5}(?:--[0-9]{4})?(?:[^0-9]|$)"),
    "french_postal_code": ("digits", r"(?:^|[^0-9])(?:0[1-9]|[1-8][0-9]|9[0-5]|2AA|2BB)(?:\s\s)?[0-9]{3}(?:[^0-9]|$)"),
}
_ALERT_ROWS = " union all ".join(f"select doc_id, '{k}' as type, len(regexp_extract_all({c}, '{p}')) as n from t" for k, (c, p) in _ALERT_SQL.items())


@query(rf"""with t as (select doc_id, text, regexp_replace(text, '({_OUTSIDE})', '\1\1', 'g') as words, regexp_replace(text, '([^0-9])', '\1\1', 'g') as digits from documents),
    a as ({_ALERT_ROWS})
    select type, cast(sum(n) as bigint) as n, count(*) as n_documents from a where n > 0 group by type""")
def pii_alert_counts(spark, d):
    a = personal.alerts(docs(spark, d), "doc_id", ["text"])
    return a.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_documents")).orderBy(F.desc("n"), "type")


@query(rf"""select doc_id, sha256(regexp_replace(regexp_replace(text, '(?i){_EMAIL}', '[EMAIL]', 'g'), '{_IP}', '[IP]', 'g')) as replaced,
    sha256(regexp_replace(regexp_replace(text, '(?i){_EMAIL}', '', 'g'), '{_IP}', '', 'g')) as redacted from documents""")
def anonymized(spark, d):
    x = lambda s: F.sha2(personal.anonymised(F.col("text"), s, ("EMAIL", "IP")), 256)
    return docs(spark, d).select("doc_id", x("replace").alias("replaced"), x("redact").alias("redacted"))


@query("select doc_id, length(text) as n_chars from documents")
def masked_lengths(spark, d):
    return docs(spark, d).select("doc_id", F.length(personal.anonymised(F.col("text"), "mask")).cast("long").alias("n_chars"))


_LEFT = rf"""with t as (select regexp_replace(text, '(?i){_EMAIL}', '[EMAIL]', 'g') as text from documents), d as (select text, regexp_replace(text, '({_OUTSIDE})', '\1\1', 'g') as words from t)
    select 'EMAIL' as entity, cast(coalesce(sum(len(regexp_extract_all(text, '(?i){_EMAIL}'))), 0) as bigint) as n from d
    union all select 'URL', cast(coalesce(sum(len(regexp_extract_all(text, '{_ALERT_SQL["url"][1]}'))), 0) as bigint) from d
    union all select 'IP', cast(coalesce(sum(len(regexp_extract_all(text, '{_IP}'))), 0) as bigint) from d
    union all select 'PHONE', cast(coalesce(sum(len(regexp_extract_all(words, '{_ALERT_SQL["phone_international"][1]}'))), 0) as bigint) from d"""


@query(_LEFT)
def pii_residual(spark, d):
    """What is left after e-mails alone were replaced."""
    return personal.residual(docs(spark, d), personal.anonymised(F.col("text"), entities=("EMAIL",)))


# ---- further rules, lookups and renderings


@query("""select event_id, try_cast(floor(value) as int) as as_int, coalesce(nullif(json_extract_string(props, '$.nothing'), ''), nullif(json_extract_string(props, '$.page'), '')) as page,
    try_cast(json_extract_string(props, '$.ref') as double) as ref_number from events""")
def safe_values(spark, d):
    e = table(spark, d, "events")
    return e.select(
        "event_id", T.safe_number(F.floor("value"), "int").alias("as_int"), T.json_paths("props", "nothing", "page").alias("page"),
        T.safe_number(F.get_json_object("props", "$.ref"), "double").alias("ref_number"),
    )


@query(r"""select doc_id, concat('Be exact.', chr(10), chr(10), 'Question:', chr(10), trim(regexp_replace(source, '\s+', ' ', 'g')), chr(10), chr(10), 'Answer:', chr(10),
    trim(regexp_replace(text, '\s+', ' ', 'g'))) as prompt from documents""")
def prompt_render(spark, d):
    return docs(spark, d).select("doc_id", T.question_prompt("source", "Be exact.", "text").alias("prompt"))


@query("""with l as (select conv_id, last(text order by turn) as prediction from conversations group by conv_id)
    select l.conv_id, l.prediction, f.text as reference from l join conversations f on f.conv_id = l.conv_id and f.turn = (select min(turn) from conversations c where c.conv_id = l.conv_id)""")
def prediction_lookup(spark, d):
    turns = table(spark, d, "conversations")
    first = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("reference"))
    return joins.lookup(first, turns.select("conv_id", "turn", F.col("text").alias("prediction")), "conv_id", F.col("turn")).select("conv_id", "prediction", "reference")


@query("""with t as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) as a, row_number() over (partition by conv_id order by turn desc) as z from conversations)
    select x.conv_id, x.text as first_value, y.text as second_value from t x join t y on x.conv_id = y.conv_id and x.a = 1 and y.z = 1 where trim(x.text) <> trim(y.text)""")
def differing_predictions(spark, d):
    turns = table(spark, d, "conversations")
    first = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    last = turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    return joins.differing(turns.select("conv_id").distinct(), first, last, "conv_id", "text")


@query("""with p as (select page_id, case when regexp_matches(url, 'https?://\\S+|www\\.\\S+') then 'url' end as u, case when regexp_matches(html, '(?i)\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b') then 'email' end as e from pages)
    select page_id, 'url' as type from p where u is not null union all select page_id, 'email' from p where e is not null""")
def control_findings(spark, d):
    pages = table(spark, d, "pages")
    return personal.control_findings(pages, "page_id", F.to_json(F.struct("url", "html")), ("email", "url"))


@query(rf"""with m as (select doc_id, text, unnest(regexp_extract_all(text, '(?i){_EMAIL}')) as match from documents), s as (select *, instr(text, match) as p from m)
    select doc_id, match, substr(text, greatest(p - 150, 1), p - greatest(p - 150, 1) + length(match) + 150) as context from s""")
def email_contexts(spark, d):
    return personal.first_contexts(docs(spark, d), "doc_id", "text")


@query("""select 'a' as run, unnest([10, 10, 20, 20]) as step, unnest(['loss', 'learning_rate', 'eval_loss', 'learning_rate']) as metric, unnest([0.9, 0.1, 0.7, 0.05])::double as value""")
def training_curves(spark, d):
    log = spark.createDataFrame([("a", 10, 0.9, None, 0.1), ("a", 20, None, 0.7, 0.05)], "run string, step int, loss double, eval_loss double, learning_rate double")
    return evaluation.training_curves(log, "run")


@query("select * from (values (1, 'checkpoint-1000', 1000), (2, 'out/checkpoint-20/', 20), (3, 'final', null)) t(id, path, number)")
def checkpoint_numbers(spark, d):
    df = spark.createDataFrame([(1, "checkpoint-1000"), (2, "out/checkpoint-20/"), (3, "final")], "id int, path string")
    return df.withColumn("number", T.checkpoint_number("path"))


@query(f"""with {_CONV}, b as (select conv_id, [case when len(messages) = 0 then 'messages_missing' end,
      case when len(list_filter(messages, lambda x: x.role not in ('user', 'assistant'))) > 0 then 'role_unknown' end,
      case when len(list_filter(messages, lambda x: trim(x.content) = '')) > 0 then 'content_blank' end] as e from m)
    select * from (select conv_id, unnest(e) as rule from b) where rule is not null""")
def training_rows(spark, d):
    return validate.errors(conversations(spark, d), "conv_id", validate.training_rules(F.col("messages"), ("user", "assistant")))


@query("""select * from (values (2, 'confidence_range'), (3, 'validated_stated'), (3, 'tags_is_array')) t(id, rule)""")
def record_shapes(spark, d):
    rows = [(1, 0.5, True, '{"tags": []}'), (2, 1.5, False, '{"tags": ["a"]}'), (3, None, None, '{"tags": "a"}')]
    df = spark.createDataFrame(rows, "id int, confidence double, validated boolean, raw string")
    return validate.errors(df, "id", validate.quality_rules(F.col("confidence"), F.col("validated")) | validate.kind_rules(F.col("raw"), {"tags": "ARRAY"}))


@query("""select doc_id from documents d where not (source <> 'src1' or lang = 'en')""")
def source_language_conflicts(spark, d):
    rule = validate.source_language_rule(F.col("source"), F.col("lang"), {"src1": "en"})
    return validate.errors(docs(spark, d), "doc_id", {"language": rule}).select("doc_id")


@query("""select d.doc_id from documents d join (select source, min(doc_id) as f from documents group by source) s using (source) where d.doc_id > f""")
def repeated_ids(spark, d):
    return validate.repeated_ids(docs(spark, d), "source", "doc_id").select("doc_id")
