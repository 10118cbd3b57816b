"""The registered queries of the training-data operators, and their SQL.

Each query applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import (
    context_tree,
    exact_dedup,
    filter_audit,
    language_id,
    mixing,
    packing,
    phrase_index,
    quality,
    resampling,
    simhash,
    url_filter,
    warc,
    wrappers,
)
from marginalia.llm.storage import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return register


_WORDS_SQL = (
    "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(
        LOWER_SQL.format("coalesce(text, '')")
    )
)


@query(f"""
with d as (select doc_id, {_WORDS_SQL} as ws from documents),
b as (select item_id, {_WORDS_SQL} as ws from benchmark),
windows as (
  select distinct item_id, w, array_to_string(ws[i:i + w - 1], ' ') as gram
  from (select item_id, ws, least(13, len(ws)) as w from b where len(ws) > 0) as bw,
    unnest(range(1, len(ws) - w + 2)) as t(i)),
widths as (select distinct w from windows),
grams as (
  select doc_id, i, w, array_to_string(ws[i:i + w - 1], ' ') as gram
  from d, widths, unnest(range(1, greatest(1, len(ws) - w + 2))) as t(i)),
hits as (select doc_id, item_id, i, w from grams join windows using (w, gram)),
hit_words as (
  select doc_id, count(distinct p) as n_hit from hits, unnest(range(i, i + w)) as t(p) group by doc_id),
hit_items as (
  select doc_id, count(*) as n_items, sha256(string_agg(name, ',' order by name)) as items_sha256
  from (select distinct doc_id, cast(item_id as varchar) as name from hits) as n group by doc_id)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join hit_words using (doc_id) left join hit_items using (doc_id)
""")
def op1_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query()
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _term_count(area: str, terms: tuple[str, ...]) -> str:
    return " + ".join(
        f"cast(regexp_matches({area}, '(^|[^a-z0-9]){re.escape(t)}([^a-z0-9]|$)') as int)" for t in terms
    )


def _rule_sql() -> str:
    rows = []
    for verdict, rule in url_filter.RULES:
        host, _, path = rule.partition("/")
        rows.append(f"('{verdict}', '{rule}', '{host}', '/{path}')")
    return ", ".join(rows)


_SOFT_ONLY = tuple(t for t in url_filter.SOFT if t not in url_filter.STRICT)


@query(f"""
with rules(verdict, rule, rule_host, rule_path) as (values {_rule_sql()}),
rests as (
  select *, strpos(url, '://') as cut_at, substr(url, strpos(url, '://') + 3) as rest from pages),
parts as (
  select page_id, url, {LOWER_SQL.format("url")} as low,
    case when cut_at > 0 then {LOWER_SQL.format("regexp_extract(rest, '^[^/?#]*')")} else '' end as host,
    case when cut_at > 0 then substr(regexp_extract(rest, '^[^?#]*'), 1 + length(regexp_extract(rest, '^[^/?#]*')))
      else '' end as path,
    case when cut_at > 0 then regexp_extract({LOWER_SQL.format("rest")}, '^[^?#]*')
      else regexp_extract({LOWER_SQL.format("url")}, '^[^?#]*') end as area
  from rests),
ruled as (
  select page_id, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
  from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by page_id),
counted as (
  select *, coalesce({_term_count("low", url_filter.STRICT)}, 0) as n_strict,
    coalesce({_term_count("area", _SOFT_ONLY)}, 0) as n_soft
  from parts)
select page_id, host, path, rule,
  coalesce(verdict, case when n_strict > 0 or n_soft >= {url_filter.SOFT_NEEDED} then 'block' else 'allow' end)
    as verdict, n_strict, n_soft
from counted left join ruled using (page_id)
""")
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


@query()
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.held_out("doc_id", 5, 0)
    dictionaries = language_id.learn(docs, ~out)
    return language_id.identify(docs, dictionaries).select(
        "doc_id", out.alias("held_out"), "lang_pred", "score", "margin", "rejected"
    )


@query()
def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.held_out("doc_id", 10, 0)
    return context_tree.score_texts(docs.withColumn("held_out", out), "held_out")


@query(f"""
with hashed as (
  select doc_id, sha256({LOWER_SQL.format("coalesce(text, '')")}) as text_sha256 from documents),
groups as (
  select text_sha256, max(doc_id) as keep_id, count(*) as group_size from hashed group by text_sha256)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256
from hashed join groups using (text_sha256)
""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_copies(table(spark, sf_dir, "documents"), hash_all=True)


@query()
def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query()
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        quality.held_out("doc_id", 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= quality.CUT_SCORE).cast("int").alias("predicted"),
    )


@query(r"""
with sized as (
  select doc_id, source, md5(coalesce(cast(doc_id as varchar), '')) as o,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size
  from documents),
sources as (
  select source, cast(sum(size) as bigint) as source_size from sized group by source),
weighted as (
  select *, [5, 2, 1][1 + kind] as w, [1.5, 1.0, 0.5][1 + kind]::double as w0, [-1.0, 0.0, 1.0][1 + kind]::double as slope
  from (select *, (row_number() over (order by source nulls last) - 1) % 3 as kind from sources) as k),
-- sources in the order in which their targets reach the bound; the first n are at it
filled as (
  select *, sum(source_size) over () as total, sum(w) over () as all_w,
    row_number() over (order by 3.0 * source_size / w, source) as n,
    sum(source_size) over (order by 3.0 * source_size / w, source) as bound_size,
    sum(w) over (order by 3.0 * source_size / w, source) as bound_w
  from weighted),
candidates as (
  select total - 3 * (bound_size - source_size) as rest, all_w - (bound_w - w) as rest_w
  from filled where w * (total - 3 * (bound_size - source_size)) <= 3 * source_size * (all_w - (bound_w - w))
  order by n limit 1),
targets as (
  select source, source_size, w0, slope, case when w * rest > 3 * source_size * rest_w then cast(3 * source_size as double)
    else cast(w * rest as double) / cast(rest_w as double) end as target
  from weighted, candidates),
placed as (
  select doc_id, size, source_size, target, w0, slope,
    coalesce(sum(size) over (partition by d.source order by o, size
      rows between unbounded preceding and 1 preceding), 0) as start,
    case when source_size = 0 then 0 else floor(target / source_size) end as passes
  from sized d join targets t on d.source is not distinct from t.source),
mixed as (
  select *, passes + case when start + size / 2.0 < target - passes * source_size then 1 else 0 end as copies,
    case when target = 0 then 0 else least((start + size / 2.0) / target, 1.0::double) end as due
  from placed)
-- The schedule's weight runs from w0 by its slope, over a whole of 1; the position is where its integral is due.
select doc_id, size, source_size, target, cast(size * copies as bigint) as taken,
  case when copies > 0 then round(least(2 * due / nullif(w0 + sqrt(greatest(w0 * w0 + 2 * slope * due, 0)), 0), 1.0::double), 9)
    end as position
from mixed
""")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    # In the order of the training positions at which documents are first met; those not taken come last.
    first = F.round(F.get("positions", F.lit(0)), 9)
    return planned.orderBy(first.asc_nulls_last(), "__order").select(
        F.col("__row.doc_id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.size("positions") * F.col("size")).cast("long").alias("taken"),
        first.alias("position"),
    )


# Five hexadecimal digits of SHA-1 are four digits of base32.
_BASE32_SQL = " || ".join(
    f"lpad(to_base(cast('0x' || substr(h, {at}, 5) as bigint), 32), 4, '0')" for at in range(1, 41, 5)
)


@query(f"""
with hashed as (
  select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as h from pages),
coded as (
  select page_id, octet_length(encode(payload)) as payload_bytes,
    translate({_BASE32_SQL},
      '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') as payload_digest
  from hashed),
firsts as (select *, min(page_id) over (partition by payload_digest) as first_id from coded)
select page_id, payload_bytes, payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id = first_id then null else first_id end as refers_to,
  replace(replace(url, chr(13), '%0D'), chr(10), '%0A') as request_uri, 3 as n_records
from firsts join pages using (page_id)
""")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.archived_captures(table(spark, sf_dir, "pages"))
    return captures.select(
        "page_id",
        F.col("page_bytes").alias("payload_bytes"),
        F.col("claimed_digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers_to_page").alias("refers_to"),
        F.col("request.target_uri").alias("request_uri"),
        (1 + F.col("request").isNotNull().cast("int") + F.col("metadata").isNotNull().cast("int")).alias("n_records"),
    )


# The CRC table by its rule; CRCs of distinct words, byte by byte.
@query(f"""
with crc_table as materialized (
  select list(v order by i) as t from (
    select i, list_reduce(list_prepend(i, range(8)),
      lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
    from range(256) as r(i)) as entries),
d as materialized (select row_number() over () as r, doc_id, {_WORDS_SQL} as ws from documents),
source_words as materialized (select r, unnest(ws) as w from d),
target_words as materialized (select unnest({_WORDS_SQL}) as w from benchmark),
places as materialized (
  select w, xor(list_reduce(
      list_prepend(4294967295, [cast('0x' || substr(h, 2 * k + 1, 2) as bigint) for k in range(len(h) // 2)]),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {resampling.BUCKETS} as bucket
  from (select w, hex(encode(w)) as h from (select w from source_words union select w from target_words) as u) as v,
    crc_table),
s as (select bucket, count(*) as n from source_words join places using (w) group by bucket),
t as (select bucket, count(*) as n from target_words join places using (w) group by bucket),
sums as (select (select count(*) from source_words) as all_s, (select count(*) from target_words) as all_t),
gains as (
  select bucket, cast(floor(1000 * ln(
      (cast(coalesce(t.n, 0) as double) + 1) * (cast(all_s as double) + {resampling.BUCKETS})
      / ((cast(coalesce(s.n, 0) as double) + 1) * (cast(all_t as double) + {resampling.BUCKETS})))) as bigint) as gain
  from range({resampling.BUCKETS}) as b(bucket) left join s using (bucket) left join t using (bucket), sums),
means as (
  select r, cast(floor(cast(sum(gain) as double) / count(*)) as bigint) as weight
  from source_words join places using (w) join gains using (bucket) group by r),
scored as (
  select doc_id, cast(len(ws) as bigint) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln(
      (cast('0x' || substr(sha256('{resampling.SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double)
      / 4294967296.0::double))) as bigint) as score
  from d left join means using (r)),
ranked as (
  select *, row_number() over (
      partition by n_features >= {resampling.LEAST_WORDS} order by score desc, doc_id nulls last) as n,
    count(*) over (partition by n_features >= {resampling.LEAST_WORDS}) as able
  from scored)
select doc_id, n_features, weight, score,
  case when n_features >= {resampling.LEAST_WORDS} and n <= {resampling.PERCENT} * able // 100 then n end as rank
from ranked
""")
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    planned = resampling.plan_sample(docs, target, carry=["doc_id"])
    return planned.select(F.col("__row.doc_id").alias("doc_id"), "n_features", "weight", "score", "rank")


_BITS_SQL = "case letter when 'A' then 1 when 'B' then 2 when 'C' then 4 when 'D' then 8 else 16 end"


@query(rf"""
with texts as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') as ws
  from documents),
marks as (
  select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
masks as (
  select part, cast(len(ws) < 50 as int) + 2 * cast(100 * len(list_distinct(ws)) < 65 * len(ws) as int)
    + 4 * cast(100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) as int)
    + 8 * cast(regexp_matches(t, '[#$%&*|]') as int)
    + 16 * cast(coalesce(doc_id > min(doc_id) over (partition by t), false) as int) as mask,
    coalesce(good, false) as good, coalesce(toxic, false) as toxic
  from texts left join marks using (doc_id)),
cells as (
  select part, mask, count(*) as n, count(*) filter (good) as n_good, count(*) filter (toxic) as n_toxic
  from masks group by part, mask),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as letter),
orders as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order
  from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5),
steps as (
  select filter_order, step, letter, {_BITS_SQL} as bit,
    coalesce(sum({_BITS_SQL}) over (partition by filter_order order by step
      rows between unbounded preceding and 1 preceding), 0)::int as applied
  from (select filter_order, cast(i as int) as step, substr(filter_order, i, 1) as letter
        from orders, range(1, 6) as r(i)) as s),
counted as (
  select part, filter_order, step, letter,
    cast(sum(case when mask & (applied | bit) = 0 then n else 0 end) as bigint) as kept,
    cast(sum(case when mask & applied = 0 and mask & bit != 0 then n else 0 end) as bigint) as removed,
    cast(sum(case when mask & applied != 0 and mask & bit != 0 then n else 0 end) as bigint) as redundant,
    cast(sum(case when mask = bit then n else 0 end) as bigint) as unique_fails,
    cast(sum(case when mask & applied = 0 and mask & bit != 0 then n_good else 0 end) as bigint) as good_lost,
    cast(sum(case when mask & applied = 0 and mask & bit != 0 then n_toxic else 0 end) as bigint) as toxic_lost
  from cells, steps group by part, filter_order, step, letter)
select *, cast(sum(removed) over (partition by part, letter) as bigint) as shapley from counted
""")
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
