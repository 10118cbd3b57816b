"""Checked queries: sections, splitting, line work, page texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import slice_lines
from marginalia.functions.tokens import estimate_tokens
from marginalia.operators.numbered import parse_numbered
from marginalia.operators.sections import chunk_sections
from marginalia.operators.split import chunk_documents, enforce_token_limit, hard_pieces
from marginalia.plans.catalog import checked
from marginalia.plans.derived import SECTIONED_SQL, sectioned, table, texts
from marginalia.sources.pages import page_blocks, page_by_slug, read_pages

_SPACE = "[\\s\\x{0B}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"

# Sections by line: a running count of headings, then of headings whose section before had content.
_SECTIONS_SQL = f"""
{SECTIONED_SQL},
split_lines as (
  select doc_id, filepath, generate_subscripts(l, 1) as n, unnest(l) as raw
  from (select *, string_split(content, chr(10)) as l from sectioned)),
lines as (
  select doc_id, filepath, n, regexp_replace(raw, '^{_SPACE}+|{_SPACE}+$', '', 'g') as line from split_lines),
kinds as (
  select *, regexp_matches(line, '^##({_SPACE}|$)') and not suffix(line, '[!toc]') as heading from lines),
marked as (
  select *, not heading and prefix(line, 'title') as front, not heading and not prefix(line, 'title') and line <> '' as body,
    sum(heading::int) over (partition by filepath order by n) as segment
  from kinds),
segments as (
  select filepath, segment, bool_or(body) as full_ from marked group by all),
numbered as (
  select *, coalesce(sum(full_::int) over (partition by filepath order by segment rows between unbounded preceding and 1 preceding), 0)::integer as chunk_id
  from segments),
titled as (
  select m.*, s.chunk_id, case when heading then trim(regexp_replace(line, '^#+\\s*', ''))
      when front then case when regexp_matches(line, 'title\\s*:\\s*(.+)') then regexp_extract(line, 'title\\s*:\\s*(.+)', 1) else 'Intro' end end as raw_title
  from marked m join numbered s using (filepath, segment)),
sections as (
  select filepath, chunk_id, string_agg(line, chr(10) order by n) as chunk_content,
    coalesce(nullif(regexp_replace(arg_max(raw_title, n) filter (where raw_title is not null), '^"(.*)"$', '\\1'), ''), 'Intro') as chunk_title
  from titled group by all having bool_or(body))
"""


@checked(f"with {_SECTIONS_SQL} select filepath, chunk_id, chunk_title, chunk_content, sha256(chunk_content) as checksum from sections")
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_sections(sectioned(spark, sf_dir).drop("doc_id"))


@checked(
    f"""with {_SECTIONS_SQL} select chunk_title, count(*) as chunks, count(distinct filepath) as files,
      sum(length(chunk_content))::bigint as characters from sections group by 1"""
)
def section_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        chunk_sections(sectioned(spark, sf_dir).drop("doc_id"))
        .groupBy("chunk_title")
        .agg(
            F.count("*").alias("chunks"),
            F.count_distinct("filepath").alias("files"),
            F.sum(F.length("chunk_content")).alias("characters"),
        )
    )


LIMIT = 60

# Greedy packing as a walk over the lines of all texts at once: one step per line number. A relation
# ``texts`` gives key, chunk_title, text, the token limit ``total`` and the budget of a part ``lim``.
PACK_SQL = """
oversized as (select key, text, lim from texts where ceil(length(text) / 4.0) > total),
text_lines as (
  select key, lim, generate_subscripts(l, 1) as n, unnest(l) as line
  from (select key, lim, string_split(text, chr(10)) as l from oversized)),
sized as (
  select *, ceil(length(line) / 4.0)::bigint as tokens, not regexp_matches(line, '[^\\s]') as blank from text_lines),
walk as (
  select key, n, case when tokens > lim then 1 when blank then 0 else 1 end as part,
    case when tokens > lim or blank then 0 else tokens end as used,
    (tokens <= lim and not blank) as open, (tokens > lim or not blank) as kept, tokens > lim as hard
  from sized where n = 1
  union all
  select s.key, s.n,
    case when s.tokens > s.lim then w.part + 1 when not w.open and s.blank then w.part when not w.open then w.part + 1
      when w.used + s.tokens + 1 > s.lim then w.part + 1 else w.part end,
    case when s.tokens > s.lim then 0 when not w.open and s.blank then 0 when not w.open then s.tokens
      when w.used + s.tokens + 1 > s.lim then s.tokens else w.used + s.tokens + 1 end,
    case when s.tokens > s.lim then false when not w.open and s.blank then false else true end,
    case when s.tokens > s.lim then true when not w.open and s.blank then false else true end,
    s.tokens > s.lim
  from walk w join sized s on s.key = w.key and s.n = w.n + 1),
packed as (
  select key, part, any_value(lim) as lim, bool_or(hard) as hard, string_agg(line, chr(10) order by n) as text,
    min(n) - 1 as first, max(n) - 1 as last
  from walk join sized using (key, n) where kept group by key, part),
pieces as (
  select key, part, 0 as piece, text, first, last from packed where not hard
  union all
  select key, part, piece, substr(text, piece * lim * 4 + 1, lim * 4), first, last from (
    select *, unnest(range(0, ceil(length(text) / (lim * 4.0))::bigint)) as piece from packed where hard)),
parts as (
  select key, (row_number() over (partition by key order by part, piece) - 1) as part, text, first, last
  from pieces where regexp_matches(text, '[^\\s]'))
"""


@checked(
    f"""with recursive {_SECTIONS_SQL}, texts as (select {{'f': filepath, 'c': chunk_id}} as key, chunk_title, chunk_content as text, {LIMIT} as lim, {LIMIT} as total from sections),
    {PACK_SQL},
    rows_ as (
      select t.key, t.chunk_title || '_' || (p.part + 1) as chunk_title, p.part, p.text from texts t join parts p using (key)
      union all select key, chunk_title, 0, text from texts where ceil(length(text) / 4.0) <= {LIMIT})
    select key.f as filepath, (row_number() over (partition by key.f order by key.c, part) - 1)::integer as chunk_id,
      chunk_title, text as chunk_content, sha256(text) as checksum from rows_"""
)
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(sectioned(spark, sf_dir).drop("doc_id"), LIMIT)


@checked(
    f"""with recursive texts as (select doc_id as key, source as chunk_title, text, {LIMIT} as lim, {LIMIT} as total from documents), {PACK_SQL}
    select key as doc_id, part::integer as chunk_id, t.chunk_title || '_' || (part + 1) as chunk_title, p.text as chunk_content
    from parts p join texts t using (key)
    union all select key, 0, chunk_title, text from texts where ceil(length(text) / 4.0) <= {LIMIT}"""
)
def split_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = texts(spark, sf_dir).select(
        "doc_id",
        F.lit(0).alias("chunk_id"),
        F.col("source").alias("chunk_title"),
        F.col("text").alias("chunk_content"),
        F.lit("").alias("checksum"),
    )
    return enforce_token_limit(chunks, LIMIT, key="doc_id").drop("checksum")


@checked("select doc_id, ceil(length(text) / 4.0)::integer as tokens from documents where ceil(length(text) / 4.0) > 1000")
def oversized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = estimate_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", tokens.alias("tokens")).filter(F.col("tokens") > 1000)


@checked(
    """select doc_id, piece::integer as piece, substr(text, piece * 400 + 1, 400) as text
    from (select *, unnest(range(0, ceil(length(text) / 400.0)::bigint)) as piece from documents)
    where regexp_matches(substr(text, piece * 400 + 1, 400), '[^\\s]')"""
)
def hard_split_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Blank pieces keep no number, so the number is taken from the text's own position.
    docs = texts(spark, sf_dir).withColumn("_p", hard_pieces(F.col("text"), F.lit(100)))
    return docs.select("doc_id", F.posexplode("_p").alias("piece", "text"))


@checked(
    """select doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) as excerpt from documents"""
)
def line_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", slice_lines(F.col("text"), F.lit(2), F.lit(4)).alias("excerpt")
    )


# Answers as numbered lists: every line of a document becomes an item; for German documents one item
# is missing, for Spanish ones nothing is numbered and blank lines separate blocks.
@checked(
    """with docs as (
      select doc_id, lang, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as l from documents),
    n as (select *, len(l) as c from docs where len(l) > 0),
    joined as (select *, array_to_string(list_transform(l, lambda x, i: i || '. ' || x), chr(10)) as listed from n)
    select doc_id, c::integer as expected, case
        when lang = 'es' then array_to_string(l, '|')
        when lang = 'de' then array_to_string(list_transform(range(0, c + 1), lambda x: trim(listed)), '|')
        else array_to_string(l, '|') end as items
    from joined"""
)
def numbered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(
        F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: x != ""
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", lines.alias("l")).filter(F.size("l") > 0)
    numbered = F.array_join(
        F.transform("l", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n"
    )
    response = F.when(F.col("lang") == "es", F.array_join("l", "\n\n")).otherwise(numbered)
    expected = F.size("l") + F.when(F.col("lang") == "de", 1).otherwise(0)
    return docs.select(
        "doc_id",
        F.size("l").alias("expected"),
        F.array_join(parse_numbered(response, expected), "|").alias("items"),
    )


_PLAIN = """trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))"""
PAGES_SQL = f"""
read_pages as (
  select page_id, url, trim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') as slug,
    {_PLAIN.format("regexp_extract(html, '(?i)<title>([^<]*)</title>', 1)")} as title,
    {_PLAIN.format("regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<head>.*?</head>|<!--.*?-->', ' ', 'g')")} as text
  from pages)
"""


@checked(f"with {PAGES_SQL} select page_id, slug, '# ' || title || chr(10) || chr(10) || text as block from read_pages")
def page_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_blocks(read_pages(table(spark, sf_dir, "pages"))).select("page_id", "slug", "block")


@checked(
    f"""with {PAGES_SQL}, wanted as (select slug from read_pages order by page_id limit 1)
    select page_id, '# ' || title || chr(10) || chr(10) || text as block from read_pages where slug = (select slug from wanted)"""
)
def page_of_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_pages(table(spark, sf_dir, "pages"))
    slug = pages.select(F.min_by("slug", "page_id")).first()[0]
    return page_by_slug(pages, slug).select("page_id", "block")
