"""Frames derived from the tables by a rule that Spark and SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.rows import spread
from marginalia.functions.text import content_checksum

ORG = "https://github.com/acme"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose rows are costly to process, spread over the cores when it is small."""
    return spread(table(spark, sf_dir, name))


# One markdown file per document: a title line, and before every further line a section without
# content and a quoted heading, so that sections roll forward and titles are cleaned.
SECTIONED_SQL = """
sectioned as (
  select doc_id, source || '/' || doc_id || '.mdx' as filepath,
    'title: "' || source || '"' || chr(10)
      || replace(text, chr(10), chr(10) || '## Next' || chr(10) || '## "Part"' || chr(10)) as content
  from documents)
"""


def sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    body = F.replace("text", F.lit("\n"), F.lit('\n## Next\n## "Part"\n'))
    return docs.select(
        "doc_id",
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".mdx")).alias("filepath"),
        F.concat(F.lit('title: "'), "source", F.lit('"\n'), body).alias("content"),
    )


# The stored chunks: one per document. Two groups are kept as an older version left them: the label
# of src1 is outdated, the German rows of src2 are parked.
STORE_SQL = f"""
store as (
  select doc_id as id, text as content, lang || '---' || text as contextual_text,
    case when source = 'src2' and lang = 'de' then '__moving__' || doc_id
         else source || '/' || doc_id || '.mdx' end as filepath,
    0 as chunk_id, source || ' ' || lang as chunk_title, sha256(text) as checksum,
    '{ORG}/' || source || '/blob/main/docs/' || doc_id || '.mdx' as github_url,
    'https://docs.acme.dev/' || source || '/' || doc_id as docs_url,
    'https://docs.acme.dev/' || source || '/' || doc_id as final_url,
    case when source = 'src1' then 'mdx' else 'doc' end as source_type
  from documents)
"""


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    number = F.col("doc_id").cast("string")
    none = lambda kind: F.lit(None).cast(kind)
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp")
    page = F.concat(F.lit("https://docs.acme.dev/"), "source", F.lit("/"), number)
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("content"),
        F.concat("lang", F.lit("---"), "text").alias("contextual_text"),
        none("array<float>").alias("embedding"),
        F.when((F.col("source") == "src2") & (F.col("lang") == "de"), F.concat(F.lit("__moving__"), number))
        .otherwise(F.concat("source", F.lit("/"), number, F.lit(".mdx")))
        .alias("filepath"),
        F.lit(0).alias("chunk_id"),
        F.concat_ws(" ", "source", "lang").alias("chunk_title"),
        content_checksum(F.col("text")).alias("checksum"),
        F.concat(F.lit(f"{ORG}/"), "source", F.lit("/blob/main/docs/"), number, F.lit(".mdx")).alias("github_url"),
        page.alias("docs_url"),
        page.alias("final_url"),
        F.when(F.col("source") == "src1", "mdx").otherwise("doc").alias("source_type"),
        none("string").alias("entity_type"),
        none("int").alias("start_line"),
        none("int").alias("end_line"),
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
    )


# The chunks of the next crawl: Spanish documents are gone, German ones moved to another folder,
# French ones edited, English ones as they were; the benchmark texts are new.
CRAWL_SQL = f"""
crawl as (
  select doc_id as seq, content, sha256(content) as checksum, filepath, 0 as chunk_id,
    'doc' as source_type, '{ORG}/' || source || '/blob/main/docs/' || doc_id || '.mdx' as github_url
  from (
    select doc_id, source, case when lang = 'fr' then text || ' (edited)' else text end as content,
      case when lang = 'de' then 'moved/' else '' end || source || '/' || doc_id || '.mdx' as filepath
    from documents where lang <> 'es')
  union all
  select 1000000000000 + item_id, text, sha256(text), 'bench/' || item_id || '.mdx', 0, 'doc',
    '{ORG}/bench/blob/main/docs/' || item_id || '.mdx'
  from benchmark)
"""


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("doc_id").cast("string")
    docs = (
        texts(spark, sf_dir)
        .filter(F.col("lang") != "es")
        .select(
            F.col("doc_id").alias("seq"),
            F.when(F.col("lang") == "fr", F.concat("text", F.lit(" (edited)"))).otherwise(F.col("text")).alias("content"),
            F.concat(
                F.when(F.col("lang") == "de", "moved/").otherwise(""), "source", F.lit("/"), number, F.lit(".mdx")
            ).alias("filepath"),
            F.concat(F.lit(f"{ORG}/"), "source", F.lit("/blob/main/docs/"), number, F.lit(".mdx")).alias("github_url"),
        )
    )
    item = F.col("item_id").cast("string")
    fresh = table(spark, sf_dir, "benchmark").select(
        (F.col("item_id") + F.lit(1_000_000_000_000)).alias("seq"),
        F.col("text").alias("content"),
        F.concat(F.lit("bench/"), item, F.lit(".mdx")).alias("filepath"),
        F.concat(F.lit(f"{ORG}/bench/blob/main/docs/"), item, F.lit(".mdx")).alias("github_url"),
    )
    return docs.unionByName(fresh).select(
        "seq",
        "content",
        content_checksum(F.col("content")).alias("checksum"),
        "filepath",
        F.lit(0).alias("chunk_id"),
        F.lit("doc").alias("source_type"),
        "github_url",
    )


# The configured repositories: that of every source but src9.
REPOS_SQL = f"""
repos as (
  select distinct '{ORG}/' || source as repo_url, '{ORG}/' || source || '/blob/main/' as repo_base,
    'acme/' || source as repo
  from documents where source <> 'src9')
"""


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "documents")
        .filter(F.col("source") != "src9")
        .select(F.concat(F.lit(f"{ORG}/"), "source").alias("repo_url"), F.lit("main").alias("branch"))
        .distinct()
    )


WORD = "[\\p{L}\\p{N}_]+"

# Hashed word vectors of (id, text) rows, as one row per non-zero slot.
def hashed_sql(name: str, relation: str, key: str, text: str) -> str:
    return f"""
{name}_counts as (
  select id, slot, count(*) as n from (
    select {key} as id,
      ('0x' || substr(md5(unnest(regexp_extract_all(lower({text}), '{WORD}'))), 1, 8))::bigint % 64 as slot
    from {relation}) group by all),
{name}_vectors as (
  select id, slot, (n / sqrt(sum(n * n) over (partition by id)))::float::double as v
  from {name}_counts)
"""


# Web-style queries of the first words, one per benchmark text.
WORDS_SQL = f"""
words as (
  select item_id as query_id, w[1] as t1, w[2] as t2, w[3] as t3, w[4] as t4
  from (select item_id, regexp_extract_all(lower(text), '{WORD}') as w from benchmark))
"""


def word_queries(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    """``form`` is a format string with places for the first words of each text, four at most."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    return (
        table(spark, sf_dir, "benchmark")
        .withColumn("_w", words)
        .select(
            F.col("item_id").alias("query_id"),
            F.format_string(form, *[F.get("_w", F.lit(i)) for i in range(4)]).alias("query"),
        )
    )


# Postings of the store without stop words and stems.
POSTINGS_SQL = f"""
fields as (
  select id, 0 as f, 1.0::double as weight, regexp_extract_all(lower(chunk_title), '{WORD}') as w from store
  union all select id, 1, 0.4::double, regexp_extract_all(lower(content), '{WORD}') from store
  union all select id, 2, 0.2::double, regexp_extract_all(lower(contextual_text), '{WORD}') from store),
shifted as (
  select *, coalesce(sum(len(w)) over (partition by id order by f rows between unbounded preceding and 1 preceding), 0) as shift_by
  from fields),
postings as (
  select id, unnest(w) as term, (shift_by + generate_subscripts(w, 1))::integer as position, weight from shifted)
"""
