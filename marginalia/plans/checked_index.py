"""Checked queries: postings that follow the store, searches that open few of them, whole texts as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import content_checksum
from marginalia.operators.keywords import build_postings, keyword_search, term_counts
from marginalia.plans.catalog import checked
from marginalia.plans.checked_search import _KEYWORD_SQL, _TOP_SQL, ALL_TERMS_SQL
from marginalia.plans.derived import POSTINGS_SQL, STORE_SQL, WORD, store, table, word_queries
from marginalia.session import ensure_checkpoint_dir
from marginalia.sources.postings import PostingIndex
from marginalia.sources.store import ChunkStore


def _new_store(spark: SparkSession, sf_dir: str, buckets: int = 8) -> ChunkStore:
    chunks = ChunkStore(spark, f"{ensure_checkpoint_dir(spark)}/indexed-{uuid.uuid4().hex}", buckets)
    chunks.write(store(spark, sf_dir))
    return chunks


# French documents are edited, Spanish ones deleted, German ones moved to another file.
_CHANGED_SQL = STORE_SQL.replace("store as (", "base as (", 1) + """,
store as (
  select id, case when contextual_text like 'fr---%' then content || ' (edited)' else content end as content,
    contextual_text, chunk_title from base where contextual_text not like 'es---%')
"""


@checked(
    f"""with {_CHANGED_SQL}, {POSTINGS_SQL}
    select term, count(*) as occurrences, count(distinct id) as chunks, round(sum(weight), 4) as weight,
      sum(position)::bigint as positions from postings group by term"""
)
def incremental_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the first state is brought in step with the changed one, segment upon segment."""
    chunks = _new_store(spark, sf_dir)
    index = PostingIndex(chunks, english=False, merge_at=2)
    index.refresh()
    of = lambda lang: F.col("contextual_text").startswith(f"{lang}---")

    def edited(rows: DataFrame) -> DataFrame:
        content = F.when(of("fr"), F.concat("content", F.lit(" (edited)"))).otherwise(F.col("content"))
        return rows.withColumn("content", content).withColumn("checksum", content_checksum(F.col("content")))

    def moved(rows: DataFrame) -> DataFrame:
        place = F.when(of("de"), F.concat(F.lit("moved/"), "filepath")).otherwise(F.col("filepath"))
        return rows.filter(~of("es")).withColumn("filepath", place)

    for languages, step in ((["fr"], edited), (["es", "de"], moved)):
        rows = chunks.read()
        state = step(rows)  # of an immutable version, so reading it again gives the same rows
        touched = F.substring("contextual_text", 1, 2).isin(languages)
        places = rows.filter(touched).select("filepath").unionByName(state.filter(touched).select("filepath"))
        chunks.write(state, chunks.buckets_of(places))
        index.refresh()
    return term_counts(index.postings(keep=("block",))).withColumn("weight", F.round("weight", 4))


@checked(f"with {_KEYWORD_SQL}, {ALL_TERMS_SQL} {_TOP_SQL}")
def pruned_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of keyword_all_terms out of the blocks of an index that can hold them."""
    index = PostingIndex(_new_store(spark, sf_dir), english=False)
    index.refresh()
    hits = index.search(word_queries(spark, sf_dir, "%s %s"), k=10).drop("posting_rows")
    return hits.withColumn("keyword_rank", F.round("keyword_rank", 6))


def _text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of each benchmark text, any of which may occur."""
    words = F.array_remove(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)), "or")
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.array_join(words, " or ").alias("query")
    )


@checked(
    f"""with {STORE_SQL}, {POSTINGS_SQL},
    asked as (select distinct item_id as query_id, unnest(regexp_extract_all(lower(text), '{WORD}')) as term from benchmark),
    ranked as (
      select query_id, id, round(sum(weight), 9) as rank from postings join asked using (term) where term <> 'or' group by 1, 2)
    {_TOP_SQL}"""
)
def keyword_whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark texts ask."""
    postings = build_postings(store(spark, sf_dir), english=False)
    hits = keyword_search(postings, _text_queries(spark, sf_dir), k=10)
    return hits.withColumn("keyword_rank", F.round("keyword_rank", 6))


# A phrase, or a word without another one. Where the word is part of the phrase, it is the shorter stretch.
@checked(
    f"""with {_KEYWORD_SQL},
    phrases as (
      select query_id, a.id, sum(2 / (1.0 / a.weight + 1.0 / b.weight)) as rank
      from words join postings a on a.term = t1 join postings b on b.term = t2 and b.id = a.id and b.position = a.position + 1
      group by 1, 2),
    singles as (
      select query_id, p.id, sum(weight) as rank from words join postings p on p.term = t3
      where not exists (select 1 from postings q where q.id = p.id and q.term = t4) group by 1, 2),
    ranked as (
      select query_id, id, round(case when s.rank is null then f.rank when f.rank is null or t3 in (t1, t2) then s.rank
        else f.rank + s.rank end, 9) as rank
      from phrases f full join singles s using (query_id, id) join words using (query_id))
    {_TOP_SQL}"""
)
def keyword_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = build_postings(store(spark, sf_dir), english=False, neighbours=True)
    hits = keyword_search(postings, word_queries(spark, sf_dir, '"%s %s" OR %s -%s'), k=10)
    return hits.withColumn("keyword_rank", F.round("keyword_rank", 6))
