"""Merge ranked hits, show them, cite them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.config import SearchDefaults
from marginalia.functions.links import citation_url
from marginalia.functions.text import one_decimal

NO_MATCH_TEXT = "No matching documentation found."


def hybrid_search(
    vector_hits: DataFrame, keyword_hits: DataFrame, k: int | Column | None = None
) -> DataFrame:
    """Union of both hit lists per query, best similarity first, then keyword rank.

    Rows without a similarity come after all rows with one, so keyword-only hits show up only when
    fewer than k vectors pass the threshold. A hit is a stored chunk, so the merge key is its id.
    """
    limit = k if isinstance(k, Column) else F.lit(k if k is not None else SearchDefaults().match_count)
    merged = vector_hits.select("query_id", "id", "similarity", "vector_rank").join(
        keyword_hits.select("query_id", "id", "keyword_rank", "keyword_order"),
        ["query_id", "id"],
        "full_outer",
    )
    order = Window.partitionBy("query_id").orderBy(
        F.desc_nulls_last("similarity"),
        F.desc_nulls_last("keyword_rank"),
        F.asc_nulls_last("vector_rank"),
        F.asc_nulls_last("keyword_order"),
    )
    return (
        merged.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .select("query_id", "rank", "id", "similarity", "keyword_rank")
    )


def with_chunks(hits: DataFrame, store: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Attach stored columns to ranked hits; the vectors stay where they are."""
    columns = columns or [c for c in store.columns if c not in ("id", "embedding")]
    return hits.join(store.select("id", *columns), "id")


def format_matches(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """One text per query: a numbered list of its hits, or a fixed sentence.

    ``hits`` has query_id, rank, chunk_title, similarity, chunk_content, github_url, docs_url.
    """

    def line(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"   {label}: "), value, F.lit("\n"))).otherwise("")

    block = F.concat(
        F.col("rank").cast("string"),
        F.lit(". "),
        F.coalesce("chunk_title", F.lit("")),
        F.lit("\n"),
        F.when(
            F.col("similarity").isNotNull(),
            F.concat(F.lit("   Similarity: "), one_decimal(F.col("similarity") * 100), F.lit("%\n")),
        ).otherwise(""),
        line("Content", F.col("chunk_content")),
        line("GitHub", F.col("github_url")),
        line("Docs", F.col("docs_url")),
    )
    # At most k hits per query.
    texts = hits.groupBy("query_id").agg(
        F.count("*").alias("_count"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", block.alias("text")))), lambda h: h["text"]
            ),
            "\n",
        ).alias("_text"),
    )
    found = F.concat(
        F.lit("Found "),
        F.col("_count").cast("string"),
        F.when(F.col("_count") == 1, F.lit(" matching document:\n\n")).otherwise(F.lit(" matching documents:\n\n")),
        F.col("_text"),
    )
    return queries.select("query_id").join(texts, "query_id", "left").select(
        "query_id",
        F.when(F.col("_count").isNull(), F.lit(NO_MATCH_TEXT)).otherwise(F.rtrim(F.regexp_replace(found, "\\n+\\z", ""))).alias("text"),
    )


def build_sources(hits: DataFrame) -> DataFrame:
    """Citation rows of hits: the URL to show replaces ``final_url``."""
    url = citation_url(
        *[F.col(c) for c in ("filepath", "source_type", "github_url", "docs_url", "final_url", "start_line", "end_line")]
    )
    return hits.withColumn("final_url", url).select(
        "query_id",
        "rank",
        "filepath",
        "chunk_title",
        "github_url",
        "docs_url",
        "final_url",
        "entity_type",
        "start_line",
        "end_line",
    )


def map_cited_sources(cited: DataFrame, hits: DataFrame) -> DataFrame:
    """The hit each cited (filepath, chunk_title) stands for.

    Per citation (query_id, cite_no): the first hit of the path with the same title in any case,
    else the first hit of the path; citations of other paths are dropped.
    """
    same = F.coalesce(F.lower("cited_title") == F.lower("chunk_title"), F.lit(False))
    best = Window.partitionBy("query_id", "cite_no").orderBy(F.desc("_same"), F.asc("rank"))
    return (
        cited.select("query_id", "cite_no", "filepath", F.col("chunk_title").alias("cited_title"))
        .join(hits, ["query_id", "filepath"])
        .withColumn("_same", same)
        .withColumn("_n", F.row_number().over(best))
        .filter(F.col("_n") == 1)
        .drop("_n", "_same", "cited_title")
    )
