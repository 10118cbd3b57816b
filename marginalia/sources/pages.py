"""Documentation pages: text of a page, export of all pages, search over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import trim_space
from marginalia.operators.keywords import build_postings, build_vocabulary, keyword_search

PAGE_FIELDS = (("title", 1.0), ("text", 0.4))
# Character entities that pages use.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def _plain(markup: Column) -> Column:
    text = F.regexp_replace(markup, "<[^>]*>", " ")
    for entity, character in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return trim_space(F.regexp_replace(text, "\\s+", " "))


def page_title(html: Column) -> Column:
    return _plain(F.regexp_extract(html, "(?i)<title>([^<]*)</title>", 1))


def page_text(html: Column) -> Column:
    body = F.regexp_replace(html, "(?is)<(script|style|head)\\b.*?</\\1>|<!--.*?-->", " ")
    return _plain(body)


def page_slug(url: Column) -> Column:
    """Path of a page URL without query, fragment and outer slashes."""
    return F.regexp_replace(F.regexp_extract(url, "\\A[a-z]+://[^/?#]*([^?#]*)", 1), "\\A/+|/+\\z", "")


def read_pages(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, slug, title, text) of a table of raw pages."""
    return pages.select(
        "page_id",
        "url",
        page_slug(F.col("url")).alias("slug"),
        page_title(F.col("html")).alias("title"),
        page_text(F.col("html")).alias("text"),
    )


def page_blocks(pages: DataFrame) -> DataFrame:
    """Markdown block of each page: its title as a heading and its text."""
    return pages.withColumn("block", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("text")))


def page_by_slug(pages: DataFrame, slug: str) -> DataFrame:
    return page_blocks(pages.filter(F.col("slug") == slug))


def export_pages(pages: DataFrame, path: str, order_col: str = "slug") -> None:
    """Write all blocks as text files that, read in name order, are the pages in order.

    The range partitions are sorted each on its own, so a large site is written in parallel and is
    never one string.
    """
    ordered = page_blocks(pages).repartitionByRange(order_col).sortWithinPartitions(order_col)
    ordered.select(F.concat("block", F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def page_search(pages: DataFrame, queries: DataFrame, k: int = 10, english: bool = True) -> DataFrame:
    """Full-text search over pages: rows (query_id, id, keyword_rank, keyword_order)."""
    postings = build_postings(pages, english, PAGE_FIELDS, id_col="page_id")
    return keyword_search(postings, queries, k, build_vocabulary(postings) if english else None)
