"""Links of chunks: documentation URL, source URL, citation URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.config import DEFAULT_CONTENT_PATH
from marginalia.functions.paths import _as_column, encode_component, strip_fragment
from marginalia.functions.text import source_title, trim_space


def is_doc_path(path: Column) -> Column:
    return F.coalesce(F.lower(path).rlike("\\.mdx?\\z"), F.lit(False))


def heading_slug(title: Column) -> Column:
    """Anchor of a heading: lower case, letters, marks, digits, ``_`` and ``-`` kept, spaces to ``-``.
    Repeated headings get no counter: each call starts afresh."""
    lowered = F.lower(trim_space(F.coalesce(title, F.lit(""))))
    kept = F.regexp_replace(lowered, "[^\\p{IsAlphabetic}\\p{M}\\p{Nd}\\p{Pc}\\- ]", "")
    return F.replace(kept, F.lit(" "), F.lit("-"))


def append_slug(url: Column, slug: Column) -> Column:
    return F.when(
        (F.coalesce(slug, F.lit("")) != "") & ~F.contains(url, F.lit("#")),
        F.concat(url, F.lit("#"), slug),
    ).otherwise(url)


def docs_url(
    filepath: Column, base_url: Column | str | None, content_path: Column | str | None = None
) -> Column:
    """Page URL of a documentation file; null for other files and without a base URL."""
    base = _as_column(base_url).cast("string")
    prefix = F.concat(
        F.coalesce(_as_column(content_path).cast("string"), F.lit(DEFAULT_CONTENT_PATH)), F.lit("/")
    )
    inner = F.when(
        F.startswith(filepath, prefix),
        F.substring(filepath, F.length(prefix) + 1, F.length(filepath)),
    ).otherwise(filepath)
    page = F.regexp_replace(F.regexp_replace(inner, "(?i)\\.mdx?\\z", ""), "/index\\z", "")
    encoded = F.array_join(
        F.transform(F.filter(F.split(page, "/", -1), lambda s: s != ""), encode_component), "/"
    )
    root = F.regexp_replace(base, "/\\z", "")
    url = F.when(page == "", F.when(root == "", F.lit("/")).otherwise(root)).otherwise(
        F.concat(root, F.lit("/"), encoded)
    )
    return F.when(is_doc_path(filepath) & (F.coalesce(base, F.lit("")) != ""), url)


def resolve_links(
    df: DataFrame,
    base_url: Column | str | None = None,
    content_path: Column | str | None = None,
    filepath_col: str = "filepath",
    title_col: str = "chunk_title",
    source_url_col: str = "source_url",
) -> DataFrame:
    """Add github_url, docs_url and final_url. Docs prefer their page, code its source.

    The slug and the page are columns of their own on the way, so that no expression repeats them.
    """
    filepath = F.col(filepath_col)
    source, page, slug = F.col(source_url_col), F.col("_page"), F.col("_slug")
    final = F.when(is_doc_path(filepath), F.coalesce("docs_url", "github_url")).otherwise(
        F.coalesce("github_url", "docs_url")
    )
    return (
        df.withColumns(
            {
                "_title": source_title(F.col(title_col), filepath),
                "_page": docs_url(filepath, base_url, content_path),
            }
        )
        .withColumn("_slug", heading_slug(F.col("_title")))
        .withColumns(
            {"github_url": F.when(source != "", append_slug(source, slug)), "docs_url": append_slug(page, slug)}
        )
        .withColumn("final_url", final)
        .drop("_title", "_page", "_slug")
    )


def citation_url(
    filepath: Column,
    source_type: Column,
    github_url: Column,
    docs_url: Column,
    final_url: Column,
    start_line: Column,
    end_line: Column,
) -> Column:
    """URL shown with a citation: line anchor for code, the page for docs."""
    is_doc = F.coalesce(source_type.isin("doc", "mdx"), F.lit(False)) | is_doc_path(filepath)
    anchor = F.when(start_line == end_line, F.concat(F.lit("#L"), start_line)).otherwise(
        F.concat(F.lit("#L"), start_line, F.lit("-L"), end_line)
    )
    has_lines = start_line.isNotNull() & end_line.isNotNull() & (F.coalesce(github_url, F.lit("")) != "")
    return (
        F.when(~is_doc & has_lines, F.concat(strip_fragment(github_url), anchor))
        .when(is_doc & (F.coalesce(docs_url, F.lit("")) != ""), docs_url)
        .otherwise(F.coalesce(final_url, docs_url, github_url, filepath))
    )
