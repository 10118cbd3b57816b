"""Repository paths and URLs as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.config import DEFAULT_BRANCH
from marginalia.functions.text import trim_space

SOURCE_HOST = "https://github.com"


def _segments(path: Column) -> Column:
    trimmed = F.transform(F.split(F.coalesce(path, F.lit("")), "/", -1), trim_space)
    return F.filter(trimmed, lambda s: s != "")


def _as_column(value: Column | str | None) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def normalize_path(path: Column) -> Column:
    """Trim the segments and drop empty ones; null when a segment is ``.`` or ``..``."""
    segments = _segments(path)
    relative = F.exists(segments, lambda s: s.isin(".", ".."))
    return F.when(~relative, F.array_join(segments, "/"))


def join_paths(*paths: Column | str | None) -> Column:
    """Join path parts; empty and null parts vanish, a relative segment makes the result null."""
    parts = [normalize_path(F.coalesce(_as_column(p).cast("string"), F.lit(""))) for p in paths]
    joined = F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "/")
    valid = parts[0].isNotNull()
    for part in parts[1:]:
        valid = valid & part.isNotNull()
    return F.when(valid, joined)


def encode_component(col: Column) -> Column:
    """Percent-encode as browsers encode a URL component."""
    encoded = F.url_encode(col)
    for found, wanted in (
        ("+", "%20"),
        ("%21", "!"),
        ("%27", "'"),
        ("%28", "("),
        ("%29", ")"),
        ("%7E", "~"),
    ):
        encoded = F.replace(encoded, F.lit(found), F.lit(wanted))
    return encoded


def encode_path(path: Column) -> Column:
    return F.array_join(F.transform(F.split(path, "/", -1), encode_component), "/")


def relative_path(base: Column | str, path: Column) -> Column:
    base = F.coalesce(_as_column(base), F.lit(""))
    prefix = F.when(base.endswith("/"), base).otherwise(F.concat(base, F.lit("/")))
    return F.when(
        (base != "") & F.startswith(path, prefix), F.substring(path, F.length(prefix) + 1, F.length(path))
    ).otherwise(path)


def parse_repo_url(url: Column) -> Column:
    """Struct (owner, repo, branch, path, error); bad URLs give nulls and an error text."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    segments = F.filter(F.split(F.try_parse_url(url, F.lit("PATH")), "/", -1), lambda s: s != "")
    error = (
        F.when(host.isNull() | (host == ""), F.lit("invalid url"))
        .when(~host.endswith("github.com"), F.lit("unsupported host"))
        .when(F.coalesce(F.size(segments), F.lit(0)) < 2, F.lit("owner and repository required"))
    )
    qualified = F.coalesce(F.get(segments, F.lit(2)).isin("tree", "blob"), F.lit(False))
    rest = F.slice(segments, F.when(qualified, 5).otherwise(3), F.greatest(F.size(segments), F.lit(0)))
    ok = error.isNull()
    return F.struct(
        F.when(ok, F.get(segments, F.lit(0))).alias("owner"),
        F.when(ok, F.regexp_replace(F.get(segments, F.lit(1)), "\\.git\\z", "")).alias("repo"),
        F.when(
            ok,
            F.when(qualified, F.coalesce(F.get(segments, F.lit(3)), F.lit(DEFAULT_BRANCH))).otherwise(
                F.lit(DEFAULT_BRANCH)
            ),
        ).alias("branch"),
        F.when(ok, normalize_path(F.array_join(rest, "/"))).alias("path"),
        error.alias("error"),
    )


def source_url(owner: Column, repo: Column, branch: Column | str, path: Column) -> Column:
    return F.concat(
        F.lit(f"{SOURCE_HOST}/"),
        owner,
        F.lit("/"),
        repo,
        F.lit("/blob/"),
        encode_component(_as_column(branch)),
        F.lit("/"),
        encode_path(path),
    )


def repo_file_url(
    repo_url: Column,
    branch: Column | str | None,
    directory: Column | str | None,
    filepath: Column,
) -> Column:
    """URL of a file of a configured repository; a given branch beats the one in the URL."""
    parsed = parse_repo_url(repo_url)
    return source_url(
        parsed["owner"],
        parsed["repo"],
        F.coalesce(_as_column(branch).cast("string"), parsed["branch"], F.lit(DEFAULT_BRANCH)),
        join_paths(parsed["path"], directory, filepath),
    )


def strip_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def repo_of_url(url: Column) -> Column:
    """``owner/repo`` of a source URL, null when it has none."""
    found = F.regexp_extract(url, "github\\.com/([^/]+/[^/]+)", 1)
    return F.when(found != "", found)


def repo_base_of_url(url: Column) -> Column:
    """``https://host/owner/repo/blob/<branch>/`` prefix of a source URL, null when it has none."""
    found = F.regexp_extract(url, "\\A(https://github\\.com/[^/]+/[^/]+/blob/[^/#]+/)", 1)
    return F.when(found != "", found)


def repo_base_url(repo_url: Column, branch: Column | str | None = None) -> Column:
    parsed = parse_repo_url(repo_url)
    chosen = F.coalesce(_as_column(branch).cast("string"), parsed["branch"])
    return F.concat(
        F.lit(f"{SOURCE_HOST}/"),
        parsed["owner"],
        F.lit("/"),
        parsed["repo"],
        F.lit("/blob/"),
        encode_component(chosen),
        F.lit("/"),
    )


# Languages of code files and their endings. A new language adds its endings here and its reader in
# ``operators.entities``.
CODE_ENDINGS: dict[str, tuple[str, ...]] = {"typescript": ("ts", "tsx"), "python": ("py",), "rust": ("rs",)}


def document_type(path: Column) -> Column:
    """Type of a collected file, null for files that are not collected."""
    lowered = F.lower(path)
    kind = F.when(lowered.endswith(".mdx"), F.lit("mdx"))
    for language, endings in CODE_ENDINGS.items():
        known = lowered.rlike(f"\\.(?:{'|'.join(endings)})\\z") & ~lowered.endswith(".d.ts")
        kind = kind.when(known, F.lit(language))
    return kind


def in_scope(path: Column, base: Column | str | None) -> Column:
    base = normalize_path(F.coalesce(_as_column(base).cast("string"), F.lit("")))
    return (base == "") | (path == base) | F.startswith(path, F.concat(base, F.lit("/")))


def is_excluded(path: Column, patterns: Column | Sequence[str]) -> Column:
    """True when any pattern hits: ``*x`` a path that ends with x, ``x*`` and ``x`` one that contains x.

    A pattern may also name a whole file or the beginning of a file name; both are contained in the
    path. A list becomes one regular expression, a column stays per row.
    """
    if isinstance(patterns, Column):
        inner = lambda p: F.regexp_replace(p, "\\A\\*|\\*\\z", "")
        return F.coalesce(
            F.exists(
                patterns,
                lambda p: F.when(
                    p.startswith("*"), F.endswith(path, F.substring(p, F.lit(2), F.length(p)))
                ).otherwise(F.contains(path, inner(p))),
            ),
            F.lit(False),
        )
    ends = [re.escape(p[1:]) for p in dict.fromkeys(patterns) if p.startswith("*")]
    inside = [re.escape(p.removesuffix("*")) for p in dict.fromkeys(patterns) if not p.startswith("*")]
    tests = ([f"(?:{'|'.join(ends)})\\z"] if ends else []) + inside
    return path.rlike("|".join(tests)) if tests else F.lit(False)


def is_included(path: Column, base: Column | str | None, directories: Column | Sequence[str]) -> Column:
    """True when the path is, or lies under, ``base/dir`` or ``dir`` for any directory."""
    if not isinstance(directories, Column):
        directories = F.array(*[F.lit(d) for d in directories])
    base = normalize_path(F.coalesce(_as_column(base).cast("string"), F.lit("")))
    clean = normalize_path(path)

    def under(prefix: Column) -> Column:
        return (clean == prefix) | F.startswith(clean, F.concat(prefix, F.lit("/")))

    def hit(directory: Column) -> Column:
        directory = normalize_path(directory)
        full = F.when(base == "", directory).otherwise(F.concat(base, F.lit("/"), directory))
        return under(full) | under(directory)

    return F.exists(directories, hit)


def classify_documents(df: DataFrame, path_col: str = "path") -> DataFrame:
    """Add ``type`` and keep only the files that are collected."""
    return df.withColumn("type", document_type(F.col(path_col))).filter(F.col("type").isNotNull())


def scope_filter(df: DataFrame, base: str, path_col: str = "path") -> DataFrame:
    return df.filter(in_scope(F.col(path_col), base))


def exclude_filter(
    df: DataFrame, patterns: Column | Sequence[str], path_col: str = "path"
) -> DataFrame:
    return df.filter(~is_excluded(F.col(path_col), patterns))


def include_filter(
    df: DataFrame, base: str, directories: Column | Sequence[str], path_col: str = "path"
) -> DataFrame:
    return df.filter(is_included(F.col(path_col), base, directories))
