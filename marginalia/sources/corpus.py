"""Corpora: files or tables of (path, content) with the repository they belong to."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.config import DEFAULT_BRANCH, DEFAULT_EXCLUDE_PATTERNS
from marginalia.functions.paths import (
    CODE_ENDINGS,
    document_type,
    in_scope,
    is_excluded,
    is_included,
    join_paths,
    parse_repo_url,
    relative_path,
    source_url,
)
from marginalia.schema import REPOS

def file_glob() -> str:
    """Files of the known types, in any spelling of their endings."""
    endings = ["mdx", *(e for own in CODE_ENDINGS.values() for e in own)]
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in ending) for ending in endings) + "}"


def repos_table(
    spark: SparkSession,
    docs: Iterable[dict] | None = None,
    code: Iterable[dict] | None = None,
    docs_url: str | None = None,
    code_url: str | None = None,
    main_url: str | None = None,
    branch: str | None = DEFAULT_BRANCH,
    directory: str | None = None,
    include_directories: Sequence[str] | None = None,
) -> DataFrame:
    """Configured repositories, one row per repository and kind (docs or code).

    Each kind takes its list, else its single URL, else the main URL. Directory and include
    directories of a repository beat the common ones.
    """
    rows = []
    for kind, listed, single in (("docs", docs, docs_url), ("code", code, code_url)):
        listed = list(listed or [])
        if not listed:
            listed = [{"repo_url": url} for url in (single or main_url,) if url]
        for repo in listed:
            rows.append(
                (
                    repo["repo_url"],
                    kind,
                    repo.get("directory") or directory,
                    repo.get("include_directories") or include_directories,
                    repo.get("exclude_patterns"),
                    repo.get("base_url"),
                    repo.get("content_path"),
                    repo.get("branch") or branch,
                )
            )
    if not rows:
        raise ValueError("at least one repository is required")
    return spark.createDataFrame(rows, REPOS)


def read_files(
    spark: SparkSession,
    root: str,
    repo_url: str | None = None,
    keep: Callable[[Column], Column] | None = None,
    skip_unreadable: bool = False,
) -> DataFrame:
    """Files below a directory as (repo_url, path, content, size); other types are not opened.

    ``keep`` judges the path below the directory. It is applied to the listed names, before files
    are dealt out to tasks, so a file that it drops is never opened. With ``skip_unreadable`` a file that
    cannot be read gives no row instead of failing the job.
    """
    root = root.rstrip("/")
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", file_glob())
        .option("ignoreMissingFiles", "true")
        .option("ignoreCorruptFiles", str(skip_unreadable).lower())
        .load(root)
    )
    # File URLs carry a scheme that the given root may not have.
    below = f"\\A(?:[a-z0-9]+:)?/*{re.escape(root.split(':', 1)[-1].lstrip('/'))}/"
    if keep is not None:
        # The one column that prunes the listing; it is percent-encoded, where a plus sign is one.
        listed = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        files = files.filter(keep(F.regexp_replace(listed, below, "")))
    return files.select(
        F.lit(repo_url).alias("repo_url"),
        F.regexp_replace("path", below, "").alias("path"),
        F.decode("content", "UTF-8").alias("content"),
        F.col("length").alias("size"),
    )


#: Configured repositories up to this number are sent to all tasks; more are joined by their URL.
MOST_SENT_REPOS = 50_000


def _sent(repos: DataFrame) -> DataFrame:
    """``repos`` as a broadcast side, if its size allows: the other side holds the contents."""
    return F.broadcast(repos) if repos.limit(MOST_SENT_REPOS + 1).count() <= MOST_SENT_REPOS else repos


def _scopes(repos: DataFrame) -> DataFrame:
    parsed = parse_repo_url(F.col("repo_url"))
    return (
        repos.withColumn("_repo", parsed)
        .withColumn("scope", join_paths(F.col("_repo.path"), F.coalesce("directory", F.lit(""))))
        .withColumn("_branch", F.coalesce("branch", F.col("_repo.branch")))
    )


def _is_kept(
    path: Column,
    kind: Column,
    scope: Column,
    own_excludes: Column,
    include_directories: Column,
    exclude_patterns: Sequence[str],
) -> Column:
    """Whether a path of a docs or code repository belongs to the corpus."""
    excluded = is_excluded(path, list(exclude_patterns)) | is_excluded(path, own_excludes)
    included = (F.coalesce(F.size(include_directories), F.lit(0)) < 1) | is_included(path, scope, include_directories)
    return in_scope(path, scope) & ((kind != "code") | (~excluded & included))


def _kind(path: Column) -> Column:
    return F.when(document_type(path) == "mdx", "docs").when(document_type(path).isNotNull(), "code")


def scan_corpus(
    files: DataFrame,
    repos: DataFrame,
    exclude_patterns: Sequence[str] = DEFAULT_EXCLUDE_PATTERNS,
) -> DataFrame:
    """Documents of the configured repositories out of a table (repo_url, path, content).

    Docs repositories give ``.mdx`` files, code repositories the code types. Code paths also pass
    the exclude patterns (common ones and the repository's own) and the include directories. All of
    it is decided on the path; ``scan_repositories`` does so before a file is opened.
    """
    typed = files.withColumn("type", document_type(F.col("path"))).filter(F.col("type").isNotNull())
    typed = typed.withColumn("kind", _kind(F.col("path")))
    scoped = _sent(_scopes(repos).filter(F.col("_repo.error").isNull()))
    own = F.coalesce("exclude_patterns", F.array().cast("array<string>"))
    kept = typed.join(scoped, ["repo_url", "kind"]).filter(
        _is_kept(F.col("path"), F.col("kind"), F.col("scope"), own, F.col("include_directories"), exclude_patterns)
    )
    size = F.col("size") if "size" in files.columns else F.octet_length("content").cast("long")
    return kept.select(
        "type",
        "path",
        relative_path(F.col("scope"), F.col("path")).alias("relative_path"),
        "content",
        F.sha1(F.encode("content", "UTF-8")).alias("sha"),
        size.alias("size"),
        source_url(F.col("_repo.owner"), F.col("_repo.repo"), F.col("_branch"), F.col("path")).alias("source_url"),
        "repo_url",
        "base_url",
        "content_path",
    )


def skipped_repos(repos: DataFrame) -> DataFrame:
    """(repo_url, kind, error): configured repositories that no scan can read, and why."""
    error = parse_repo_url(F.col("repo_url"))["error"]
    return repos.select("repo_url", "kind", error.alias("error")).filter(F.col("error").isNotNull()).distinct()


@dataclass(frozen=True)
class Scan:
    """corpus: the documents of all repositories that could be listed. listed: (repo_url, path, size) of
    the files that belong to them, none of which is opened for it. failed: (repo_url, error) of the
    repositories that could not be listed, and why."""

    corpus: DataFrame
    listed: DataFrame
    failed: DataFrame

    def status(self, corpus: DataFrame | None = None) -> DataFrame:
        """One row per repository: repo_url, readable, files, unread and error. ``corpus`` is the scanned
        corpus where it is stored already, so that the files are not read again."""
        read = (self.corpus if corpus is None else corpus).select("repo_url", "path").distinct()
        missing = self.listed.join(read.withColumn("_read", F.lit(1)), ["repo_url", "path"], "left")
        counted = missing.groupBy("repo_url").agg(
            F.count("*").alias("files"), F.count_if(F.col("_read").isNull()).alias("unread"), F.min(F.when(F.col("_read").isNull(), F.col("path"))).alias("_first")
        )
        error = F.when(F.col("unread") > 0, F.concat(F.lit("cannot be read: "), F.col("_first")))
        none = F.lit(None).cast("long")
        return counted.select("repo_url", (F.col("unread") == 0).alias("readable"), "files", "unread", error.alias("error")).unionByName(
            self.failed.select("repo_url", F.lit(False).alias("readable"), none.alias("files"), none.alias("unread"), "error")
        )


def scan_repositories(
    spark: SparkSession,
    folders: Mapping[str, str],
    repos: DataFrame,
    exclude_patterns: Sequence[str] = DEFAULT_EXCLUDE_PATTERNS,
) -> Scan:
    """Scan the configured repositories, each in its folder (repository URL to directory).

    Only files that belong to the corpus are opened. A repository whose URL or folder is wrong is left out and
    reported, as are files that cannot be read; the others give their documents. Repositories are a
    configuration: the driver lists them one after the other.
    """
    configured: dict[str, list] = {}
    for row in _scopes(repos).select("repo_url", "kind", "scope", "exclude_patterns", "include_directories", "_repo.error").collect():
        configured.setdefault(row["repo_url"], []).append(row)
    files, listed, failed = [], [], []
    for url, rows in configured.items():
        error = next((row["error"] for row in rows if row["error"]), None)
        if error is None and url not in folders:
            error = "no folder is given"
        if error is None:
            try:
                keep = partial(_kept_of_repository, rows=rows, exclude_patterns=tuple(exclude_patterns))
                found = read_files(spark, folders[url], url, keep, skip_unreadable=True)
                files.append(found)
                listed.append(found.select("repo_url", "path", "size"))
                continue
            except (PySparkException, Py4JJavaError) as caught:
                error = str(getattr(caught, "java_exception", caught)).strip().splitlines()[0]
        failed.append((url, error))
    none = spark.createDataFrame([], "repo_url string, path string, content string, size long")
    every = union_repos(none, *files)
    names = union_repos(none.drop("content"), *listed)
    return Scan(scan_corpus(every, repos, exclude_patterns), names, spark.createDataFrame(failed, "repo_url string, error string"))


def _kept_of_repository(path: Column, rows: Sequence, exclude_patterns: Sequence[str]) -> Column:
    """Whether a path belongs to one of the kinds that a repository is configured for."""
    kept = F.lit(False)
    for row in rows:
        texts = lambda values: F.array(*[F.lit(v) for v in values or []]).cast("array<string>")
        kind = _kind(path)
        own = _is_kept(
            path, kind, F.lit(row["scope"]), texts(row["exclude_patterns"]), texts(row["include_directories"]), exclude_patterns
        )
        kept = kept | (F.coalesce(kind == row["kind"], F.lit(False)) & own)
    return kept


def union_repos(*corpora: DataFrame) -> DataFrame:
    """All scanned documents in one table."""
    result = corpora[0]
    for other in corpora[1:]:
        result = result.unionByName(other, allowMissingColumns=True)
    return result


def save_snapshot(corpus: DataFrame, path: str) -> None:
    """Replace the snapshot of the scanned documents, partitioned by type."""
    corpus.write.mode("overwrite").partitionBy("type").parquet(path)
