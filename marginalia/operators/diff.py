"""Compare the wanted chunks with the stored ones, by content checksum.

All joins here use narrow columns; contents and vectors are never part of a diff. A checksum that
holds a large share of the rows is reduced on the map side before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.config import MOVING_PREFIX
from marginalia.functions.paths import (
    parse_repo_url,
    repo_base_of_url,
    repo_base_url,
    repo_of_url,
    strip_fragment,
)
from marginalia.functions.rows import one_row
from marginalia.functions.text import normalize_source_type

LOCATION = ("filepath", "chunk_id")


def is_moving(filepath: Column) -> Column:
    return filepath.startswith(MOVING_PREFIX)


def build_target(chunks: DataFrame, order: Sequence[str] = ("seq", "chunk_id")) -> DataFrame:
    """One row per checksum: the location of its last occurrence, the order of its first.

    ``order`` names the columns that order the chunks of a run; they must be unique per chunk.
    """
    seq = F.struct(*order)
    at = F.struct("filepath", "chunk_id", "source_type", "github_url", seq.alias("last_seq"))
    return (
        chunks.groupBy("checksum")
        .agg(F.max_by(at, seq).alias("at"), F.min(seq).alias("first_seq"))
        .select("checksum", "at.*", "first_seq")
    )


def lookup_by_checksum(target: DataFrame, store: DataFrame) -> DataFrame:
    """Stored rows whose checksum is wanted (id, checksum, filepath, chunk_id, source_type)."""
    narrow = store.select("id", "checksum", "filepath", "chunk_id", "source_type")
    return narrow.join(target.select("checksum"), "checksum", "left_semi")


def classify_chunks(target: DataFrame, store: DataFrame) -> DataFrame:
    """Add ``existing_id`` and ``action`` (unchanged, moved, new) to the target.

    A stored row in place is unchanged, or moved when only its type label is outdated; else any
    stored row of the checksum is reused, parked ones first, then the smallest id. Of several
    targets for one location only the first counts.
    """
    first = Window.partitionBy("filepath", "chunk_id", "source_type").orderBy("first_seq")
    wanted = (
        target.withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") == 1)
        .drop("_n")
        .withColumn("_type", normalize_source_type(F.col("source_type")))
    )
    stored = store.select("id", "checksum", "filepath", "chunk_id", "source_type")
    moving = is_moving(F.col("filepath"))
    in_place = stored.filter(~moving).select(
        "checksum",
        "filepath",
        "chunk_id",
        normalize_source_type(F.col("source_type")).alias("_type"),
        F.col("id").alias("_in_place"),
        F.col("source_type").alias("_stored_type"),
    )
    reusable = stored.groupBy("checksum").agg(
        F.min(F.when(moving, F.col("id"))).alias("_parked"), F.min("id").alias("_any")
    )
    label_ok = F.col("_stored_type") == F.col("source_type")
    existing = F.coalesce("_in_place", "_parked", "_any")
    return (
        wanted.join(in_place, ["checksum", "filepath", "chunk_id", "_type"], "left")
        .join(reusable, "checksum", "left")
        .withColumn("existing_id", existing)
        .withColumn(
            "action",
            F.when(F.col("_in_place").isNotNull() & label_ok, F.lit("unchanged"))
            .when(F.col("existing_id").isNotNull(), F.lit("moved"))
            .otherwise(F.lit("new")),
        )
        .select(*target.columns, "existing_id", "action")
    )


def moves_of(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("action") == "moved").select(
        F.col("existing_id").alias("id"), "filepath", "chunk_id", "source_type", "github_url"
    )


def repo_bases(repos: DataFrame) -> DataFrame:
    """Distinct source URL prefixes of the configured repositories."""
    branch = F.col("branch") if "branch" in repos.columns else F.lit(None)
    return (
        repos.select(repo_base_url(F.col("repo_url"), branch).alias("repo_base"))
        .filter(F.col("repo_base").isNotNull())
        .distinct()
    )


def in_repos(store: DataFrame, repos: DataFrame) -> DataFrame:
    """Stored rows whose URL starts with the prefix of a configured repository.

    The prefix is cut out of the row's own URL, so this is an equi join however many repositories
    there are.
    """
    return store.withColumn("repo_base", repo_base_of_url(strip_fragment(F.col("github_url")))).join(
        repo_bases(repos), "repo_base", "left_semi"
    )


def find_orphans(store: DataFrame, target: DataFrame, repos: DataFrame) -> DataFrame:
    """Ids of stored rows of the configured repositories whose checksum or file is not wanted.

    Without repositories nothing is an orphan; rows without a URL never are.
    """
    scoped = in_repos(store.select("id", "checksum", "github_url"), repos).select(
        "id", "checksum", strip_fragment(F.col("github_url")).alias("url")
    )
    checksums = target.select("checksum").distinct().withColumn("_known", F.lit(True))
    urls = (
        target.select(strip_fragment(F.col("github_url")).alias("url"))
        .filter(F.col("url").isNotNull())
        .distinct()
        .withColumn("_active", F.lit(True))
    )
    return (
        scoped.join(checksums, "checksum", "left")
        .join(urls, "url", "left")
        .filter(F.col("_known").isNull() | F.col("_active").isNull())
        .select("id")
    )


def find_stranded(store: DataFrame, target: DataFrame, repos: DataFrame) -> DataFrame:
    """Ids of parked rows of the configured repositories whose checksum is not wanted."""
    parsed = parse_repo_url(F.col("repo_url"))
    names = (
        repos.select(F.concat_ws("/", parsed["owner"], parsed["repo"]).alias("repo"), parsed["error"].alias("error"))
        .filter(F.col("error").isNull())
        .select("repo")
        .distinct()
    )
    return (
        store.filter(is_moving(F.col("filepath")))
        .select("id", "checksum", repo_of_url(F.col("github_url")).alias("repo"))
        .join(target.select("checksum"), "checksum", "left_anti")
        .join(names, "repo", "left_semi")
        .select("id")
    )


def ids_to_delete(orphans: DataFrame, stranded: DataFrame) -> DataFrame:
    return orphans.unionByName(stranded).distinct()


def run_stats(documents: DataFrame, chunks: DataFrame, classified: DataFrame, deletes: DataFrame) -> DataFrame:
    """One row: processed and skipped documents, upserted, moved and deleted chunks."""
    with_chunks = chunks.select("filepath").distinct().withColumn("_has", F.lit(1))
    parts = [
        documents.select("filepath")
        .distinct()
        .join(with_chunks, "filepath", "left")
        .agg(
            F.count("_has").alias("processed_documents"),
            F.count_if(F.col("_has").isNull()).alias("skipped_documents"),
        ),
        classified.agg(
            F.count_if(F.col("action") == "new").alias("upserted_chunks"),
            F.count_if(F.col("action") == "moved").alias("moved_chunks"),
        ),
        deletes.agg(F.count("*").alias("deleted_chunks")),
    ]
    return one_row(*parts)


def documents_per_type(documents: DataFrame) -> DataFrame:
    return documents.groupBy("type").agg(F.count("*").alias("documents"))
