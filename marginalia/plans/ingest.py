"""One ingest run: scan, chunk, diff, describe, embed, write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.config import DEFAULT_EMBEDDING_TOKEN_LIMIT, CallLimits, Settings
from marginalia.functions.links import resolve_links
from marginalia.functions.tokens import TokenizerFactory
from marginalia.operators.diff import (
    build_target,
    classify_chunks,
    find_orphans,
    find_stranded,
    ids_to_delete,
    moves_of,
    run_stats,
)
from marginalia.operators.entities import extract_entities, file_outline
from marginalia.operators.entity_chunks import chunk_entities
from marginalia.operators.model_calls import (
    ChatModel,
    EmbeddingModel,
    contextual_text,
    doc_context,
    embed_chunks,
    entity_context,
)
from marginalia.operators.split import chunk_documents
from marginalia.operators.state import apply_moves, check_unique_location, next_state
from marginalia.session import cut_lineage
from marginalia.sources.lease import Lease
from marginalia.sources.store import ChunkStore

_NARROW = ["id", "checksum", "filepath", "chunk_id", "source_type", "github_url"]


@dataclass(frozen=True)
class IngestOptions:
    token_limit: int = DEFAULT_EMBEDDING_TOKEN_LIMIT
    methods: bool = True
    variables: bool = False
    # Code languages of the corpus; none for documentation only.
    languages: tuple[str, ...] = ("typescript", "rust", "python")
    tokenizer: TokenizerFactory | None = None
    settings: Settings = Settings()


def locate(corpus: DataFrame) -> DataFrame:
    """Add ``filepath``: the path in the scope, or the whole path."""
    return corpus.withColumn("filepath", F.coalesce(F.nullif("relative_path", F.lit("")), F.col("path")))


def corpus_chunks(located: DataFrame, options: IngestOptions = IngestOptions()) -> DataFrame:
    """Chunks of located documents: doc sections and code entities in one shape."""
    docs = chunk_documents(
        located.filter(F.col("type") == "mdx").select("filepath", "content", "source_url", "base_url", "content_path"),
        options.token_limit,
        tokenizer=options.tokenizer,
    ).select(
        "filepath",
        "chunk_id",
        "chunk_title",
        F.col("chunk_content").alias("content"),
        "checksum",
        F.lit("doc").alias("source_type"),
        F.lit(None).cast("string").alias("entity_type"),
        F.lit(None).cast("int").alias("start_line"),
        F.lit(None).cast("int").alias("end_line"),
        F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("parent_context"),
        F.lit(None).cast("string").alias("doc"),
        "source_url",
        "base_url",
        "content_path",
    )
    chunks = docs
    if options.languages:
        chunks = docs.unionByName(_code_chunks(located, options))
    linked = resolve_links(chunks, F.col("base_url"), F.col("content_path"))
    return linked.drop("source_url", "base_url", "content_path")


def _code_chunks(located: DataFrame, options: IngestOptions) -> DataFrame:
    files = located.filter(F.col("type").isin(*options.languages))
    entities = extract_entities(files, options.methods, options.variables, options.languages)
    code = chunk_entities(entities, options.token_limit, options.tokenizer).select(
        "filepath",
        F.col("chunk_index").alias("chunk_id"),
        F.col("qualified_name").alias("chunk_title"),
        "content",
        "checksum",
        F.lit("code").alias("source_type"),
        "entity_type",
        "start_line",
        "end_line",
        "name",
        "parent_context",
        "doc",
    )
    return code.join(files.select("filepath", "source_url", "base_url", "content_path"), "filepath")


def describe_new(new: DataFrame, documents: DataFrame, chat: ChatModel, options: IngestOptions) -> DataFrame:
    """Add ``contextual_text`` to new chunks, given the documents they are from."""
    limits = options.settings.chat
    documents = documents.select("filepath", "content")
    described = doc_context(new.filter(F.col("source_type") == "doc"), documents, chat, limits)
    if options.languages:
        described = described.unionByName(_describe_code(new, documents, chat, limits))
    return described.withColumn(
        "contextual_text", contextual_text(F.col("source_type"), F.col("header"), F.col("content"))
    )


def _describe_code(new: DataFrame, documents: DataFrame, chat: ChatModel, limits: CallLimits) -> DataFrame:
    files = documents.join(file_outline(documents), "filepath")
    return entity_context(new.filter(F.col("source_type") == "code"), files, chat, limits=limits)


def plan_changes(chunks: DataFrame, stored: DataFrame, repos: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classified targets, moves, ids to delete) of a run against the stored chunks."""
    target = build_target(chunks, ("filepath", "chunk_id"))
    classified = cut_lineage(classify_chunks(target, stored))
    moves = moves_of(classified)
    moved = apply_moves(stored.select(*_NARROW), moves)
    deletes = ids_to_delete(
        find_orphans(moved, classified, repos), find_stranded(moved, classified, repos)
    )
    # A row that a target reuses stays, whatever its old place says.
    kept = classified.select(F.col("existing_id").alias("id")).filter(F.col("id").isNotNull())
    return classified, moves, cut_lineage(deletes.join(kept, "id", "left_anti"))


def ingest(
    corpus: DataFrame,
    repos: DataFrame,
    store: ChunkStore,
    embed: EmbeddingModel,
    chat: ChatModel,
    options: IngestOptions = IngestOptions(),
    holder: str = "ingest",
    wait: float = 0.0,
) -> dict[str, int]:
    """Bring the store in step with the corpus and return the counters of the run.

    Chunks whose content is stored already cause no model call. The new version holds deletes,
    moves and upserts together; when nothing changed none is written. A run holds the store's lease:
    while another is at work, it is refused with LeaseHeld after ``wait`` seconds.
    """
    with store.lease(holder, wait=wait) as lease:
        return _ingest(corpus, repos, store, embed, chat, options, lease)


def _ingest(
    corpus: DataFrame,
    repos: DataFrame,
    store: ChunkStore,
    embed: EmbeddingModel,
    chat: ChatModel,
    options: IngestOptions,
    lease: Lease,
) -> dict[str, int]:
    base = store.version()
    located = locate(corpus)
    # The diff needs checksums and places only; contents are cut again for files with new chunks.
    index = cut_lineage(
        corpus_chunks(located, options).select("checksum", "filepath", "chunk_id", "source_type", "github_url")
    )
    stored = store.read(base)
    classified, moves, deletes = plan_changes(index, stored, repos)
    stats = run_stats(located, index, classified, deletes).first().asDict()
    if not any(stats[name] for name in ("upserted_chunks", "moved_chunks", "deleted_chunks")):
        return stats

    wanted = classified.filter(F.col("action") == "new").select("checksum", "filepath", "chunk_id")
    documents = located.join(wanted.select("filepath").distinct(), "filepath", "left_semi")
    new = corpus_chunks(documents, options).join(wanted, ["checksum", "filepath", "chunk_id"], "left_semi")
    described = cut_lineage(describe_new(cut_lineage(new), documents, chat, options))
    embedded = cut_lineage(embed_chunks(described, embed, limits=options.settings.embedding))

    # Only the buckets that hold a changed file, before or after, are read and written again.
    gone = deletes.unionByName(moves.select("id"))
    before = stored.select("id", "filepath").join(gone, "id", "left_semi")
    buckets = store.buckets_of(
        before.select("filepath").unionByName(moves.select("filepath")).unionByName(embedded.select("filepath"))
    )
    last_id = stored.agg(F.max("id")).first()[0] or 0
    state = next_state(store.read(base, buckets), moves, deletes, embedded, F.current_timestamp(), last_id)
    check_unique_location(state)
    # New ids and the choice among equal contents depend on all stored rows.
    store.write(state, buckets, base, whole=True, lease=lease)
    return stats
