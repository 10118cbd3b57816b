"""Checked queries that run a stream over a whole table to its end, and the snapshot of a scan."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.model_calls import HashedWords, embed_chunks
from marginalia.operators.vectors import vector_search
from marginalia.plans.catalog import ORACLE, checked
from marginalia.plans.checked_paths import scanned_corpus
from marginalia.plans.checked_search import _DOC_HITS_SQL, _embedded_store
from marginalia.plans.derived import table
from marginalia.session import ensure_checkpoint_dir
from marginalia.sources.corpus import save_snapshot
from marginalia.streaming.streams import STATE_STORE, ingest_stream, question_stream, source_event_stream

#: Files that a table is dealt out to; a micro-batch takes half of them.
FILES = 4


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _stream(rows: DataFrame, folder: str, first: Column) -> DataFrame:
    """``rows`` as a stream of two micro-batches; those of the condition come first."""
    first = F.coalesce(first, F.lit(False))
    for part in (rows.filter(first), rows.filter(~first)):
        part.repartition(FILES // 2).write.mode("append").parquet(f"{folder}/in")
    reader = rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES // 2)
    return reader.parquet(f"{folder}/in")


@contextmanager
def _settings(spark: SparkSession, **wanted: str) -> Iterator[None]:
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@checked("select user_id::varchar as repo, count(*) as events from events where event_type <> 'view' group by 1")
def streamed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs that a stream of change events starts, added up by repository."""
    folder = _folder(spark)
    events = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") == "view", "ping").otherwise(F.col("event_type")).alias("kind"),
        F.col("user_id").cast("string").alias("repo"),
    )

    def run(repos: DataFrame) -> None:
        repos.write.mode("append").parquet(f"{folder}/runs")

    ingest_stream(_stream(events, folder, F.col("event_id") % 2 == 0), run, f"{folder}/check").awaitTermination()
    return spark.read.parquet(f"{folder}/runs").groupBy("repo").agg(F.sum("events").alias("events"))


@checked(
    """select conv_id as answer_id, min(turn) as seq, role as filepath, 't' as "chunkTitle", null::varchar as url
    from conversations group by conv_id, role"""
)
def streamed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of growing answers on a stream, each once."""
    folder = _folder(spark)
    source = F.struct(
        F.col("role").alias("filepath"), F.lit("t").alias("chunkTitle"), F.lit(None).cast("string").alias("url")
    )
    partials = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("answer_id"), F.col("turn").alias("seq"), F.array(source, source).alias("sources")
    )
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled")
    with _settings(spark, **dict(zip(names, (STATE_STORE, "false")))):
        told = source_event_stream(_stream(partials, folder, F.col("seq") < 2))
        writer = told.writeStream.format("parquet").option("path", f"{folder}/out")
        writer.option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(told.schema).parquet(f"{folder}/out")


@checked(f"with {_DOC_HITS_SQL} select query_id, id, round(similarity, 6) as similarity, rank as vector_rank from doc_hits")
def streamed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark texts ask on a stream."""
    folder = _folder(spark)
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    stored = _embedded_store(spark, sf_dir).select("id", "embedding")

    def retrieve(batch: DataFrame) -> DataFrame:
        asked = embed_chunks(batch, HashedWords(64), "question").withColumnRenamed("embedding", "query_embedding")
        return vector_search(stored, asked, k=5, threshold=0.5)

    question_stream(_stream(questions, folder, F.col("query_id") % 2 == 0), retrieve, f"{folder}/out", f"{folder}/check").awaitTermination()
    hits = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out").drop("batch")
    return hits.withColumn("similarity", F.round("similarity", 6))


@checked(f"select type, path, sha from ({ORACLE['scanned_corpus']}) as scanned")
def saved_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second snapshot takes the place of the first."""
    folder = _folder(spark)
    corpus = scanned_corpus(spark, sf_dir)
    save_snapshot(corpus.limit(0), folder)
    save_snapshot(corpus, folder)
    return spark.read.parquet(folder).select("type", "path", "sha")
