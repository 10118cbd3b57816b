"""Streams of change events, questions and partial answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marginalia.functions.paths import repo_of_url
from marginalia.operators.model_calls import ChatModel, EmbeddingModel
from marginalia.plans.ingest import IngestOptions, ingest
from marginalia.sources.store import ChunkStore

PING = "ping"


def change_events(events: DataFrame, kind_col: str = "kind", repo_col: str = "repo") -> DataFrame:
    """Events that ask for an ingest, labelled ``webhook:<repo>:<kind>``; pings do not."""
    return events.filter(F.col(kind_col) != PING).withColumn(
        "trigger",
        F.concat(F.lit("webhook:"), F.coalesce(repo_col, F.lit("unknown-repo")), F.lit(":"), F.col(kind_col)),
    )


def changed_repos(events: DataFrame, kind_col: str = "kind", repo_col: str = "repo") -> DataFrame:
    """One row per repository that changed: its events coalesce into one run."""
    return (
        change_events(events, kind_col, repo_col)
        .groupBy(F.coalesce(repo_col, F.lit("unknown-repo")).alias("repo"))
        .agg(F.count("*").alias("events"))
    )


def _triggered(writer: DataStreamWriter, interval: str | None) -> DataStreamWriter:
    if interval is None:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=interval)


def ingest_stream(
    events: DataFrame,
    run: Callable[[DataFrame], object],
    checkpoint: str,
    interval: str | None = None,
    kind_col: str = "kind",
    repo_col: str = "repo",
) -> StreamingQuery:
    """Run an ingest for the repositories of each micro-batch.

    ``run`` gets the changed repositories. Micro-batches never overlap, so there is one run at a
    time, and events that arrive during a run wait for the next one together. A repeated batch runs
    the same diff again, which changes nothing the second time. ``interval`` sets the schedule;
    without it everything available is handled and the query stops.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        repos = changed_repos(batch, kind_col, repo_col)
        if not repos.isEmpty():
            run(repos)

    writer = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return _triggered(writer, interval).start()


def incremental_ingest(
    events: DataFrame,
    corpus: Callable[[DataFrame], DataFrame],
    repos: DataFrame,
    store: ChunkStore,
    embed: EmbeddingModel,
    chat: ChatModel | None,
    checkpoint: str,
    options: IngestOptions = IngestOptions(),
    interval: str | None = None,
    kind_col: str = "kind",
    repo_col: str = "repo",
    wait: float = 3600.0,
) -> StreamingQuery:
    """Bring the store up to date with the repositories that the events name, micro-batch by micro-batch.

    ``repos`` are the configured repositories; events name them as ``owner/name``. ``corpus`` scans the
    repositories it is given. A run changes chunks of these repositories only. Events of repositories
    that are not configured start no run. A micro-batch waits up to ``wait`` seconds for a run that
    another caller has started; callers that come during a micro-batch are refused by the store's lease.
    """

    def run(changed: DataFrame) -> None:
        wanted = changed.select("repo").distinct()
        own = repos.join(wanted, repo_of_url(F.col("repo_url")) == F.col("repo"), "left_semi")
        if not own.isEmpty():
            ingest(corpus(own), own, store, embed, chat, options, holder="stream", wait=wait)

    return ingest_stream(events, run, checkpoint, interval, kind_col, repo_col)


def question_stream(
    questions: DataFrame,
    retrieve: Callable[[DataFrame], DataFrame],
    output: str,
    checkpoint: str,
    interval: str | None = None,
) -> StreamingQuery:
    """Retrieve for each incoming question; hits of batch n go to ``output/batch=n``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        retrieve(batch).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    writer = questions.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return _triggered(writer, interval).start()


def answer_delta_stream(partials: DataFrame) -> DataFrame:
    """Deltas of growing answers on a stream of (answer_id, seq, answer).

    The state of an answer is its last text; partials of one answer in one batch go in ``seq``
    order, later batches continue.
    """

    def deltas(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        previous = state.get[0] if state.exists else ""
        rows = []
        # The partials of one answer in one micro-batch.
        partial = pd.concat(list(batches)).sort_values("seq")
        for seq, text in zip(partial["seq"], partial["answer"]):
            if text and text != previous:
                delta = text[len(previous) :]
                previous = text
                if delta:
                    rows.append((key[0], seq, delta))
        state.update((previous,))
        yield pd.DataFrame(rows, columns=["answer_id", "seq", "delta"])

    return partials.groupBy("answer_id").applyInPandasWithState(
        deltas,
        "answer_id long, seq long, delta string",
        "previous string",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def source_events(partials: DataFrame) -> DataFrame:
    """Sources of an answer, each once, at the first partial that lists it.

    ``partials`` has answer_id, seq and sources (array of struct with filepath, chunkTitle, url).
    """
    return (
        partials.select("answer_id", "seq", F.explode("sources").alias("source"))
        .groupBy("answer_id", "source")
        .agg(F.min("seq").alias("seq"))
        .select("answer_id", "seq", "source.*")
    )


class _Sources(StatefulProcessor):
    """Which sources of an answer were told, until the answer has been silent for a while."""

    def __init__(self, silence_ms: int) -> None:
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getMapState("told", _SOURCE, "seq long")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first: dict[tuple, int] = {}
        for row in rows:
            for source in row["sources"] or ():
                source = source["filepath"], source["chunkTitle"], source["url"]
                first[source] = min(row["seq"], first.get(source, row["seq"]))
        for source, seq in sorted(first.items(), key=lambda item: (item[1], repr(item[0]))):
            if not self.told.containsKey(source):
                self.told.updateValue(source, (seq,))
                yield Row(answer_id=key[0], seq=seq, filepath=source[0], chunkTitle=source[1], url=source[2])
        at = timerValues.getCurrentProcessingTimeInMs() + self.silence_ms
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.told.clear()
        self.timer.clear()
        return iter(())

    def close(self) -> None:
        pass


_SOURCE = "filepath string, chunkTitle string, url string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source_event_stream(partials: DataFrame, silence_seconds: float = 600.0) -> DataFrame:
    """``source_events`` on a stream: each source of an answer once, as it is first listed.

    The state of an answer is the set of its sources; it is dropped when no partial has come for
    ``silence_seconds``. Within a micro-batch the smallest ``seq`` counts; later batches continue.
    The session's state store must be one that keeps maps (``STATE_STORE``).
    """
    schema = partials.schema
    answer, seq = schema["answer_id"].dataType.simpleString(), schema["seq"].dataType.simpleString()
    rows = partials.select("answer_id", F.col("seq").cast("long").alias("seq"), "sources")
    told = rows.groupBy("answer_id").transformWithState(
        _Sources(int(silence_seconds * 1000)), f"answer_id {answer}, seq long, {_SOURCE}", "append", "processingTime"
    )
    return told.withColumn("seq", F.col("seq").cast(seq))
