"""Streams over file sources: one batch or many give the same result."""

from pyspark.sql import functions as F

from marginalia.operators.conversations import answer_deltas
from marginalia.operators.model_calls import HashedWords
from marginalia.operators.vectors import vector_search
from marginalia.sources.corpus import read_files, scan_corpus
from marginalia.streaming.streams import (
    STATE_STORE,
    answer_delta_stream,
    incremental_ingest,
    ingest_stream,
    question_stream,
    source_event_stream,
    source_events,
)
from tests.test_ingest import REPO, CountingChat, Kit, write_files


def feed(spark, frame, path, files):
    """Write a frame as several files and read them as a stream, one file per batch."""
    frame.repartition(files).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_change_events_start_runs(spark, tmp_path):
    kit = Kit(spark, tmp_path)
    kit.files = {"docs/a.mdx": "one", "docs/b.mdx": "two"}
    events = spark.createDataFrame(
        [("push", "acme/kit"), ("push", "acme/kit"), ("ping", "acme/kit"), ("push", "acme/other")], "kind string, repo string"
    )
    seen = []

    def run(repos):
        seen.extend((r["repo"], r["events"]) for r in repos.collect())
        kit.run()

    stream = feed(spark, events, str(tmp_path / "events"), 1)
    ingest_stream(stream, run, str(tmp_path / "check")).awaitTermination()
    assert sorted(seen) == [("acme/kit", 2), ("acme/other", 1)]
    once = {k: (v["id"], v["checksum"]) for k, v in kit.rows().items()}

    # The same events in several batches, on top: the later runs find nothing to do.
    stream = feed(spark, events, str(tmp_path / "events2"), 3)
    ingest_stream(stream, run, str(tmp_path / "check2")).awaitTermination()
    assert {k: (v["id"], v["checksum"]) for k, v in kit.rows().items()} == once
    assert kit.store.version() == 1


def test_events_bring_the_store_up_to_date(spark, tmp_path):
    kit = Kit(spark, tmp_path)
    root = tmp_path / "kit"
    write_files(root, {"docs/a.mdx": "one", "src/b.Ts": "export function f() {\n  return 1;\n}\n"})
    scanned = []

    def corpus(repos):
        scanned.append(repos.count())
        return scan_corpus(read_files(spark, str(root), REPO), repos)

    events = spark.createDataFrame([("push", "acme/kit"), ("push", "acme/other"), ("ping", "acme/kit")], "kind string, repo string")
    stream = feed(spark, events, str(tmp_path / "events"), 1)
    incremental_ingest(
        stream, corpus, kit.repos, kit.store, HashedWords(16), CountingChat(kit.calls), str(tmp_path / "check")
    ).awaitTermination()
    assert scanned == [2]  # documentation and code of the one configured repository
    assert {place[0] for place in kit.rows()} == {"docs/a.mdx", "src/b.Ts"}


def test_pings_start_nothing(spark, tmp_path):
    events = spark.createDataFrame([("ping", "a")], "kind string, repo string")
    seen = []
    stream = feed(spark, events, str(tmp_path / "events"), 1)
    ingest_stream(stream, seen.append, str(tmp_path / "check")).awaitTermination()
    assert seen == []


def test_questions_find_their_documents(spark, tmp_path):
    texts = ["red apple pie", "green pear tart", "blue plum jam"]
    model = HashedWords(32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(model(texts))]
    store = spark.createDataFrame(rows, "id long, embedding array<float>")
    questions = spark.createDataFrame(list(enumerate(texts)), "query_id long, question string")

    def retrieve(batch):
        from marginalia.operators.model_calls import embed_chunks

        asked = embed_chunks(batch, model, "question").withColumnRenamed("embedding", "query_embedding")
        return vector_search(store, asked, 1)

    stream = feed(spark, questions, str(tmp_path / "questions"), 3)
    question_stream(stream, retrieve, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).select("query_id", "id").collect()
    assert sorted(map(tuple, found)) == [(0, 0), (1, 1), (2, 2)]


def test_deltas_equal_the_batch_form(spark, tmp_path):
    partials = spark.createDataFrame(
        [(a, s, text) for a in (1, 2) for s, text in enumerate(["", "ab", "ab", "abc", "abcdef"])],
        "answer_id long, seq long, answer string",
    )
    expected = sorted(map(tuple, answer_deltas(partials).collect()))
    assert expected == [(a, s, d) for a in (1, 2) for s, d in ((1, "ab"), (3, "c"), (4, "def"))]
    for files in (1, 2):
        path = str(tmp_path / f"in{files}")
        # Later partials come in later files.
        ordered = partials.orderBy("seq").coalesce(1) if files == 1 else None
        if ordered is not None:
            stream = feed(spark, ordered, path, 1)
        else:
            partials.filter(F.col("seq") < 3).coalesce(1).write.parquet(path)
            partials.filter(F.col("seq") >= 3).coalesce(1).write.mode("append").parquet(path)
            stream = spark.readStream.schema(partials.schema).option("maxFilesPerTrigger", 1).parquet(path)
        name = f"deltas{files}"
        query = (
            answer_delta_stream(stream)
            .writeStream.format("memory")
            .queryName(name)
            .option("checkpointLocation", str(tmp_path / f"check{files}"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        assert sorted(map(tuple, spark.table(name).collect())) == expected


def test_sources_on_a_stream(spark, tmp_path):
    """One source event per source and answer, over several batches and a restart; then the state goes."""
    source = lambda n: (f"f{n}", "t", None if n % 2 else f"u{n}")
    rows = [(a, s, [source(n) for n in range(s % 4)] + [source(1)]) for a in (1, 2, 3) for s in range(6)]
    schema = "answer_id long, seq long, sources array<struct<filepath:string,chunkTitle:string,url:string>>"
    partials = spark.createDataFrame([*rows, (4, 0, []), (5, 0, None)], schema)
    wanted = sorted(map(tuple, source_events(partials).select("answer_id", "seq", "filepath", "chunkTitle", "url").collect()), key=repr)
    assert len(wanted) == 9
    path, before = str(tmp_path / "in"), spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def run(n):
        stream = spark.readStream.schema(partials.schema).option("maxFilesPerTrigger", 1).parquet(path)
        out = source_event_stream(stream, silence_seconds=30.0 if n < 2 else 0.0)
        query = (
            out.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append")
            .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("answer_id", "seq", "filepath", "chunkTitle", "url").collect()), key=repr)

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    # Else a query that takes what there is and stops would wait for timers for ever.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        ordered = [partials.filter(F.col("seq") < 2), partials.filter(F.col("seq") == 2), partials.filter(F.col("seq") > 2)]
        ordered[0].coalesce(1).write.parquet(path)
        ordered[1].coalesce(1).write.mode("append").parquet(path)
        run(0)
        ordered[2].coalesce(1).write.mode("append").parquet(path)
        assert run(1) == wanted
        # The same sources again, for one answer: nothing. It falls silent at once, and its state is dropped
        # by the next batch; after that they are told anew.
        again = partials.filter("answer_id = 1 and seq = 3").coalesce(1)
        again.write.mode("append").parquet(path)
        assert run(2) == wanted
        partials.filter("answer_id = 4").coalesce(1).write.mode("append").parquet(path)
        assert run(3) == wanted
        again.write.mode("append").parquet(path)
        assert len(run(4)) == len(wanted) + 3
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
