"""Blocks that are made where the texts are, against plain postings; shuffles that go with their action."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import posting_blocks as blocks_of
from marginalia.operators.keywords import FIELD_WEIGHTS, build_postings, term_counts
from marginalia.sources import postings
from marginalia.sources.postings import PostingIndex
from marginalia.sources.store import ChunkStore
from tests.test_postings import text
from tests.test_store import chunks


def odd_chunks(spark):
    rng = random.Random(3)
    rows = [(i, i % 2, text(rng, 3), text(rng, rng.choice([0, 1, 9])), f"the {text(rng, 4)} the") for i in range(200)]
    rows += [(7, 1, None, "apple apple", "the"), (7, 1, "", None, "apple pear"), (-5, 0, "É ünï_1 x", "the", ""), (None, 0, "pear", "", "pear pear")]
    rows.append((500, 0, "long", text(rng, 3000), text(rng, 3000)))
    return spark.createDataFrame(rows, "id long, bucket int, chunk_title string, content string, contextual_text string")


@pytest.mark.parametrize("english", [True, False])
def test_blocks_hold_the_postings_and_their_bounds(spark, english):
    rows = odd_chunks(spark).coalesce(1).sortWithinPartitions("bucket", "id")
    found = blocks_of.posting_blocks(rows, english, FIELD_WEIGHTS).localCheckpoint()
    key = lambda r: tuple((v is None, v) for v in r)
    flat = found.select("bucket", "term", F.explode("entries").alias("e")).select("e.id", "bucket", "term", "e.position", "e.weight")
    plain = build_postings(rows, english, keep=("bucket",)).select("id", "bucket", "term", "position", "weight")
    assert sorted(map(tuple, flat.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)

    per_chunk = plain.groupBy("bucket", "term", "id").agg(
        F.count("*").alias("n"), F.sum("weight").alias("sum"), F.max("weight").alias("heavy")
    )
    wanted = per_chunk.groupBy("bucket", "term", F.shiftright("id", blocks_of.BLOCK_BITS).alias("block")).agg(
        F.count("*"), F.max("n"), F.round(F.max("sum"), 9), F.max("heavy"), F.sum("n")
    )
    names = ["bucket", "term", "block", "chunks", "most", F.round("top", 9), "heavy", "size"]
    assert sorted(map(tuple, found.select(*names).collect()), key=key) == sorted(map(tuple, wanted.collect()), key=key)


def test_runs_of_few_words_hold_the_same_postings(spark, monkeypatch):
    rows = odd_chunks(spark).coalesce(1).sortWithinPartitions("bucket", "id")
    monkeypatch.setattr(blocks_of, "_RUN", 1000)
    found = blocks_of.posting_blocks(rows, False, FIELD_WEIGHTS).localCheckpoint()
    assert found.count() > found.select("bucket", "term", "block").distinct().count()
    flat = found.select(F.explode("entries").alias("e"), "term").select("e.id", "term", "e.position", "e.weight")
    plain = build_postings(rows, False, keep=("bucket",)).select("id", "term", "position", "weight")
    assert flat.exceptAll(plain).count() == 0 and plain.exceptAll(flat).count() == 0


def test_a_refresh_makes_no_row_of_a_posting(spark, tmp_path, monkeypatch):
    """Texts are moved once; nothing is exploded, gathered or moved after that."""
    store = ChunkStore(spark, str(tmp_path / "store"), 2)
    store.write(chunks(spark, *[(i, f"f{i}", f"some words {i}") for i in range(1, 40)]))
    seen = []
    made = PostingIndex._blocks
    monkeypatch.setattr(PostingIndex, "_blocks", lambda self, *given: seen.append(made(self, *given)) or seen[-1])
    monkeypatch.setattr(postings, "TASK_CHARS", 100)
    index = PostingIndex(store)
    index.refresh()
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and plan.count("Exchange") == 1
    assert seen[0].rdd.getNumPartitions() > 2
    assert index.postings().exceptAll(build_postings(store.read())).count() == 0


def test_a_refresh_and_a_search_leave_no_shuffle_files(spark, tmp_path):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {name for f in [manager.getAllFiles()] for i in range(f.size()) if (name := f.apply(i).getName()).startswith("shuffle_")}
    store = ChunkStore(spark, str(tmp_path / "store"), 2)
    frame = chunks(spark, *[(i, f"f{i}", f"apple pear {i}") for i in range(1, 300)]).localCheckpoint()
    queries = spark.createDataFrame([(1, "apple pear"), (2, "apple or 7")], "query_id long, query string").localCheckpoint()
    before = shuffled()
    store.write(frame)
    index = PostingIndex(store, english=False)
    index.refresh()
    found = index.search(queries, 3)
    assert not {name for name in shuffled() - before if name.endswith(".data")}
    assert found.count() == 6


def test_terms_are_counted_by_block_as_by_chunk(spark):
    rows = build_postings(odd_chunks(spark), False, keep=("bucket",)).drop("bucket")
    names = ["term", "occurrences", "chunks", F.round("weight", 6), "positions"]
    by_block = term_counts(rows.withColumn("block", F.shiftright("id", 6))).select(*names)
    by_chunk = term_counts(rows).select(*names)
    assert by_block.dtypes == by_chunk.dtypes
    assert "_chunks" in by_block._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, by_block.collect())) == sorted(map(tuple, by_chunk.collect()))
