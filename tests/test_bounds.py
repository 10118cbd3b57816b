"""What searches, counts and calls hold at once, and that bounds change no row."""

import numpy as np
from pyspark.sql import functions as F

from marginalia.operators import entities, keywords, model_calls, vectors
from marginalia.sources import postings as indexed
from marginalia.sources.postings import PostingIndex
from marginalia.sources.store import ChunkStore

CHUNKS = "id long, chunk_title string, content string, contextual_text string"


def chunks(spark):
    rows = [(1, "a", "b the c", None), (2, "the", "a a", "c b"), (2, "the", "a", ""), (None, "a", None, "b")]
    return spark.createDataFrame(rows, CHUNKS)


def test_equal_queries_are_searched_once(spark):
    asked = [(7, "a b"), (3, "a b"), (5, "c"), (3, "c"), (9, "a b"), (None, "a b"), (4, None)]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    members = {r["query_id"]: (r["_asks"], r["_form"]) for r in keywords._members(queries).collect()}
    assert members == {7: (7, ["a b"]), 9: (7, ["a b"]), 5: (5, ["c"]), 3: (3, ["a b", "c"])}
    found = keywords.keyword_search(keywords.build_postings(chunks(spark), english=False), queries, k=2).collect()
    hits = lambda n: sorted(str(tuple(r)[1:]) for r in found if r["query_id"] == n)
    assert hits(7) and hits(7) == hits(9) and hits(3) and {r["query_id"] for r in found} == {3, 5, 7, 9}


def test_terms_are_counted_like_distinct_chunks(spark):
    rows = keywords.build_postings(chunks(spark), english=False)
    plain = rows.groupBy("term").agg(
        F.count("*").alias("occurrences"), F.count_distinct("id").alias("chunks"), F.sum("position").alias("positions")
    )
    assert sorted(keywords.term_counts(rows).drop("weight").collect()) == sorted(plain.collect())


def test_words_stand_where_listed_words_end(spark):
    long = " ".join(["x", *["the"] * 12])
    store = spark.createDataFrame([(1, "the a", long, "y the"), (2, "the", "", "z")], CHUNKS)
    found = {(r["id"], r["term"], r["position"], r["weight"]) for r in keywords.build_postings(store).collect()}
    assert found == {(1, "x", 1, 0.4), (1, "y", 2, 0.2), (2, "z", 1, 0.2)}


def test_blocks_of_any_size_give_the_same_hits(spark, monkeypatch):
    rows = [(i, [float(i % 7) - 2, float(i % 5), 1.0]) for i in range(60)]
    store = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    queries = store.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    whole = sorted(map(tuple, vectors.vector_search(store, queries, 3, 0.1).collect()))
    for name, value in (("BLOCK_BYTES", 24 * 10), ("PACK_BYTES", 24 * 4)):
        monkeypatch.setattr(vectors, name, value)
        assert sorted(map(tuple, vectors.vector_search(store, queries, 3, 0.1).collect())) == whole


def test_entities_are_handed_on_in_small_frames(spark, monkeypatch):
    body = "export class C {\n" + "\n".join(f"  m{i}() {{\n    return {i};\n  }}" for i in range(9)) + "\n}\n"
    files = spark.createDataFrame([(f"f{i}.ts", body) for i in range(4)], "filepath string, content string")
    whole = sorted(map(str, entities.extract_entities(files).collect()))
    assert len(whole) == 40
    monkeypatch.setattr(entities, "MOST_ROWS", 3)
    assert sorted(map(str, entities.extract_entities(files).collect())) == whole


def test_words_remembered_are_bounded(monkeypatch):
    texts = ["a b c d e a", "e d c", ""]
    whole = model_calls.HashedWords(8)(texts)
    monkeypatch.setattr(model_calls, "MOST_WORDS", 2)
    model = model_calls.HashedWords(8)
    assert np.array_equal(model(texts), whole) and len(model._slots) <= 2


def test_a_refresh_keeps_no_copy_of_texts_or_postings(spark, tmp_path, monkeypatch):
    from marginalia.plans.derived import store

    rows = store(spark, "/root/testdata/sf0.001").limit(20)
    kept = ChunkStore(spark, f"{tmp_path}/store", 2)
    kept.write(rows)

    def refused(df):
        raise AssertionError("written beside the segment")

    monkeypatch.setattr(indexed, "cut_lineage", refused)
    index = PostingIndex(kept, english=False)
    assert index.refresh().added == 20
    plain = keywords.build_postings(kept.read(), english=False)
    assert sorted(index.postings().collect()) == sorted(plain.collect())
