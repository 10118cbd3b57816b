"""Incremental postings against a full rebuild, and searches that open few blocks against plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators.keywords import build_postings, build_vocabulary, keyword_search
from marginalia.sources.postings import PostingIndex
from marginalia.sources.store import ChunkStore
from tests.test_store import chunks

WORDS = ["widget", "render", "the", "call", "setup", "apple", "pear", "tart", "plum", "jam", "running", "runs"]


def text(rng, size):
    return " ".join(rng.choices(WORDS, weights=range(1, len(WORDS) + 1), k=size))


def rows_of(df):
    return sorted(tuple(r) for r in df.select("id", "term", "position", "weight").collect())


def segments_on_disk(tmp_path, kind="blocks"):
    folder = tmp_path / "store" / "postings" / kind
    return {p.name: {b.name for b in p.glob("bucket=*")} for p in folder.glob("segment=*")}


def test_postings_follow_the_store(spark, tmp_path):
    rng = random.Random(4)
    store = ChunkStore(spark, str(tmp_path / "store"), 4)
    index = PostingIndex(store, merge_at=3)
    assert index.refresh().buckets == () and rows_of(index.postings()) == []
    state = {i: (i, f"f{i}", text(rng, 12)) for i in range(1, 60)}
    store.write(chunks(spark, *state.values()))
    first = index.refresh()
    assert (first.added, first.gone) == (59, 0) and index.refresh().buckets == ()
    for step in range(6):
        changed = rng.sample(sorted(state), 3)
        state[changed[0]] = (changed[0], state[changed[0]][1], text(rng, 5))
        state[changed[1]] = (changed[1], f"moved{step}", state[changed[1]][2])
        del state[changed[2]]
        state[100 + step] = (100 + step, f"new{step}", text(rng, 4))
        frame = chunks(spark, *state.values())
        before = store.read()
        places = frame.select("id", "filepath", "content").exceptAll(before.select("id", "filepath", "content"))
        gone = before.select("id", "filepath", "content").exceptAll(frame.select("id", "filepath", "content"))
        buckets = store.buckets_of(places.unionByName(gone))
        store.write(frame, buckets)
        known = set(segments_on_disk(tmp_path))
        done = index.refresh()
        assert set(done.buckets) == set(buckets)
        # Only the buckets that the store has replaced are written, and only what changed in them.
        (written,) = [v for k, v in segments_on_disk(tmp_path).items() if k not in known]
        assert written <= {f"bucket={b}" for b in buckets}
        assert rows_of(index.postings()) == rows_of(build_postings(store.read()))
    assert max(len(names) for names in index.segments().values()) <= 3
    # The state before stays readable.
    assert rows_of(index.postings(1)) == rows_of(build_postings(store.read(1)))
    assert dict(index.vocabulary().collect())["running"] == dict(index.vocabulary().collect())["runs"]


def test_only_new_chunks_of_a_bucket_are_posted(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"), 1)
    index = PostingIndex(store)
    state = [(i, f"f{i}", f"same text {i}") for i in range(1, 30)]
    store.write(chunks(spark, *state))
    index.refresh()
    store.write(chunks(spark, *state[1:], (30, "f30", "other words")), [0])
    done = index.refresh()
    assert (done.added, done.gone) == (1, 1)
    newest = index.segments()[0][-1]
    assert index.blocks().filter(F.col("segment") == newest).agg(F.sum("chunks")).first()[0] <= 6
    assert rows_of(index.postings()) == rows_of(build_postings(store.read()))


def test_a_new_layout_is_indexed_anew(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"), 2)
    index = PostingIndex(store, english=False)
    store.write(chunks(spark, (1, "a", "one two"), (2, "b", "two three")))
    index.refresh()
    wide = ChunkStore(spark, store.root, 5)
    wide.write(wide.read())
    assert len(index.refresh().buckets) == 5
    assert rows_of(index.postings()) == rows_of(build_postings(store.read(), english=False))
    wide.write(chunks(spark), base=wide.version())
    index.refresh()
    assert rows_of(index.postings()) == [] and index.vocabulary() is None


QUERIES = [
    "widget", "apple or pear", "widget render", "apple pear plum", '"apple pear"', '"apple pear" or tart', "jam -widget",
    "pear tart -jam or plum", "zebra", "widget zebra", "the", "-jam", "", "run apple", "jam jam", '"pear tart" plum',
]


@pytest.mark.parametrize("english", [True, False])
def test_pruned_search_equals_the_plain_one(spark, tmp_path, english):
    rng = random.Random(9)
    store = ChunkStore(spark, str(tmp_path / "store"), 3)
    index = PostingIndex(store, english)
    # Some neighbours hold a word far more often than all others.
    often = {i: "widget render " * 30 for i in range(70, 110)}
    state = [(i, f"f{i}", often.get(i) or text(rng, rng.choice([2, 5, 40]))) for i in range(1, 1200)]
    store.write(chunks(spark, *state))
    index.refresh()
    kept = [row for row in state if row[0] % 97] + [(5000 + i, f"g{i}", text(rng, 30)) for i in range(40)]
    store.write(chunks(spark, *kept))
    index.refresh()
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")
    postings = build_postings(store.read(), english)
    plain = keyword_search(postings, queries, 7, build_vocabulary(postings) if english else None)
    names = ["query_id", "id", "keyword_rank", "keyword_order"]
    wanted = sorted(map(tuple, plain.select(names).collect()))
    found = index.search(queries, 7, first_blocks=2)
    assert sorted(map(tuple, found.select(names).collect())) == wanted
    assert len({row[0] for row in wanted}) >= 11
    read = {r["query_id"]: r["posting_rows"] for r in found.select("query_id", "posting_rows").distinct().collect()}
    every = postings.filter("term = 'widget' and id not between 70 and 110").count()
    assert 0 < read[0] < 40 * 2 * 3 * 30 + every / 4


def test_queries_of_many_words_find_their_chunks(spark):
    """More words than a number has bits, all of which must occur."""
    words = [f"w{i}" for i in range(150)]
    store = spark.createDataFrame(
        [(1, " ".join(words)), (2, " ".join(words[:-1])), (3, " ".join(reversed(words)))], "id long, content string"
    )
    postings = build_postings(store, False, (("content", 0.5),))
    queries = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[70:140]))], "query_id int, query string")
    found = keyword_search(postings, queries, 5).select("query_id", "id", "keyword_rank").collect()
    assert sorted(map(tuple, found)) == [(1, 1, 0.5), (1, 3, 0.5), (2, 1, 0.5), (2, 2, 0.5), (2, 3, 0.5)]
