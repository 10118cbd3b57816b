"""Commits of several writers, and leases."""

import threading

import pytest
from pyspark.sql import functions as F

from marginalia.plans.ingest import ingest
from marginalia.schema import STORE
from marginalia.sources.folder import Folder
from marginalia.sources.lease import LeaseHeld, LeaseLost, acquire
from marginalia.sources.store import ChunkStore, CommitConflict
from tests.test_ingest import Kit


def chunks(spark, *files):
    """Rows of the store for (id, filepath, content)."""
    day = F.lit("2024-01-01").cast("timestamp")
    rows = spark.createDataFrame(list(files), "id long, filepath string, content string")
    known = {"contextual_text": F.col("content"), "chunk_title": F.lit("t"), "checksum": F.sha2("content", 256)}
    known |= {"chunk_id": F.lit(0), "source_type": F.lit("doc"), "created_at": day, "updated_at": day}
    return rows.select(
        *[
            F.col(f.name) if f.name in rows.columns else known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in STORE.fields
        ]
    )


def contents(store, version=None):
    return {r["filepath"]: r["content"] for r in store.read(version).collect()}


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "store")


def two_buckets(store):
    """Two file paths in different buckets."""
    names = [f"f{i}" for i in range(20)]
    paths = store.spark.createDataFrame([(n,) for n in names], "filepath string")
    found = {r["filepath"]: r["b"] for r in paths.select("filepath", store.bucket_of(F.col("filepath")).alias("b")).collect()}
    other = next(n for n in names if found[n] != found["f0"])
    return ("f0", found["f0"]), (other, found[other])


def test_writers_of_different_buckets_both_win(spark, root):
    first, second = ChunkStore(spark, root, 8), ChunkStore(spark, root, 8)
    (a, bucket_a), (b, bucket_b) = two_buckets(first)
    first.write(chunks(spark, (1, a, "old"), (2, b, "old")))
    first.read(), second.read()
    assert first.write(chunks(spark, (1, a, "new a")), [bucket_a]) == 2
    assert second.write(chunks(spark, (2, b, "new b")), [bucket_b]) == 3  # started from version 1
    assert contents(first) == {a: "new a", b: "new b"}
    assert contents(first, 1) == {a: "old", b: "old"} and contents(first, 2) == {a: "new a", b: "old"}


def test_writers_of_one_bucket_conflict(spark, root):
    first, second = ChunkStore(spark, root, 8), ChunkStore(spark, root, 8)
    (a, bucket_a), (b, bucket_b) = two_buckets(first)
    first.write(chunks(spark, (1, a, "old")))
    first.read(), second.read()
    first.write(chunks(spark, (1, a, "first")), [bucket_a])
    with pytest.raises(CommitConflict):
        second.write(chunks(spark, (1, a, "second")), [bucket_a])
    with pytest.raises(CommitConflict):
        second.write(chunks(spark, (1, a, "second")))
    with pytest.raises(CommitConflict):  # its ids depend on all rows
        second.write(chunks(spark, (2, b, "second")), [bucket_b], whole=True)
    assert contents(second) == {a: "first"} and second.version() == 2
    second.write(chunks(spark, (1, a, "second")), [bucket_a])  # read again meanwhile
    assert contents(first) == {a: "second"}


def test_a_new_layout_conflicts_with_its_old_buckets(spark, root):
    first, second = ChunkStore(spark, root, 8), ChunkStore(spark, root, 16)
    (a, bucket_a), _ = two_buckets(first)
    first.write(chunks(spark, (1, a, "old")))
    first.read(), second.read()
    second.write(chunks(spark, (1, a, "wide")))
    with pytest.raises(CommitConflict):
        first.write(chunks(spark, (1, a, "late")), [bucket_a])
    assert second.buckets == 16 and contents(second) == {a: "wide"}


def test_writers_at_the_same_time_lose_nothing(spark, root):
    ChunkStore(spark, root, 8).write(chunks(spark))
    names = [f"f{i}" for i in range(40)]
    store = ChunkStore(spark, root, 8)
    paths = spark.createDataFrame([(n,) for n in names], "filepath string")
    by_bucket = {r["b"]: r["filepath"] for r in paths.select("filepath", store.bucket_of(F.col("filepath")).alias("b")).collect()}
    failed = []

    def work(number, bucket, name):
        try:
            ChunkStore(spark, root, 8).write(chunks(spark, (number, name, name)), [bucket], base=1)
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=work, args=(i, b, n)) for i, (b, n) in enumerate(list(by_bucket.items())[:4])]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert failed == [] and store.version() == 5
    assert set(contents(store)) == set(list(by_bucket.values())[:4])


def test_published_names_are_taken_once(spark, root):
    folder = Folder(spark, root)
    assert folder.names("x") == [] and folder.create("x/one", "first") and not folder.create("x/one", "second")
    assert folder.content("x/one") == "first" and folder.names("x") == ["one"]
    won = []
    threads = [threading.Thread(target=lambda n=n: folder.create("x/two", str(n)) and won.append(n)) for n in range(6)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert [str(n) for n in won] == [folder.content("x/two")] and folder.names("x") == ["one", "two"]


class Clock:
    def __init__(self):
        self.now = 1000.0

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds


def test_a_lease_has_one_holder(spark, root):
    folder, clock = Folder(spark, root), Clock()
    first = acquire(folder, "first", 60, clock=clock)
    with pytest.raises(LeaseHeld, match="first"):
        acquire(folder, "second", 60, clock=clock)
    clock.now += 50
    first.renew()
    clock.now += 50
    first.check()
    with pytest.raises(LeaseHeld):
        acquire(folder, "second", 60, wait=5, clock=clock, pause=clock.sleep)
    second = acquire(folder, "second", 60, wait=30, clock=clock, pause=clock.sleep)  # the first one expires meanwhile
    assert second.token == first.token + 1
    with pytest.raises(LeaseLost):
        first.check()
    with pytest.raises(LeaseLost):
        first.renew()
    second.release()
    third = acquire(folder, "third", 60, clock=clock)
    assert third.token == 3
    with pytest.raises(LeaseLost):
        second.check()


def test_writes_honour_the_lease(spark, root):
    store = ChunkStore(spark, root, 4)
    stale = store.lease("stale", seconds=0.0)
    with store.lease("run") as lease:
        with pytest.raises(LeaseHeld):
            store.write(chunks(spark, (1, "a", "manual")))
        with pytest.raises(LeaseLost):
            store.write(chunks(spark, (1, "a", "late")), lease=stale)
        assert store.write(chunks(spark, (1, "a", "run")), lease=lease) == 1
    assert store.write(chunks(spark, (1, "a", "manual"))) == 2
    assert contents(store) == {"a": "manual"}


def test_a_manual_run_is_refused_during_another(spark, tmp_path):
    kit = Kit(spark, tmp_path)
    kit.run({"docs/a.mdx": "one"})
    with kit.store.lease("stream"):
        with pytest.raises(LeaseHeld):
            kit.run({"docs/a.mdx": "two"})
    assert {r["content"] for r in kit.store.read().collect()} == {"one"}
    kit.run({"docs/a.mdx": "two"})
    assert {r["content"] for r in kit.store.read().collect()} == {"two"}


def test_a_run_that_was_overtaken_writes_nothing(spark, tmp_path):
    """Another writer commits between a run's diff and its write: the run ends in a conflict."""
    kit = Kit(spark, tmp_path)
    kit.run({"docs/a.mdx": "one"})

    store, version = kit.store, kit.store.version()
    write = store.write

    def late(*args, **options):
        other = ChunkStore(spark, store.root, 4)
        held = options["lease"]
        other.write(other.read(), other.buckets_of(other.read().select("filepath")), lease=held)
        return write(*args, **options)

    store.write = late
    with pytest.raises(CommitConflict):
        kit.run({"docs/a.mdx": "two"})
    assert store.version() == version + 1
    assert {r["content"] for r in store.read().collect()} == {"one"}
