"""Whole runs on a small repository: store, diff, model calls, answers."""

import os

import pytest
from pyspark.sql import functions as F

from marginalia.config import SearchDefaults
from marginalia.operators.answers import NO_CONTEXT_ANSWER, answer
from marginalia.operators.keywords import build_postings, build_vocabulary
from marginalia.operators.model_calls import HashedWords
from marginalia.operators.state import apply_moves, location_conflicts, number_rows, upsert_chunks
from marginalia.plans.checked_answers import CitingChat
from marginalia.plans.ingest import IngestOptions, ingest
from marginalia.sources.corpus import read_files, repos_table, save_snapshot, scan_corpus, union_repos
from marginalia.schema import STORE
from marginalia.sources.pages import export_pages
from marginalia.sources.store import ChunkStore

REPO = "https://github.com/acme/kit"
GUIDE = "## Setup\nInstall the widget.\n## Usage\nCall render with a widget.\n"
CODE = "export function render(w: string): string {\n  return w;\n}\n"


class CountingChat:
    """Counts its calls in files, so that calls of other processes count too."""

    in_task = True

    def __init__(self, folder):
        self.folder = str(folder)

    def __call__(self, systems, prompts):
        for _ in prompts:
            os.close(os.open(f"{self.folder}/{os.urandom(8).hex()}", os.O_CREAT))
        return [f"1. about {len(prompt)}" for prompt in prompts]

    def calls(self):
        return len(os.listdir(self.folder))


def write_files(root, files):
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content, newline="")


class Kit:
    """A repository folder, its store, and a run over both."""

    def __init__(self, spark, tmp_path, store=None):
        self.spark, self.tmp = spark, tmp_path
        self.files: dict[str, str] = {}
        self.store = store or ChunkStore(spark, str(tmp_path / "store"), buckets=4)
        self.calls = tmp_path / "calls"
        self.calls.mkdir()
        self.repos = repos_table(spark, main_url=REPO, directory=None)
        self.runs = 0

    def run(self, files=None, languages=()):
        if files is not None:
            self.files = files
        root = self.tmp / f"repo{self.runs}"
        self.runs += 1
        write_files(root, self.files)
        corpus = scan_corpus(read_files(self.spark, str(root), REPO), self.repos)
        return ingest(corpus, self.repos, self.store, HashedWords(16), CountingChat(self.calls), IngestOptions(languages=languages))

    def rows(self):
        return {(r["filepath"], r["chunk_id"]): r for r in self.store.read().collect()}


@pytest.fixture
def kit(spark, tmp_path):
    return Kit(spark, tmp_path)


def counters(stats):
    return stats["upserted_chunks"], stats["moved_chunks"], stats["deleted_chunks"]


def test_ingest_follows_the_files(kit):
    ts = ("typescript",)
    files = {"docs/guide.mdx": GUIDE, "src/render.ts": CODE, "src/a.test.ts": CODE, "README.md": "no"}
    stats = kit.run(files, ts)
    assert counters(stats) == (3, 0, 0)
    assert (stats["processed_documents"], stats["skipped_documents"]) == (2, 0)
    first = kit.rows()
    assert set(first) == {("docs/guide.mdx", 0), ("docs/guide.mdx", 1), ("src/render.ts", 0)}
    setup, code = first["docs/guide.mdx", 0], first["src/render.ts", 0]
    assert setup["chunk_title"] == "Setup" and setup["source_type"] == "doc"
    assert setup["github_url"] == f"{REPO}/blob/main/docs/guide.mdx#setup"
    assert setup["contextual_text"].endswith("---" + setup["content"])
    assert len(setup["embedding"]) == 16
    assert (code["chunk_title"], code["entity_type"], code["start_line"], code["end_line"]) == ("render", "function", 1, 3)
    assert code["contextual_text"].startswith("about ") and code["contextual_text"].endswith("\n---\n" + code["content"])
    assert kit.calls and len(os.listdir(kit.calls)) == 3

    # The same files again: nothing to do, no call, no new version.
    version = kit.store.version()
    assert counters(kit.run(None, ts)) == (0, 0, 0)
    assert kit.store.version() == version and len(os.listdir(kit.calls)) == 3

    # A new section in front moves the others without a call for them.
    grown = "## New\nFresh words.\n" + GUIDE
    assert counters(kit.run({**kit.files, "docs/guide.mdx": grown}, ts)) == (1, 2, 0)
    assert len(os.listdir(kit.calls)) == 4
    rows = kit.rows()
    assert rows["docs/guide.mdx", 1]["id"] == setup["id"]
    assert rows["docs/guide.mdx", 0]["chunk_title"] == "New"

    # Without its first section again: the freed place is taken at once.
    assert counters(kit.run({**kit.files, "docs/guide.mdx": GUIDE}, ts)) == (0, 2, 1)
    rows = kit.rows()
    assert rows["docs/guide.mdx", 0]["id"] == setup["id"] and len(rows) == 3

    # A renamed file keeps its rows, a deleted one loses them.
    assert counters(kit.run({"docs/moved.mdx": GUIDE}, ts)) == (0, 2, 1)
    rows = kit.rows()
    assert set(rows) == {("docs/moved.mdx", 0), ("docs/moved.mdx", 1)}
    assert rows["docs/moved.mdx", 0]["id"] == setup["id"]
    assert rows["docs/moved.mdx", 0]["created_at"] == setup["created_at"]
    assert rows["docs/moved.mdx", 0]["updated_at"] > setup["updated_at"]
    assert counters(kit.run()) == (0, 0, 0)


def test_store_writes_changed_buckets_only(spark, tmp_path, kit):
    kit.run({f"docs/f{i}.mdx": f"text {i}" for i in range(8)})
    before = kit.rows()
    kit.run({**kit.files, "docs/f3.mdx": "changed"})
    written = {p.name for p in (tmp_path / "store" / "data").glob("v=2-*/bucket=*")}
    assert len(written) == 1
    after = kit.rows()
    assert {k: v for k, v in after.items() if k[0] != "docs/f3.mdx"} == {k: v for k, v in before.items() if k[0] != "docs/f3.mdx"}
    assert after["docs/f3.mdx", 0]["content"] == "changed"
    # The version before stays readable, and one file is read out of its bucket.
    assert {r["content"] for r in kit.store.read(1).collect()} == {f"text {i}" for i in range(8)}
    assert [r["content"] for r in kit.store.read_file("docs/f3.mdx").collect()] == ["changed"]
    wanted = spark.createDataFrame([(after["docs/f1.mdx", 0]["checksum"],)], "checksum string")
    assert [r["filepath"] for r in kit.store.read_checksums(wanted).collect()] == ["docs/f1.mdx"]


def test_one_checksum_with_a_third_of_all_rows(kit):
    """Identical files share one chunk, at the last place; removing it moves the row."""
    same = {f"docs/same{i:02d}.mdx": "the same words" for i in range(10)}
    other = {f"docs/other{i:02d}.mdx": f"other {i}" for i in range(20)}
    assert counters(kit.run({**same, **other})) == (21, 0, 0)
    assert ("docs/same09.mdx", 0) in kit.rows()
    del same["docs/same09.mdx"]
    assert counters(kit.run({**same, **other})) == (0, 1, 0)
    assert ("docs/same08.mdx", 0) in kit.rows()


def test_answers(spark, kit):
    kit.run({"docs/guide.mdx": GUIDE})
    store = kit.store.read()
    questions = spark.createDataFrame(
        [(1, " render the widget "), (2, "zzz qqq"), (3, "  ")], "query_id int, question string"
    )
    postings = build_postings(store)
    answers, sources = answer(
        questions,
        store,
        CitingChat(),
        HashedWords(16),
        postings,
        build_vocabulary(postings),
        defaults=SearchDefaults(similarity_threshold=0.99),
    )
    found = {r["query_id"]: r["answer"] for r in answers.collect()}
    assert found == {1: "re: render the widget", 2: NO_CONTEXT_ANSWER}
    (source,) = sources.collect()
    assert source["query_id"] == 1 and source["final_url"].startswith(REPO)


def test_moves_to_one_place(spark):
    rows = [(1, "a", 0), (2, "b", 0), (3, "c", 0), (4, "d", 0)]
    store = spark.createDataFrame(rows, "id long, filepath string, chunk_id int").select(
        "*", F.lit("mdx").alias("source_type"), F.lit("u").alias("github_url")
    )
    moves = spark.createDataFrame(
        [(1, "x", 0), (2, "x", 0), (3, "d", 0)], "id long, filepath string, chunk_id int"
    ).select("*", F.lit("doc").alias("source_type"), F.lit("v").alias("github_url"))
    found = {r["id"]: (r["filepath"], r["source_type"], r["github_url"]) for r in apply_moves(store, moves).collect()}
    assert found == {
        1: ("x", "doc", "v"),
        2: ("__moving__2", "doc", "u"),
        3: ("__moving__3", "doc", "u"),
        4: ("d", "mdx", "u"),
    }
    swap = spark.createDataFrame([(1, "b", 0), (2, "a", 0)], "id long, filepath string, chunk_id int").select(
        "*", F.lit("doc").alias("source_type"), F.lit(None).cast("string").alias("github_url")
    )
    swapped = apply_moves(store, swap)
    assert {r["id"]: r["filepath"] for r in swapped.collect()} == {1: "b", 2: "a", 3: "c", 4: "d"}
    assert location_conflicts(swapped).count() == 0


def test_numbers_are_dense_and_repeatable(spark):
    rows = spark.range(5000).select(F.concat(F.lit("f"), F.col("id")).alias("filepath"), F.lit(0).alias("chunk_id"))
    first = number_rows(rows, ["filepath", "chunk_id"], 7)
    assert first.agg(F.min("id"), F.max("id"), F.count_distinct("id")).first()[:] == (8, 5007, 5000)
    again = number_rows(rows.repartition(3), ["filepath", "chunk_id"], 7)
    assert first.exceptAll(again).count() == 0


def test_upsert_twice_changes_nothing(spark):
    rows = spark.range(20).select(
        F.concat(F.lit("f"), F.col("id")).alias("filepath"),
        F.lit(0).alias("chunk_id"),
        *[F.lit("x").alias(c) for c in ("content", "contextual_text", "chunk_title", "checksum", "source_type")],
    )
    once = upsert_chunks(spark.createDataFrame([], STORE), rows)
    assert once.agg(F.min("id"), F.max("id"), F.count("*")).first()[:] == (1, 20, 20)
    twice = upsert_chunks(once, rows)
    stamps = ("created_at", "updated_at")
    assert twice.drop(*stamps).exceptAll(once.drop(*stamps)).count() == 0
    assert twice.count() == 20


def test_scopes_and_repositories(spark):
    files = spark.createDataFrame(
        [
            ("https://github.com/o/docs/tree/v2/site", "site/a.mdx", "x"),
            ("https://github.com/o/docs/tree/v2/site", "other/b.mdx", "x"),
            ("https://github.com/o/code", "lib/src/a.ts", "x"),
            ("https://github.com/o/code", "lib/gen/b.ts", "x"),
            ("https://github.com/o/code", "lib/src/c.d.ts", "x"),
            ("https://github.com/o/code", "lib/src/d.mdx", "x"),
            ("bad url", "lib/src/e.ts", "x"),
        ],
        "repo_url string, path string, content string",
    )
    repos = repos_table(
        spark,
        docs=[{"repo_url": "https://github.com/o/docs/tree/v2/site", "branch": "v2"}],
        code=[
            {"repo_url": "https://github.com/o/code", "directory": "lib", "include_directories": ["src"]},
            {"repo_url": "bad url"},
        ],
    )
    corpus = scan_corpus(files, repos)
    found = {r["path"]: (r["type"], r["relative_path"], r["source_url"]) for r in corpus.collect()}
    assert found == {
        "site/a.mdx": ("mdx", "a.mdx", "https://github.com/o/docs/blob/v2/site/a.mdx"),
        "lib/src/a.ts": ("typescript", "src/a.ts", "https://github.com/o/code/blob/main/lib/src/a.ts"),
    }
    assert union_repos(corpus, corpus).count() == 4
    with pytest.raises(ValueError):
        repos_table(spark)


def test_snapshot_and_page_export(spark, tmp_path):
    corpus = spark.createDataFrame([("mdx", "a.mdx", "x"), ("python", "b.py", "y")], "type string, path string, content string")
    for _ in range(2):
        save_snapshot(corpus, str(tmp_path / "snapshot"))
    assert spark.read.parquet(str(tmp_path / "snapshot")).count() == 2
    pages = spark.range(50).select(
        F.format_string("p%02d", "id").alias("slug"), F.concat(F.lit("T"), "id").alias("title"), F.lit("body").alias("text")
    )
    export_pages(pages, str(tmp_path / "pages"))
    parts = sorted((tmp_path / "pages").glob("part-*"))
    text = "".join(p.read_text() for p in parts)
    assert text == "".join(f"# T{i}\n\nbody\n\n" for i in range(50))
