"""Scans of several repositories: what is opened, and what fails alone."""

import os

from pyspark.sql import functions as F

from marginalia.sources.corpus import read_files, repos_table, scan_corpus, scan_repositories
from tests.test_ingest import write_files

KIT, TOOL, GONE, BAD = (f"https://github.com/acme/{name}" for name in ("kit", "tool", "gone", "bad"))


def break_file(path):
    """A checksum beside the file that does not fit: reading it fails."""
    (path.parent / f".{path.name}.crc").write_bytes(b"crc\0\0\0\2\0\1\2\3\4")


def huge_file(path):
    """A file without content on disk that is too long to be read."""
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "wb") as file:
        file.truncate(3 << 30)


def test_files_that_do_not_belong_are_not_opened(spark, tmp_path):
    root = tmp_path / "kit"
    write_files(root, {"docs/a b.mdx": "one", "docs/c+d.mdx": "two", "src/ok.ts": "x", "other/e.mdx": "no", "src/é.ts": "y"})
    for name in ("src/gen/big.test.ts", "lib/big.ts", "other/big.mdx"):
        huge_file(root / name)
    repos = repos_table(
        spark,
        docs=[{"repo_url": KIT, "directory": "docs"}],
        code=[{"repo_url": KIT, "include_directories": ["src"], "exclude_patterns": ["gen/"]}],
    )
    scan = scan_repositories(spark, {KIT: str(root)}, repos)
    found = {r["path"]: r["content"] for r in scan.corpus.collect()}
    assert found == {"docs/a b.mdx": "one", "docs/c+d.mdx": "two", "src/ok.ts": "x", "src/é.ts": "y"}
    (status,) = scan.status().collect()
    assert status.asDict() == {"repo_url": KIT, "readable": True, "files": 4, "unread": 0, "error": None}
    names = read_files(spark, str(root), KIT, lambda path: path.startswith("docs/"))
    assert {r["path"] for r in names.select("path").collect()} == {"docs/a b.mdx", "docs/c+d.mdx"}


def test_repositories_fail_alone(spark, tmp_path):
    write_files(tmp_path / "kit", {"a.mdx": "one", "b.mdx": "two", "c.ts": "x"})
    write_files(tmp_path / "tool", {"a.mdx": "three", "b.mdx": "four"})
    break_file(tmp_path / "tool" / "b.mdx")
    urls = [KIT, TOOL, GONE, BAD, "https://example.org/x", "https://github.com/acme/unknown"]
    repos = repos_table(spark, docs=[{"repo_url": u} for u in urls], code_url=KIT)
    folders = {KIT: str(tmp_path / "kit"), TOOL: str(tmp_path / "tool"), GONE: str(tmp_path / "nowhere"), BAD: "nofs://host/x"}
    scan = scan_repositories(spark, folders, repos)
    stored = str(tmp_path / "corpus")
    scan.corpus.write.parquet(stored)
    corpus = spark.read.parquet(stored)
    assert {(r["repo_url"], r["content"]) for r in corpus.collect()} == {(KIT, "one"), (KIT, "two"), (KIT, "x"), (TOOL, "three")}
    status = {r["repo_url"]: r for r in scan.status(corpus).collect()}
    assert set(status) == set(urls)
    assert (status[KIT]["readable"], status[KIT]["files"]) == (True, 3)
    assert (status[TOOL]["readable"], status[TOOL]["files"], status[TOOL]["unread"]) == (False, 2, 1)
    assert status[TOOL]["error"] == "cannot be read: b.mdx"
    assert "does not exist" in status[GONE]["error"] and "nofs" in status[BAD]["error"]
    assert status[urls[4]]["error"] and status[urls[5]]["error"] == "no folder is given"
    assert not any(status[u]["readable"] for u in (GONE, BAD, urls[4], urls[5]))


def test_contents_are_not_sent_to_meet_the_repositories(spark, tmp_path):
    files = spark.createDataFrame([(KIT, "docs/a.mdx", "one")], "repo_url string, path string, content string")
    plan = scan_corpus(files, repos_table(spark, docs_url=KIT))._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan


def test_no_repository_at_all_can_be_read(spark):
    scan = scan_repositories(spark, {}, repos_table(spark, docs_url=KIT))
    assert scan.corpus.count() == 0 and scan.status().count() == 1 and scan.listed.count() == 0
    assert os.path.basename(KIT) == "kit" and scan.failed.filter(F.col("error").isNull()).count() == 0
