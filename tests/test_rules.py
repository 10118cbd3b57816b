"""Rules on small literal inputs."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions.links import docs_url, heading_slug
from marginalia.functions.paths import (
    is_excluded,
    is_included,
    join_paths,
    normalize_path,
    parse_repo_url,
    relative_path,
)
from marginalia.functions.stem import english_stem
from marginalia.functions.text import clean_title, language_of_path, one_decimal
from marginalia.functions.tokens import count_tokens
from marginalia.operators.numbered import parse_numbered
from marginalia.operators.sections import chunk_sections
from marginalia.operators.split import chunk_documents, enforce_token_limit


def values(spark, rows, schema, *columns):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}")
    return [tuple(r)[1:] for r in frame.select("_i", *columns).orderBy("_i").collect()]


SECTIONS = [
    ("plain text", [("Intro", "plain text")]),
    ("## A\none\n## B\ntwo", [("A", "## A\none"), ("B", "## B\ntwo")]),
    ("## A\n\n## B\ntwo", [("B", "## A\n\n## B\ntwo")]),
    ("a\n## On this page [!toc]\nb", [("Intro", "a\n## On this page [!toc]\nb")]),
    ('title: "X"\n\nbody', [("X", 'title: "X"\n\nbody')]),
    ("## A\ntext\ntitle of things\nmore", [("Intro", "## A\ntext\ntitle of things\nmore")]),
    ("##\nbody", [("Intro", "##\nbody")]),
    ("### deep\nbody", [("Intro", "### deep\nbody")]),
    ("one\r\n  ## B  \r\ntwo", [("Intro", "one"), ("B", "## B\ntwo")]),
    ("```\n## code\nx\n```", [("Intro", "```"), ("code", "## code\nx\n```")]),
    ("a\n## end", [("Intro", "a")]),
    ("", []),
    ("\n \n", []),
    ("##nospace\nx", [("Intro", "##nospace\nx")]),
    (" ##   (A) \nx", [("A", "##   (A)\nx")]),
]


def test_sections(spark):
    frame = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(SECTIONS)], "i int, content string")
    found = {i: [] for i in range(len(SECTIONS))}
    for row in chunk_sections(frame).orderBy("i", "chunk_id").collect():
        assert row["chunk_id"] == len(found[row["i"]])
        found[row["i"]].append((row["chunk_title"], row["chunk_content"]))
    assert found == {i: expected for i, (_, expected) in enumerate(SECTIONS)}


PACKED = [
    ("abcd\nefgh", ["abcd\nefgh"]),
    ("abcdefgh\nabcd", ["abcdefgh", "abcd"]),
    ("abcd\n\n\nabcdefgh", ["abcd\n\n", "abcdefgh"]),
    ("\n\nabcd\nabcd\nabcd", ["abcd\nabcd", "abcd"]),
    ("ab\n" + "x" * 30 + "\ncd", ["ab", "x" * 12, "x" * 12, "x" * 6, "cd"]),
    ("\n" * 40, ["\n" * 40]),
    ("    \n" * 8, ["    \n" * 8]),
]


@pytest.mark.parametrize("whole", [True, False])
def test_packing(spark, whole):
    rows = [(f"f{i}", text) for i, (text, _) in enumerate(PACKED)]
    frame = spark.createDataFrame(rows, "filepath string, chunk_content string")
    if whole:
        chunks = frame.select(
            "filepath", F.lit(0).alias("chunk_id"), "chunk_content", F.lit(" T ").alias("chunk_title"), F.lit("").alias("checksum")
        )
        result = enforce_token_limit(chunks, 3)
        expected_of = lambda parts: parts
    else:
        result = chunk_documents(frame.withColumnRenamed("chunk_content", "content"), 3)
        expected_of = None
    found = {}
    for row in result.orderBy("filepath", "chunk_id").collect():
        found.setdefault(row["filepath"], []).append(row["chunk_content"])
        assert row["chunk_id"] == len(found[row["filepath"]]) - 1
    for i, (text, parts) in enumerate(PACKED):
        if whole:
            assert found[f"f{i}"] == expected_of(parts), text
        elif text.strip():
            # Lines of a section are trimmed; these have no outer spaces.
            assert found[f"f{i}"] == parts


class Characters:
    def encode(self, text):
        return [ord(c) for c in text]

    def decode(self, tokens):
        return "".join(map(chr, tokens))


def test_tokenizer(spark):
    assert values(spark, [("abc",), ("",), (None,), ("<|eot_id|>",)], "t string", count_tokens(F.col("t"), Characters)) == [
        (3,),
        (0,),
        (0,),
        (len("&lt;&#124;eot_id&#124;&gt;"),),
    ]
    frame = spark.createDataFrame([("f", "abcd\nef\n" + "x" * 9)], "filepath string, content string")
    rows = chunk_documents(frame, 7, tokenizer=Characters).orderBy("chunk_id").collect()
    assert [r["chunk_content"] for r in rows] == ["abcd\nef", "x" * 7, "xx"]
    assert [r["chunk_title"] for r in rows] == ["Intro_1", "Intro_2", "Intro_3"]


def test_titles(spark):
    cases = {
        '"a"': "a",
        "'a'": "a",
        "[a]": "a",
        "(a)": "a",
        "“a”": "a",
        "‘a’": "a",
        "\"'[a]'\"": "a",
        "['a']": "'a'",
        '"a': '"a',
        '"': '"',
        '""': "",
        "  a ": "a",
    }
    rows = [(raw,) for raw in cases]
    assert [r[0] for r in values(spark, rows, "t string", clean_title(F.col("t")))] == list(cases.values())


def test_excludes_and_includes(spark):
    cases = [
        ("src/a.test.ts", ["*.test.ts"], True),
        ("src/generated.ts", ["gen*"], True),
        ("src/latest/a.ts", ["test/"], True),
        ("test_a.py", ["test_*.py"], False),
        ("src/a.ts", ["a.ts"], True),
        ("src/b.ts", [], False),
    ]
    found = values(
        spark, [c[:2] for c in cases], "p string, x array<string>", is_excluded(F.col("p"), F.col("x"))
    )
    assert [r[0] for r in found] == [c[2] for c in cases]
    for path, patterns, expected in cases:
        assert values(spark, [(path,)], "p string", is_excluded(F.col("p"), patterns)) == [(expected,)]
    included = is_included(F.col("p"), "base", ["lib"])
    rows = [("base/lib/a.ts",), ("lib/a.ts",), ("base/library/a.ts",), ("other/lib/a.ts",), ("base/lib",)]
    assert [r[0] for r in values(spark, rows, "p string", included)] == [True, True, False, False, True]


def test_paths(spark):
    rows = [(" a / b//c ",), ("a/../b",), ("",), ("/x/",)]
    found = values(spark, rows, "p string", normalize_path(F.col("p")), join_paths("r", F.col("p")))
    assert found == [("a/b/c", "r/a/b/c"), (None, None), ("", "r"), ("x", "r/x")]
    assert values(spark, [("a/b",), ("ab/c",)], "p string", relative_path("a", F.col("p"))) == [("b",), ("ab/c",)]


def test_repo_urls(spark):
    cases = {
        "https://github.com/o/r": ("o", "r", "main", "", None),
        "https://github.com/o/r.git": ("o", "r", "main", "", None),
        "https://github.com/o/r/tree/v1/docs/a": ("o", "r", "v1", "docs/a", None),
        "https://github.com/o/r/blob/v1/x.md": ("o", "r", "v1", "x.md", None),
        "https://github.com/o/r/docs": ("o", "r", "main", "docs", None),
        "https://github.com/o/r/tree": ("o", "r", "main", "", None),
        "https://gitlab.com/o/r": (None, None, None, None, "unsupported host"),
        "https://github.com/o": (None, None, None, None, "owner and repository required"),
        "no url": (None, None, None, None, "invalid url"),
    }
    found = values(spark, [(u,) for u in cases], "u string", parse_repo_url(F.col("u")))
    assert [tuple(r[0]) for r in found] == list(cases.values())


def test_links(spark):
    rows = [("content/docs/a/index.mdx",), ("index.mdx",), ("guide/b c.md",), ("x.ts",)]
    found = values(spark, rows, "p string", docs_url(F.col("p"), "https://d.dev/"), docs_url(F.col("p"), None))
    assert [r[0] for r in found] == ["https://d.dev/a", "https://d.dev/index", "https://d.dev/guide/b%20c", None]
    assert [r[1] for r in found] == [None] * 4
    slugs = values(spark, [("Hello, World! (v2)",), ("A_b - c",), ("Straße é",)], "t string", heading_slug(F.col("t")))
    assert [r[0] for r in slugs] == ["hello-world-v2", "a_b---c", "straße-é"]


def test_languages_and_numbers(spark):
    paths = ["a.py", "a.TSX", "a.jsx", "a.rs", "a.go", "a.java", "a.cxx", "a.c", "a.unknown", None]
    found = values(spark, [(p,) for p in paths], "p string", language_of_path(F.col("p")))
    assert [r[0] for r in found] == "python typescript javascript rust go java cpp c typescript typescript".split()
    numbers = [76.35, 100.0, 0.05, 0.0, 99.95, -1.25, 12.25]
    found = values(spark, [(x,) for x in numbers], "x double", one_decimal(F.col("x")))
    # Ties go away from zero, everything else by the exact binary value.
    assert [r[0] for r in found] == ["76.3", "100.0", "0.1", "0.0", "100.0", "-1.3", "12.3"]


def test_numbered(spark):
    cases = [
        ("1. a\n2. b", 2, ["a", "b"]),
        ("1: a\n2) b\nmore\n\n", 2, ["a", "b\nmore"]),
        ("intro\n1. a\n1. b\n2.\nc", 2, ["a\nb", "c"]),
        ("first\n\nsecond\n\nthird", 2, ["first", "second"]),
        ("just text", 2, ["just text", "just text"]),
        ("1. a\n2. b", 1, ["1. a\n2. b"]),
    ]
    found = values(
        spark, [c[:2] for c in cases], "t string, n int", parse_numbered(F.col("t"), F.col("n"))
    )
    assert [r[0] for r in found] == [c[2] for c in cases]


def test_stems():
    pairs = {
        "running": "run",
        "ponies": "poni",
        "caresses": "caress",
        "hoping": "hope",
        "hopping": "hop",
        "relational": "relat",
        "conditional": "condit",
        "generously": "generous",
        "communication": "communic",
        "flies": "fli",
        "dying": "die",
        "sky": "sky",
        "happily": "happili",
        "adjustment": "adjust",
        "controlling": "control",
        "proceed": "proceed",
        "geology": "geolog",
    }
    assert {word: english_stem(word) for word in pairs} == pairs


def test_a_new_language_needs_endings_and_a_reader(spark, monkeypatch):
    from marginalia.functions import paths
    from marginalia.operators import entities
    from marginalia.sources.corpus import file_glob

    def read(path, content):
        for number, line in enumerate(content.split("\n")):
            yield {"filepath": path, "entity_no": number, "entity_type": "function", "name": line, "qualified_name": line,
                   "code": line, "start_line": number + 1, "end_line": number + 1, "is_exported": False}

    monkeypatch.setitem(entities.EXTRACTORS, "shell", lambda files: entities.by_file(files, read))
    files = spark.createDataFrame([("a/b.SH", "x\ny"), ("a/c.ts", "")], "filepath string, content string")
    with pytest.raises(ValueError):
        entities.extract_entities(files, languages=["shell"])
    monkeypatch.setitem(paths.CODE_ENDINGS, "shell", ("sh",))
    assert [r["name"] for r in entities.extract_entities(files).orderBy("entity_no").collect()] == ["x", "y"]
    assert "[sS][hH]" in file_glob()


def test_a_failing_keyword_search_leaves_the_vectors(spark):
    from pyspark.sql import functions as F

    from marginalia.operators.answers import retrieve
    from marginalia.operators.keywords import build_postings
    from marginalia.operators.model_calls import HashedWords, embed_chunks

    rows = [(1, "t", "red apple", "red apple"), (2, "t", "blue plum", "blue plum")]
    chunks = spark.createDataFrame(rows, "id long, chunk_title string, content string, contextual_text string")
    embedded = embed_chunks(chunks, HashedWords(16))
    broken = build_postings(chunks, english=False).withColumn("weight", F.raise_error(F.lit("gone")).cast("double"))
    questions = spark.createDataFrame([(7, "apple")], "query_id long, question string")
    with pytest.warns(UserWarning, match="keyword search failed"):
        hits = retrieve(questions, embedded, HashedWords(16), broken).collect()
    assert hits[0]["id"] == 1 and hits[0]["keyword_rank"] is None
