"""Random inputs against straightforward models of the rules."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from marginalia.operators.keywords import build_postings, keyword_search
from marginalia.operators.sections import chunk_sections
from marginalia.operators.split import chunk_documents
from marginalia.operators.vectors import vector_search

ANY = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow]
)
LINES = ["", " ", "## A", "##", "## 'B' ", "### c", "## x [!toc]", "title", 'title: "T"', "title:", "text", "  more ", "\ttitle : y"]
document = st.lists(st.sampled_from(LINES), max_size=14).map("\n".join)


def model_sections(text):
    """Line by line: open section, flush before a heading, keep it when it has no content."""
    sections, lines, title, full = [], [], "", False

    def flush():
        nonlocal lines, title, full
        if full:
            sections.append((title or "Intro", "\n".join(lines)))
            lines, title, full = [], "", False

    def strip_pairs(value):
        value = value.strip()
        for a, b in ('""', "''", "[]", "()"):
            if len(value) >= 2 and value[0] == a and value[-1] == b:
                value = value[1:-1].strip()
        return value

    for raw in text.split("\n"):
        line = raw.strip()
        if re.match(r"##(?!#)(\s|$)", line) and not line.endswith("[!toc]"):
            flush()
            title = strip_pairs(re.sub(r"^#+\s*", "", line))
        elif line.startswith("title"):
            found = re.search(r"title\s*:\s*(.+)", line)
            title = strip_pairs(found[1]) if found else "Intro"
        elif line:
            full = True
        lines.append(line)
    flush()
    return sections


@ANY
@given(st.lists(document, min_size=20, max_size=60))
def test_sections_equal_line_model(spark, documents):
    frame = spark.createDataFrame(list(enumerate(documents)), "i int, content string")
    found = {i: [] for i in range(len(documents))}
    for row in chunk_sections(frame).orderBy("i", "chunk_id").collect():
        found[row["i"]].append((row["chunk_title"], row["chunk_content"]))
    assert found == {i: model_sections(text) for i, text in enumerate(documents)}


@ANY
@given(st.lists(document, min_size=10, max_size=30), st.integers(1, 6))
def test_parts_never_exceed_the_limit_and_lose_no_words(spark, documents, limit):
    frame = spark.createDataFrame(list(enumerate(documents)), "filepath int, content string")
    parts = {}
    for row in chunk_documents(frame, limit).orderBy("filepath", "chunk_id").collect():
        assert -(-len(row["chunk_content"]) // 4) <= limit
        rows = parts.setdefault(row["filepath"], [])
        assert row["chunk_id"] == len(rows)
        rows.append(row["chunk_content"])
    for i, text in enumerate(documents):
        expected = "".join("".join(content.split()) for _, content in model_sections(text))
        assert "".join("".join(p.split()) for p in parts.get(i, [])) == expected


def model_rank(tokens, units_by_alternative):
    """Brute force over all stretches. ``tokens``: (word, position, weight); a unit is a word list."""
    present = [
        [u for u in units if u[0] == "+"] for units in units_by_alternative
    ]
    words = {p: (w, weight) for w, p, weight in tokens}

    def spans(unit):
        return [(p, p + len(unit) - 1) for p in words if all(words.get(p + j, (None,))[0] == w for j, w in enumerate(unit))]

    alive = []
    for units in units_by_alternative:
        positive = [u[1] for u in units if u[0] == "+"]
        negative = [u[1] for u in units if u[0] == "-"]
        if positive and all(spans(u) for u in positive) and not any(spans(u) for u in negative):
            alive.append([spans(u) for u in positive])
    if not alive:
        return None
    asked = {w for units in present for _, unit in units for w in unit}
    ends = sorted(words)
    good = [
        (a, b)
        for a in ends
        for b in ends
        if a <= b and any(all(any(a <= s and e <= b for s, e in unit) for unit in units) for units in alive)
    ]
    minimal = [c for c in good if not any(d != c and c[0] <= d[0] and d[1] <= c[1] for d in good)]
    rank = 0.0
    for a, b in minimal:
        weights = [weight for p, (w, weight) in words.items() if a <= p <= b and w in asked]
        noise = (b - a) - (len(weights) - 1)
        rank += len(weights) / sum(1 / w for w in weights) / (1 + max(noise, 0))
    return rank


QUERIES = {
    "a": [[("+", ["a"])]],
    "a b": [[("+", ["a"]), ("+", ["b"])]],
    '"a b"': [[("+", ["a", "b"])]],
    "a or d": [[("+", ["a"])], [("+", ["d"])]],
    "a -d": [[("+", ["a"]), ("-", ["d"])]],
    '"a b" c': [[("+", ["a", "b"]), ("+", ["c"])]],
    "a b or d": [[("+", ["a"]), ("+", ["b"])], [("+", ["d"])]],
    "a b c": [[("+", ["a"]), ("+", ["b"]), ("+", ["c"])]],
    '"a a"': [[("+", ["a", "a"])]],
    'a -"b c"': [[("+", ["a"]), ("-", ["b", "c"])]],
    "a -c or d -b": [[("+", ["a"]), ("-", ["c"])], [("+", ["d"]), ("-", ["b"])]],
}
words = st.lists(st.sampled_from("abcdx"), max_size=9).map(" ".join)


@ANY
@given(st.lists(st.tuples(words, words), min_size=10, max_size=25))
def test_keyword_rank_equals_brute_force(spark, documents):
    rows = [(i, title, content, "") for i, (title, content) in enumerate(documents)]
    store = spark.createDataFrame(rows, "id long, chunk_title string, content string, contextual_text string")
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")
    found = {
        (r["query_id"], r["id"]): round(r["keyword_rank"], 6)
        for r in keyword_search(build_postings(store, english=False), queries, k=1000).collect()
    }
    expected = {}
    for number, units in enumerate(QUERIES.values()):
        for i, (title, content) in enumerate(documents):
            tokens = [(w, n + 1, 1.0) for n, w in enumerate(title.split())]
            tokens += [(w, len(tokens) + n + 1, 0.4) for n, w in enumerate(content.split())]
            rank = model_rank(tokens, units)
            if rank is not None:
                expected[number, i] = round(rank, 6)
    assert found == expected


@ANY
@given(st.lists(st.lists(st.integers(-3, 3), min_size=3, max_size=3), min_size=5, max_size=30), st.integers(1, 4))
def test_vector_search_equals_brute_force(spark, vectors, k):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    store = spark.createDataFrame(rows, "id long, embedding array<float>")
    queries = store.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    found = {
        (r["query_id"], r["vector_rank"]): r["id"] for r in vector_search(store, queries, k, 0.5).collect()
    }

    def cosine(a, b):
        norm = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / norm, 9) if norm else -2.0

    expected = {}
    for q, a in rows:
        hits = sorted((-cosine(a, b), i) for i, b in rows if cosine(a, b) >= 0.5)
        expected |= {(q, n + 1): i for n, (_, i) in enumerate(hits[:k])}
    assert found == expected


def test_packs_of_any_size_give_the_same_hits(spark, monkeypatch):
    from marginalia.operators import vectors

    rows = [(i, [float(i % 7), float(i % 5), 1.0] if i % 11 else None) for i in range(60)] + [(60, [0.0, 0.0, 0.0])]
    store = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    queries = store.select(
        F.concat(F.lit("q"), "id").alias("query_id"), F.col("embedding").alias("query_embedding"), (1 + F.col("id") % 4).alias("match_count")
    )
    whole = sorted(map(tuple, vector_search(store, queries, 3, 0.1).collect()))
    assert len(whole) > 100
    for name, value in (("PACK_BYTES", 24 * 7), ("MOST_PENDING", 20), ("_MOST_PACKS", 2)):
        monkeypatch.setattr(vectors, name, value)
        assert sorted(map(tuple, vector_search(store, queries, 3, 0.1).collect())) == whole
    empty = store.limit(0)
    assert vector_search(empty, queries, 3).collect() == vector_search(store, queries.limit(0), 3).collect() == []


def test_vectors_of_other_lengths_are_an_error(spark):
    store = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "query_id long, query_embedding array<float>")
    with pytest.raises(Exception, match="vectors of 2 values expected"):
        vector_search(store, queries, 1).collect()


def test_paced_lanes_stay_below_the_limits():
    from marginalia.config import CallLimits
    from marginalia.operators.model_calls import Pace

    now, slept = [100.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    limits = CallLimits(concurrency=2, requests_per_minute=60, tokens_per_minute=600, paced=True)
    pace = Pace(limits, lambda: now[0], sleep)
    for text in ("a" * 4, "a" * 4, "a" * 400, "a"):
        pace.wait([text])
    # A lane has half of the limits: a request every two seconds, five tokens a second.
    assert slept == [2.0, 2.0, 20.0]
    free = Pace(CallLimits(paced=False), lambda: now[0], sleep)
    free.wait(["a" * 1000])
    free.wait(["a"])
    assert len(slept) == 3


def test_limits_are_held_unless_the_model_is_in_the_task(spark):
    from marginalia.config import CallLimits, Settings
    from marginalia.operators.model_calls import HashedWords, held_limits, in_lanes

    class Endpoint:
        pass

    for limits in (CallLimits(), Settings().chat, Settings().embedding):
        assert held_limits(limits, Endpoint()).paced and not held_limits(limits, HashedWords()).paced
    assert not held_limits(CallLimits(paced=False), Endpoint()).paced
    rows = spark.range(100).repartition(3)
    assert in_lanes(rows, CallLimits(concurrency=5), Endpoint()).rdd.getNumPartitions() == 5
    assert in_lanes(rows, CallLimits(concurrency=5), HashedWords()) is rows
