"""Packing of lines against its definition, and declarations and lists of any length."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from marginalia.operators.entities import extract_entities
from marginalia.operators.numbered import has_surplus, parse_numbered
from marginalia.operators.split import line_ranges, split_texts


def walked(tokens, blank, limit, newline):
    """Line by line: an open part takes lines until the next would go over the limit."""
    parts, start, used = [], None, 0

    def close(before):
        if start is not None:
            parts.append((start, before - 1, False))

    for i, (n, is_blank) in enumerate(zip(tokens, blank)):
        if n > limit:
            close(i)
            parts.append((i, i, True))
            start = None
        elif start is None:
            if not is_blank:
                start, used = i, n
        elif used + n + newline > limit:
            close(i)
            start, used = i, n
        else:
            used += n + newline
    close(len(tokens))
    return parts


def test_ranges_equal_the_walk():
    rng = random.Random(7)
    for _ in range(3000):
        size, limit, newline = rng.randint(0, 12), rng.randint(1, 9), rng.choice([0, 1, 1, 2])
        tokens = [rng.choice([0, 0, 1, 2, 3, 8, 12]) for _ in range(size)]
        blank = [n == 0 or rng.random() < 0.1 for n in tokens]
        found = line_ranges(np.array(tokens, np.int32), np.array(blank, bool), limit, newline)
        assert list(zip(*found)) == walked(tokens, blank, limit, newline)


def test_a_million_lines_take_seconds(spark):
    count = 1_000_000
    text = "some words of a line\n" * (count - 1) + "end"
    df = spark.createDataFrame([(text,), ("short",), (None,), ("",)], "text string")
    started = time.time()
    rows = split_texts(df.withColumn("t", F.array("text")), "t", F.lit(60)).select(
        F.size(F.get("parts", F.lit(0))).alias("n"), F.get(F.get("parts", F.lit(0)), F.lit(5))["first"].alias("first")
    )
    found = {tuple(r) for r in rows.collect()}
    # Six tokens a line with its end: nine lines and the last one's 60th token.
    assert {r for r in found if r[1] is not None} == {(-(-count // 10), 50)}
    assert time.time() - started < 60


def test_impl_headers_of_any_length(spark):
    names = ",\n".join(f"    T{i}: Clone" for i in range(60))
    code = f"impl<\n{names},\n> Store<u8> {{\n    pub fn get(&self) -> u8 {{\n        1\n    }}\n}}\n\nfn last() {{\n}}\n"
    files = spark.createDataFrame([("src/a.rs", code, "rust")], "filepath string, content string, type string")
    found = {(r["entity_type"], r["name"]) for r in extract_entities(files, languages=("rust",)).collect()}
    assert ("impl", "Store") in found and ("function", "last") in found
    assert any(name == "get" for _, name in found)


def test_left_out_blocks_are_marked(spark):
    rows = [("a\n\nb\n\nc", 2), ("a\n\nb", 2), ("1. a\n2. b\n\nmore\n\nagain", 2), ("text", 2), (None, 1)]
    df = spark.createDataFrame(rows, "t string, n int")
    found = df.select(has_surplus(F.col("t"), F.col("n")), parse_numbered(F.col("t"), F.col("n"))).collect()
    assert [r[0] for r in found][:4] == [True, False, False, False]
    assert found[0][1] == ["a", "b"]
