"""Resampling, filter audit and packing against brute force, and odd rows."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marginalia.llm import filter_audit, packing, queries, resampling
from tests.llm import brute
from tests.llm.test_operators import DOCS, ODD, SF, clashing, none, odd, rows_of  # noqa: F401

LABELS = "doc_id long, quality int, toxic int"


# --- resampling


def test_crc_matrices_equal_zlib():
    rng = random.Random(3)
    values = [rng.randbytes(n) for n in (0, 1, 1, 2, 5, 5, 5, 31, 32, 1024, 1025, 5000) for _ in range(rng.randint(1, 4))]
    rng.shuffle(values)
    found = resampling.crc32_of(pa.array(values, pa.large_binary()))
    assert found.tolist() == [zlib.crc32(v) for v in values]
    assert resampling.crc32_of(pa.array([], pa.large_binary())).tolist() == []


def test_features_do_not_cross_texts(monkeypatch):
    monkeypatch.setattr(resampling, "SLICE_FEATURES", 3)
    texts = ["one, two  three", None, "", "Four", "... five-SIX"]
    counts, slices = resampling.feature_buckets(texts, 2, 1 << 20)
    assert counts.tolist() == [3, 0, 0, 1, 2]
    found = sorted((int(o), int(b)) for owner, bucket in slices for o, b in zip(owner, bucket))
    wanted = [(0, "one"), (0, "two"), (0, "three"), (0, "one two"), (0, "two three"), (3, "four")]
    wanted += [(4, "five"), (4, "six"), (4, "five six")]
    assert found == sorted((o, zlib.crc32(f.encode()) % (1 << 20)) for o, f in wanted)


@pytest.mark.parametrize("longest", [1, 3])
def test_sample_equals_brute_force(spark, longest):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    planned = resampling.plan_sample(
        spark.read.parquet(f"{SF}/documents.parquet").repartition(5),
        spark.read.parquet(f"{SF}/benchmark.parquet"),
        longest=longest,
        carry=["doc_id"],
    )
    found = rows_of(planned, "__row.doc_id", "n_features", "weight", "score", "rank")
    assert found == sorted(brute.sample_plan(docs, target, longest), key=repr)
    assert sum(row[4] is not None for row in found) > 5


def test_sample_of_odd_rows(odd, none, clashing):  # noqa: F811
    results = ["n_features", "weight", "score", "rank"]
    options = {"percent": 50, "least_words": 1}
    planned = resampling.plan_sample(odd, odd, **options)
    wanted = brute.sample_plan([r[:2] for r in ODD], [r[1] for r in ODD], percent=50, least=1)
    assert rows_of(planned, "__row.doc_id", *results) == sorted(wanted, key=repr)
    drawn = resampling.resample(odd, odd, **options)
    assert drawn.columns == [*odd.columns, *results]
    assert sorted(r["rank"] for r in drawn.collect()) == [1, 2, 3, 4]
    named = resampling.resample(clashing.withColumn("rank", F.lit("own")).withColumn("__key", F.lit(1)), odd, **options)
    assert rows_of(named, "doc_id", "rank") == rows_of(drawn, "doc_id", "rank")
    assert resampling.plan_sample(none, odd).count() == resampling.plan_sample(none, none).count() == 0
    assert resampling.plan_sample(odd, none).filter("rank is not null").count() == 0  # one text of 20 words
    short = resampling.plan_sample(odd, none, percent=100, least_words=0)
    assert sorted(r["rank"] for r in short.collect()) == list(range(1, 12))


def test_sample_numbers_a_hot_row(spark):
    docs = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same words").alias("text")
    )
    planned = resampling.plan_sample(docs.repartition(6), docs.limit(1), percent=100, least_words=1)
    found = sorted((r["rank"], -r["score"], r["__row"]["doc_id"]) for r in planned.collect())
    assert [r[0] for r in found] == list(range(1, 3001))
    assert [r[1:] for r in found] == sorted(r[1:] for r in found)


# --- filter audit


def audited(docs, labels):
    names = ["part", "filter_order", "step", "letter", *filter_audit.ROLES, "good_lost", "toxic_lost", "shapley"]
    return [tuple(r) for r in filter_audit.audit(docs, labels).select(*names).collect()]


def test_audit_equals_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "Bc", "d$", "e"] + [f"w{i}" for i in range(k)]) for _ in range(n)) for k, n in
             ((0, 60), (5, 3), (90, 70), (200, 80), (300, 49), (300, 51))]
    docs = [(rng.randint(1, 60), rng.choice(texts), rng.choice(["x", "y", None, ""])) for _ in range(90)]
    docs += [(None, texts[0], "x"), (None, None, "z"), (5, "", "z"), (5, "", "z"), (6, None, "x")]
    labels = [(rng.randint(1, 80), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(50)] + [(None, 1, 1)]
    found = audited(
        spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4),
        spark.createDataFrame(labels, LABELS),
    )
    wanted = brute.audit(docs, [row for row in labels if row[0] is not None])
    assert len(found) == len(wanted) == 4 * 600
    assert set(found) == wanted


def test_audit_of_odd_rows(spark, odd, none, clashing):  # noqa: F811
    labels = spark.createDataFrame([(6, 1, 1), (6, 0, 0), (99, 1, 1)], LABELS)
    wanted = brute.audit([(r[0], r[1], r[3]) for r in ODD], [(6, 1, 1)])
    assert set(audited(odd, labels)) == wanted
    extra = clashing.withColumns({name: F.lit("own") for name in ("part", "mask", "hash", "n", "letter", "step")})
    assert set(audited(extra, labels)) == wanted
    assert audited(none, labels) == []
    assert len(audited(odd, labels.limit(0))) == len(wanted)


def test_audit_takes_other_filters(spark, odd):  # noqa: F811
    long_words = {"L": lambda text, words: F.exists(words, lambda w: F.length(w) > 4)}
    found = filter_audit.audit(odd, spark.createDataFrame([], LABELS), long_words, copies="X")
    assert {tuple(r) for r in found.groupBy("filter_order").agg(F.count("*")).collect()} == {("LX", 8), ("XL", 8)}
    with pytest.raises(ValueError):
        filter_audit.enumerate_steps(spark, "ABCDEFG")


# --- packing


def test_tree_finds_the_tightest_window():
    rng = random.Random(11)
    for most in (1, 7, 8, 100):
        tree, rooms = packing.RoomTree(most), []
        for number in range(400):
            needed = rng.randint(0, most)
            wanted = brute.tightest(rooms, needed) if rng.random() < 0.6 else None
            if wanted is None and rng.random() < 0.7:
                rooms.append(needed)
                tree.put(needed, number)
                continue
            wanted = brute.tightest(rooms, needed)
            found = tree.take(needed)
            assert (found and found[0]) == wanted
            if found:
                rooms.remove(wanted)


def packed_rows(df):
    return [r.asDict() for r in df.collect()]


def check_packed(rows, wanted, window=2048):
    """``wanted``: (key, tokens) per document. Every token lies in one piece, sequences have no gaps."""
    sequences, documents = {}, {}
    for row in rows:
        ids = np.frombuffer(row["ids"], "<u4").tolist()
        assert len(ids) == row["length"] > 0
        sequences.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
        documents.setdefault((row["doc_id"], row["doc_tokens"]), []).append((row["start"], ids))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    expected = {}
    for key, tokens in wanted:
        expected.setdefault((key, len(tokens)), []).append(tokens)
    assert documents.keys() == expected.keys()
    for key, texts in expected.items():
        if len(texts) == 1:
            assert sum((ids for _, ids in sorted(documents[key])), []) == texts[0]
        else:
            assert sorted(sum((ids for _, ids in documents[key]), [])) == sorted(sum(texts, []))
    return [sum(n for _, n in pieces) for pieces in sequences.values()]


def tokens_of(text, tokenizer):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))


def test_packed_tokens_are_the_texts(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wanted = [(r["doc_id"], tokens_of(r["text"], tokenizer)) for r in docs.collect()]
    rows = packed_rows(packing.pack(docs.coalesce(1)))
    fill = check_packed(rows, wanted)
    assert sum(n < 2048 * 0.99 for n in fill) <= 1
    digests = queries.QUERIES["op13_packing"](spark, SF)
    found = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in digests.collect()}
    by_key = dict(wanted)
    cut = {(r["doc_id"], r["start"]): r["length"] for r in digests.collect()}
    for (key, start), crc in found.items():
        part = by_key[key][start : start + cut[key, start]]
        assert crc == zlib.crc32(np.array(part, "<u4").tobytes())


def test_words_give_the_tokens_of_the_text(tokenizer):
    encoder = packing.Encoder(public_tokenizers.path(packing.VOCABULARY))
    odd_texts = [
        "It's we'll I'D they've\tnew\nline nbsp em\u0085nel\u001cfs \u001f",
        "é ́ İSTANBUL ΣΑΣ Σ. ﬁ ½ x² 123 4.5 <|endoftext|>a <|startoftext|> <|end oftext|>",
        "日本語 テキスト 🙂🙂 a​b ﻿ \x00 \x7f '' '' 's's",
        "", " ", "\n\n", "x" * 5000, "A1b2 " * 300,
    ]
    assert encoder.by_word
    rng = random.Random(8)
    letters = "abzABZ09'sdtrevml.,-<|>_~!éÉßÿÀØøñ×÷ª½¯"
    odd_texts += [" ".join("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(50)) for _ in range(60)]
    for _ in range(2):  # the second time from memory
        for text in odd_texts:
            assert np.frombuffer(encoder.tokens(text), "<u4").tolist() == tokens_of(text, tokenizer)[:-1]


def test_other_vocabularies_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = packing.Encoder(path)
    text = "It's  two\nlines "
    assert not encoder.by_word
    assert np.frombuffer(encoder.tokens(text), "<u4").tolist() == Tokenizer.from_file(path).encode(text).ids


def test_known_words_are_bounded(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "MOST_WORDS", 8)
    encoder = packing.Encoder(public_tokenizers.path(packing.VOCABULARY))
    text = " ".join(f"w{i % 23}" for i in range(200))
    assert np.frombuffer(encoder.tokens(text), "<u4").tolist() == tokens_of(text, tokenizer)[:-1]
    assert len(encoder) + len(encoder.older) <= 8


def test_windows_that_fit_badly_are_topped_up():
    rng = random.Random(2)
    for lengths in ([60] * 50, [51] * 99, [1] * 7, [100] * 3, [rng.randint(1, 100) for _ in range(300)], []):
        pieces = [packing.Piece(i, 0, rng.randbytes(4 * n)) for i, n in enumerate(lengths)]
        windows = packing.top_up(packing.best_fit(pieces, 100), 100, 1)
        sizes = [sum(p.length for p in w) for w in windows]
        assert all(n <= 100 for n in sizes) and sum(n < 99 for n in sizes) <= 1
        rebuilt = {}
        for piece in (p for w in windows for p in w):
            rebuilt.setdefault(piece.document, {})[piece.start] = piece.tokens
        assert [b"".join(t for _, t in sorted(rebuilt[p.document].items())) for p in pieces] == [p.tokens for p in pieces]


def test_packing_of_odd_rows(spark, odd, none, clashing, tokenizer):  # noqa: F811
    wanted = [(r[0], tokens_of(r[1], tokenizer)) for r in ODD]
    check_packed(packed_rows(packing.pack(odd)), wanted)
    extra = clashing.withColumns({name: F.lit("own") for name in ("doc", "part", "sequence", "offset", "ids")})
    check_packed(packed_rows(packing.pack(extra)), wanted)
    assert packing.pack(none).collect() == []
    # Small windows and rounds: many flushes, and pieces that wait for the next one.
    rows = packed_rows(packing.pack(odd.coalesce(1), window=16, round_tokens=40))
    fill = check_packed(rows, wanted, window=16)
    assert sum(n < 16 for n in fill) <= 1
    assert rows == packed_rows(packing.pack(odd.coalesce(1), window=16, round_tokens=40))


# --- the near-duplicate stage


def test_repeated_keys_are_judged_by_their_texts(spark):
    from marginalia.llm import simhash

    rows = [
        (5, "alpha beta gamma delta epsilon zeta", "a"), (5, "one two three four five six seven", "b"),
        (6, "alpha beta gamma delta epsilon zeta", "c"), (7, "one two three four five six seven", "d"),
        (8, "quite another text of some words", "e"), (8, "quite another text of some words", "f"),
        (None, "alpha beta gamma delta epsilon zeta", "g"), (None, None, "h"), (9, "", "i"), (10, None, "j"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted(map(tuple, simhash.drop_near_duplicates(docs.repartition(n)).collect()), key=repr) for n in (1, 3)]
    assert runs[0] == runs[1]
    kept = [(row[0], row[1]) for row in runs[0]]
    assert kept.count((8, rows[4][1])) == 1 and len(kept) == 6
    assert set(kept) == {(5, rows[0][1]), (5, rows[1][1]), (8, rows[4][1]), (None, rows[6][1]), (None, None), (9, "")}
