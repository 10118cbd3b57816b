"""Importance resampling of documents towards a target distribution.

Features of a text are its runs of words; each goes to one of a fixed number of buckets by the CRC-32
of its bytes. A bucket's gain is the logarithm of how much more frequent it is in the target than in
the corpus; a document's weight is the mean gain of its features. Gumbel noise drawn from a hash of the
key is added to the weight, and the documents with the highest sums are a sample without replacement
in proportion to the weights.

CRCs are computed in matrices: the distinct features of a slice of text are grouped by their length in
bytes into two-dimensional arrays, the CRCs of a group are updated column by column, and the buckets are
scattered back to the places of the features. Tasks hand on one count per bucket, so nothing but narrow rows is
ever shuffled, and only the gains, one number per bucket, reach the driver and all tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.storage import cut
from marginalia.llm.text import WORD_BYTES

BUCKETS = 10_000
LONGEST = 1
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
#: Texts are taken together up to so many bytes, and the features of one slice are at most so many.
GROUP_BYTES = 4 << 20
SLICE_FEATURES = 1 << 19
#: Features of more bytes are single long words, which would make matrices of one row: zlib folds them.
MOST_COLUMNS = 1024

_POLYNOMIAL = 0xEDB88320


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), table >> np.uint32(1))
    return table


_TABLE = _crc_table()


def crc32_columns(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of every row of a two-dimensional array of bytes."""
    crc = np.full(matrix.shape[0], 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        crc = _TABLE[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    return ~crc


def crc32_of(features: pa.LargeBinaryArray) -> np.ndarray:
    """CRC-32 of every value, in matrices of the values of equal length."""
    offsets = np.frombuffer(features.buffers()[1], np.int64)[: len(features) + 1]
    data = np.frombuffer(features.buffers()[2] or b"", np.uint8)
    starts, lengths = offsets[:-1], np.diff(offsets)
    order = np.argsort(lengths, kind="stable")
    widths, firsts = np.unique(lengths[order], return_index=True)
    found = np.empty(len(lengths), np.uint32)
    for width, rows in zip(widths.tolist(), np.split(order, firsts[1:])):
        if width > MOST_COLUMNS:
            found[rows] = [zlib.crc32(data[s : s + width]) for s in starts[rows].tolist()]
        else:
            found[rows] = crc32_columns(data[starts[rows][:, None] + np.arange(width)])
    return found


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    picked = data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], ends - starts)]
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(picked)]
    )


def feature_buckets(
    texts: Sequence[str | None], longest: int = LONGEST, buckets: int = BUCKETS
) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """The number of words of each text; and, slice by slice, of every feature its text's index and its bucket."""
    parts = [t.encode().translate(WORD_BYTES) if t else b"" for t in texts]
    joined = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    inside = joined != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[0::2], edges[1::2]
    bounds = np.cumsum([0] + [len(p) + 1 for p in parts])
    counts = np.diff(np.searchsorted(starts, bounds))
    owner = np.repeat(np.arange(len(parts)), counts)
    # One space behind each word, so that a run of words is a run of bytes.
    inside[ends] = True
    data = joined[inside]
    lengths = ends - starts
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = starts + lengths

    def slices() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for n in range(1, longest + 1):
            for at in range(0, len(starts) - n + 1, SLICE_FEATURES):
                first = np.arange(at, min(at + SLICE_FEATURES, len(starts) - n + 1))
                first = first[owner[first] == owner[first + n - 1]]
                coded = _spans(data, starts[first], ends[first + n - 1]).dictionary_encode()
                crc = crc32_of(coded.dictionary)
                places = coded.indices.to_numpy(zero_copy_only=False)
                yield owner[first], (crc % np.uint32(buckets))[places]

    return counts, slices()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Rows with their texts (the last column), some megabytes of text at a time."""
    for batch in batches:
        texts, size, first = [], 0, 0
        for row, text in enumerate(batch.column(batch.num_columns - 1)):
            texts.append(text.as_py())
            size += len(texts[-1] or "")
            if size >= GROUP_BYTES or row + 1 == batch.num_rows:
                yield batch.slice(first, len(texts)), texts
                texts, size, first = [], 0, row + 1


def bucket_counts(
    docs: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS
) -> DataFrame:
    """(bucket, n): how many features of all texts a bucket holds. Buckets without any have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for _, texts in _groups(batches):
            for _, found in feature_buckets(texts, longest, buckets)[1]:
                held += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["bucket", "n"])

    counted = docs.select(text).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares) for each bucket, from two tables of counts.

    The driver holds two numbers per bucket.
    """
    s, t = (np.zeros(buckets), np.zeros(buckets))
    for counts, held in ((corpus, s), (target, t)):
        for bucket, n in counts.collect():
            held[bucket] = n
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(
    docs: DataFrame, gain: np.ndarray, row: Column, text: str = "text", longest: int = LONGEST
) -> DataFrame:
    """__row (as given), __words (number of words), n_features and weight, the floored mean gain of the
    text's features, 0 without any."""
    packed = docs.select(row.alias("__row"), F.col(text).alias("__text"))
    kind = packed.schema["__row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _groups(batches):
            words, slices = feature_buckets(texts, longest, len(gain))
            features, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for owner, found in slices:
                features += np.bincount(owner, minlength=len(texts))
                sums = np.bincount(owner, weights=gain[found], minlength=len(texts))
                total += sums.astype(np.int64)
            weight = np.floor_divide(total, np.maximum(features, 1))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(words.astype(np.int64)), pa.array(features), pa.array(weight)],
                names=["__row", "__words", "n_features", "weight"],
            )

    return packed.mapInArrow(run, f"__row {kind}, __words long, n_features long, weight long")


def gumbel(key: Column, seed: int = SEED) -> Column:
    """floor(1000 times a Gumbel variable), from the SHA-256 of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((place + 0.5) / 4294967296.0)))


def plan_sample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: __row (its columns, or those of ``carry``), n_features, weight, score
    and rank, which counts the drawn documents from 1 and is null for the others.

    Of the documents with at least ``least_words`` words, ``percent`` of a hundred (rounded down) are
    drawn, the highest scores first; of equal scores the smaller key comes first and a null key last.
    A null text has no words, weighs 0 and is not drawn unless ``least_words`` is 0. Rows that repeat a key have the same
    noise and are documents of their own; of such rows that are equal in all results any may come first. The
    target's texts count as many times as they stand there; an empty one leaves corpus frequencies
    alone to decide. An empty table gives no rows.
    """
    gain = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, text, longest, buckets), buckets)
    row = F.struct(F.struct(*(carry or docs.columns)).alias("own"), F.col(key).alias("key"))
    scored = cut(
        weigh(docs, gain, row, text, longest).select(
            F.col("__row.own").alias("__row"),
            F.col("__row.key").alias("__key"),
            "n_features",
            "weight",
            (F.col("weight") + gumbel(F.col("__row.key"), seed)).alias("score"),
            (F.col("__words") >= least_words).alias("__able"),
        ),
        "resampling-scores",
    )
    ranked = _ranked(scored.filter("__able"), percent)
    left = scored.filter("not __able").withColumn("rank", F.lit(None).cast("long"))
    names = ["__row", "n_features", "weight", "score", "rank"]
    return ranked.select(names).unionByName(left.select(names))


def _ranked(scored: DataFrame, percent: int) -> DataFrame:
    """Rows with their rank among all, as far as it is drawn. Sorted ranges are numbered by themselves;
    the sizes of the ranges before give each its first rank."""
    ranges = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The last column of the order deals rows that are equal in all others out to several ranges.
    order = [F.col("score").desc(), F.col("__key").asc_nulls_last(), "weight", "n_features", "__n"]
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = cut(
        scored.withColumn("__n", F.monotonically_increasing_id())
        .repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("__range"), inside.alias("__inside")),
        "resampling-order",
    )
    sizes = numbered.groupBy("__range").agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    whole = F.sum("__size").over(Window.partitionBy())
    offsets = sizes.select(
        "__range",
        F.coalesce(before, F.lit(0)).alias("__before"),
        whole.alias("__whole"),
    ).withColumn("__drawn", F.expr(f"__whole * {int(percent)} div 100"))
    rank = F.col("__before") + F.col("__inside") + 1
    return numbered.join(F.broadcast(offsets), "__range").withColumn(
        "rank", F.when(rank <= F.col("__drawn"), rank)
    )


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents: the columns of ``docs`` as far as no result has the name, then n_features,
    weight, score and rank."""
    planned = plan_sample(docs, target, **options).filter("rank is not null")
    results = ["n_features", "weight", "score", "rank"]
    own = [F.col("__row")[c].alias(c) for c in docs.columns if c not in results]
    return planned.select(*own, *results)
