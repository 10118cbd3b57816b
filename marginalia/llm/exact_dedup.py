"""Exact deduplication by progressive refinement.

Length and prefix hash come from one scan and are counted together; only rows of a (length, prefix)
group of two or more are read in full and hashed. Which rows those are is told to the second scan by
a bitmap of fixed size, so no text is shuffled to find out. A bit may stand for several groups: then
a text is hashed that need not be, and the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.storage import cut
from marginalia.llm.text import ascii_lower, or_empty

PREFIX_CHARS = 128
#: Bits of the bitmap of surviving groups: 4096 rows of 4 KB, 16 MB, is the most that is broadcast.
FILTER_BITS = 1 << 27


def _slot(text: Column, prefix_chars: int) -> Column:
    """The bit, from 1, of a text's length and prefix hash."""
    prefix = ascii_lower(F.substring(text, 1, prefix_chars))
    return F.pmod(F.xxhash64(F.octet_length(text), prefix), F.lit(FILTER_BITS)) + 1


def mark_suspects(docs: DataFrame, text: str, flag: str, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """``docs`` with a boolean column: another row may have an equal text.

    False is certain. Columns of ``docs`` stay as they are; ``flag`` must not be one of them.
    """
    content = or_empty(text)
    refined = docs.groupBy(
        F.octet_length(content).alias("__length"),
        F.xxhash64(ascii_lower(F.substring(content, 1, prefix_chars))).alias("__prefix"),
        _slot(content, prefix_chars).alias("__slot"),
    ).agg(F.count("*").alias("__rows"))
    survivors = refined.filter("__rows > 1")
    bitmaps = survivors.groupBy(F.bitmap_bucket_number("__slot").alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("__slot")).alias("__bitmap")
    )
    placed = docs.withColumn("__at", _slot(content, prefix_chars))
    bit = F.bitmap_bit_position("__at")
    byte = F.conv(F.hex(F.substring("__bitmap", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.expr("cast(shiftright(__byte, cast(__bit as int)) & 1 as int) = 1")
    return (
        placed.join(F.broadcast(bitmaps), F.bitmap_bucket_number("__at") == F.col("__bucket"), "left")
        .withColumn("__byte", byte)
        .withColumn("__bit", bit % 8)
        .withColumn(flag, F.coalesce(is_set, F.lit(False)))
        .drop("__at", "__bucket", "__bitmap", "__byte", "__bit")
    )


def group_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", hash_all: bool = False
) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest key of a
    group stays; a null key loses against any other. Rows that repeat the key and the text of the row
    that stays are marked as kept like it. text_sha256 is null for texts that were told apart before
    the full hash, unless ``hash_all`` asks for it. An empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("__key"), or_empty(text).alias("__text"))
    marked = mark_suspects(rows, "__text", "__suspect")
    digest = F.sha2(ascii_lower(F.col("__text")), 256)
    hashed = cut(
        marked.select(
            "__key",
            "__suspect",
            (digest if hash_all else F.when(F.col("__suspect"), digest)).alias("text_sha256"),
        ),
        "exact-hashes",
    )
    suspects = hashed.filter("__suspect")
    # Written, so that both sides of the join are dealt out for it and a hot group can be split.
    groups = cut(
        suspects.groupBy("text_sha256").agg(
            F.max("__key").alias("keep_id"), F.count("*").alias("group_size")
        ),
        "exact-groups",
    )
    kept = F.col("__key").eqNullSafe(F.col("keep_id"))
    grouped = suspects.join(groups, "text_sha256").select(
        F.col("__key").alias(key), "keep_id", "group_size", kept.alias("kept"), "text_sha256"
    )
    single = hashed.filter("not __suspect").select(
        F.col("__key").alias(key),
        F.col("__key").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    return grouped.unionByName(single)


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, that of the largest key.

    Rows that repeat key and text give one row. Texts that are told apart by length and prefix pass
    without a shuffle; only the others are moved, by key and full hash.
    """
    packed = docs.select(
        F.struct("*").alias("__row"), F.col(key).alias("__key"), or_empty(text).alias("__text")
    )
    marked = mark_suspects(packed, "__text", "__suspect")
    suspects = marked.filter("__suspect").withColumn("__hash", F.sha2(ascii_lower(F.col("__text")), 256))
    winners = cut(
        suspects.groupBy("__hash").agg(F.max("__key").alias("__keep")).filter("__hash is not null"),
        "exact-winners",
    )
    joined = suspects.join(
        winners.withColumnRenamed("__hash", "__winner"),
        (F.col("__hash") == F.col("__winner")) & F.col("__key").eqNullSafe(F.col("__keep")),
    )
    once = joined.groupBy("__winner").agg(F.first("__row").alias("__row"))
    return marked.filter("not __suspect").select("__row.*").unionByName(once.select("__row.*"))
