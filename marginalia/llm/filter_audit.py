"""Audit of filters that are applied one after the other, in every order.

Each document's failures are a mask, one bit per filter, and all that an audit needs to know of the
documents is how many stand in each cell of part and mask. The orders are enumerated by a recursive
common table expression: a level extends every prefix of filters by each letter that it does not hold,
carries the bits that were applied before, and says for each mask what the new step does with it. The
cells then meet these rows by mask, and a prefix's counts go to all orders that begin with it.

Copies fail by comparison with the whole table. The smallest key of a text is found by a partial
aggregation per hash; only it is joined back, by hash and key, so a text that a third of the rows share
neither gathers them nor makes a hot join.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.storage import cut
from marginalia.llm.text import or_empty

#: What separates words.
SPACE = r"[\x20\x09-\x0D]+"
#: Letter of a filter and when it fails, from the text and its words.
CONDITIONS: Mapping[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 50,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
    "C": lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
    "D": lambda text, words: text.rlike(r"[#$%&*|]"),
}
COPIES = "E"
#: Seven filters would have 13,699 prefixes of 128 masks, more rows than a recursion may make.
MOST_FILTERS = 6

#: What a step does with the documents of a mask.
ROLES = {
    "kept": "mask & (applied | bit) = 0",
    "removed": "mask & applied = 0 and mask & bit != 0",
    "redundant": "mask & applied != 0 and mask & bit != 0",
    "unique_fails": "mask = bit",
}


def enumerate_steps(spark: SparkSession, letters: str) -> DataFrame:
    """(prefix, step, letter, mask) and the roles: one row per prefix of distinct letters and mask."""
    if not 0 < len(letters) <= MOST_FILTERS or len(set(letters)) != len(letters):
        raise ValueError(f"between 1 and {MOST_FILTERS} different letters are needed")
    bits = ", ".join(f"struct('{letter}' as letter, {1 << n} as bit)" for n, letter in enumerate(letters))
    roles = ", ".join(f"{condition} as {role}" for role, condition in ROLES.items())
    return spark.sql(f"""
        with recursive steps(prefix, step, letter, applied, bit, mask) as (
          select '', 0, '', 0, 0, mask from (select explode(sequence(0, {(1 << len(letters)) - 1})) as mask)
          union all
          select concat(prefix, unused.letter), step + 1, unused.letter, applied | bit, unused.bit, mask
          from (
            select *, explode(filter(array({bits}), f -> f.bit & (applied | bit) = 0)) as unused
            from steps where step < {len(letters)}))
        select prefix, step, letter, mask, {roles} from steps where step > 0""")


def failures(
    docs: DataFrame,
    labels: DataFrame,
    conditions: Mapping[str, Callable[[Column, Column], Column]] = CONDITIONS,
    key: str = "doc_id",
    text: str = "text",
    part: str = "source",
) -> DataFrame:
    """(key, part, hash, mask, n, good, toxic): documents with their failures but for copies, and how many
    rows are alike in all of these. Written to the shared folder."""
    content = or_empty(text)
    texts = docs.select(F.col(key).alias("key"), or_empty(part).alias("part"), content.alias("text"))
    words = texts.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    bits = [
        F.when(condition(F.col("text"), F.col("words")), 1 << n).otherwise(0)
        for n, condition in enumerate(conditions.values())
    ]
    mask = sum(bits[1:], bits[0]) if bits else F.lit(0)
    alike = (
        words.select("key", "part", F.unhex(F.sha2("text", 256)).alias("hash"), mask.alias("mask"))
        .groupBy("key", "part", "hash", "mask")
        .agg(F.count("*").alias("n"))
    )
    marks = (
        labels.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(
            F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
            F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
        )
    )
    marked = alike.join(marks, "key", "left").fillna(False, ["good", "toxic"])
    return cut(marked.select("key", "part", "hash", "mask", "n", "good", "toxic"), "audit-failures")


def mask_cells(failed: DataFrame, copy_bit: int) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each cell, after the rows of which a smaller key
    has the same text got ``copy_bit``. A null key is neither smaller nor larger than any."""
    lowest = failed.filter("key is not null").groupBy("hash").agg(F.min("key").alias("low"))
    firsts = failed.join(
        lowest.withColumnRenamed("hash", "low_hash"), (F.col("hash") == F.col("low_hash")) & (F.col("key") == F.col("low"))
    )
    as_copy = F.when(F.col("key").isNull(), F.col("mask")).otherwise(F.col("mask") + copy_bit)
    counted = ["part", "n", "good", "toxic"]
    moves = (
        failed.select(*counted, as_copy.alias("mask"))
        .unionByName(firsts.select(*counted, "mask"))
        .unionByName(firsts.select("part", (-F.col("n")).alias("n"), "good", "toxic", (F.col("mask") + copy_bit).alias("mask")))
    )
    number = F.col("n")
    return (
        moves.groupBy("part", "mask")
        .agg(
            F.sum(number).alias("n"),
            F.sum(F.when(F.col("good"), number).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("toxic"), number).otherwise(0)).alias("toxic"),
        )
        .filter("n > 0")
    )


def audit(
    docs: DataFrame,
    labels: DataFrame,
    conditions: Mapping[str, Callable[[Column, Column], Column]] = CONDITIONS,
    copies: str = COPIES,
    key: str = "doc_id",
    text: str = "text",
    part: str = "source",
) -> DataFrame:
    """One row per part, order of all filters and step: part, filter_order, step, letter, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost and shapley (what the step's filter removes, summed up over
    all orders).

    ``conditions`` name the filters and say when they fail; ``copies`` names the one that fails for rows
    of whose text a smaller key has an equal one. Every filter sees the whole table, removed rows
    included. At most six filters.

    A null text is empty, a null part is the empty string, a null key never fails as a copy and makes
    no other row fail. Rows that repeat a key all count; none is smaller than the other. A document is good or
    toxic if any of its labels says so; labels without a document count for nothing. Other columns are not read. An
    empty table gives no rows.
    """
    letters = "".join(conditions) + copies
    # Bounded by the number of filters: 10,400 rows for five.
    steps = cut(enumerate_steps(docs.sparkSession, letters), "audit-steps")
    failed = failures(docs, labels, conditions, key, text, part)
    cells = cut(mask_cells(failed, 1 << len(conditions)), "audit-cells")
    number = lambda role, what="n": F.sum(F.when(F.col(role), F.col(what)).otherwise(0))
    by_prefix = (
        cells.join(F.broadcast(steps), "mask")
        .groupBy("part", "prefix", "step", "letter")
        .agg(
            *[number(role).alias(role) for role in ROLES],
            number("removed", "good").alias("good_lost"),
            number("removed", "toxic").alias("toxic_lost"),
        )
    )
    orders = (
        steps.filter((F.col("step") == len(letters)) & (F.col("mask") == 0))
        .select(F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("at"))
        .select("filter_order", F.expr("substring(filter_order, 1, at)").alias("prefix"))
    )
    return by_prefix.join(F.broadcast(orders), "prefix").select(
        "part",
        "filter_order",
        "step",
        "letter",
        *ROLES,
        "good_lost",
        "toxic_lost",
        F.sum("removed").over(Window.partitionBy("part", "letter")).alias("shapley"),
    )
