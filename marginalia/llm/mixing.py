"""Mix sources to target weights along a curriculum.

A source's target share is a number of words; its weight over training time, from 0 to 1, is a
piecewise linear schedule. Its documents stand in a fixed random order; a document's demand is the
stretch of words between its start and its end, once per repeat. The integral of the schedule says how
many words the source has given by a time; its inverse gives every copy its training position, and
the corpus is range-sorted by position.

All of it is DataFrame work. Running sums go through buckets of the random order, so that a source
with most of the rows is spread over ``buckets`` tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.storage import cut
from marginalia.llm.text import WORD, or_empty

#: Weights of the sources in code point order, repeating, and how each weight runs over time: knots
#: (time, height) of a line. The first kind is met early, the last one late.
WEIGHTS = (5, 2, 1)
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (1.0, 1.5)),
)
MOST_REPEATS = 3
#: Hexadecimal digits of the order key that make a bucket: 3 give 4096 buckets per source.
BUCKET_DIGITS = 3


def _segments(knots: Sequence[tuple[float, float]]) -> Column:
    """A schedule as segments with the share of the integral at both ends."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    whole, before, parts = sum(areas), 0.0, []
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
        values = {"t0": t0, "w0": w0 / whole, "slope": (w1 - w0) / (t1 - t0) / whole, "c0": before}
        before += area / whole
        parts.append(F.struct(*[F.lit(float(v)).alias(k) for k, v in values.items()]))
    return F.array(*parts)


def position_of(share: Column, segments: Column) -> Column:
    """The time by which a schedule has given ``share`` (0 to 1) of its words."""
    last = F.element_at(F.filter(segments, lambda s: s["c0"] <= share), -1)
    due = share - last["c0"]
    root = F.sqrt(F.greatest(last["w0"] * last["w0"] + 2 * last["slope"] * due, F.lit(0.0)))
    return F.least(last["t0"] + F.coalesce(F.try_divide(2 * due, last["w0"] + root), F.lit(0.0)), F.lit(1.0))


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources numbered from 0 in key order, without bringing them to one task: sorted ranges, whose
    sizes (one row per range) give the offsets."""
    spark = sources.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_ranges = cut(
        sources.repartitionByRange(ranges, "__source")
        .sortWithinPartitions("__source")
        .select("*", F.spark_partition_id().alias("__range"), inside.alias("__inside")),
        "mix-sources",
    )
    sizes = sorted_ranges.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__range", F.coalesce(before, F.lit(0)).alias("__offset"))
    rank = F.col("__offset") + F.col("__inside")
    return sorted_ranges.join(F.broadcast(offsets), "__range").select(
        "__source", "source_size", rank.alias("__rank")
    )


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(__source, source_size) with __kind (index of the weight) and target.

    Targets share the sum of all sizes by weight. A target above ``most`` times its source's size is
    set to that, and what it leaves is shared among the others by weight, until none is above. The
    driver holds four numbers per turn; a turn settles at least one source.
    """
    kinds = F.array(*[F.lit(w) for w in weights])
    kind = (F.col("__rank") % len(weights)).cast("int")
    weighted = cut(
        _ranked(sources)
        .withColumn("__kind", kind)
        .withColumn("__weight", F.element_at(kinds, F.col("__kind") + 1).cast("decimal(19,0)")),
        "mix-weights",
    )
    bound = F.col("source_size").cast("decimal(19,0)") * most

    def exact(value) -> Column:
        return F.lit(int(value)).cast("decimal(19,0)")

    rest, weight_left, settled = None, None, -1
    while True:
        free = F.lit(True)
        if rest is not None:
            free = F.col("__weight") * exact(rest) <= bound * exact(weight_left)
        total, left, capped, count = weighted.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)),
            F.coalesce(F.sum(F.when(free, F.col("__weight"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~free, bound)), F.lit(0)),
            F.count(F.when(~free, 1)),
        ).first()
        if count == settled:
            break
        rest, weight_left, settled = total - capped, left, count
    share = (F.col("__weight") * exact(rest)).cast("double") / F.lit(float(weight_left or 1))
    above = F.col("__weight") * exact(rest) > bound * exact(weight_left)
    return weighted.withColumn("target", F.when(above, bound.cast("double")).otherwise(share))


def plan_mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    most: int = MOST_REPEATS,
    bucket_digits: int = BUCKET_DIGITS,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: __row (its columns, or those of ``carry``), size, source_size, target
    and positions, an array with the training position, 0 to 1, of every copy that the mix takes.

    A null text has size 0, a null source is a source of its own behind all others, a null key stands
    first in the order of its source. All documents of a source get the same number of whole passes;
    a last part of a pass takes the documents whose middle lies inside it, so a source's words are
    within half a document of its target. Documents of size 0 are taken like others of their source
    and count for nothing. Rows that repeat a key stand next to each other. The order depends on keys
    only, so reruns agree. An empty table gives no rows.
    """
    order = F.md5(or_empty(F.col(key).cast("string")))
    rows = docs.select(
        F.struct(*(carry or ["*"])).alias("__row"),
        F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source)).alias("__source"),
        order.alias("__order"),
        F.substring(order, 1, bucket_digits).alias("__bucket"),
        F.regexp_count(or_empty(text), F.lit(WORD)).cast("long").alias("size"),
    )
    buckets = cut(
        rows.groupBy("__source", "__bucket").agg(F.sum("size").alias("__words")), "mix-buckets"
    )
    sources = buckets.groupBy("__source").agg(F.sum("__words").alias("source_size"))
    targets = source_targets(sources, weights, most)
    earlier = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(
        "__source", "__bucket", F.coalesce(F.sum("__words").over(earlier), F.lit(0)).alias("__offset")
    ).join(targets.select("__source", "source_size", "target", "__kind"), "__source")
    inside = (
        Window.partitionBy("__source", "__bucket")
        .orderBy("__order", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.col("__offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    passes = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double"))), F.lit(0))
    rest = F.col("target") - F.col("__passes") * F.col("source_size")
    middle = F.col("__start") + F.col("size") / 2
    copies = F.col("__passes") + F.when(middle < rest, 1).otherwise(0)
    demand = lambda copy: F.coalesce(
        F.try_divide(copy * F.col("source_size") + middle, F.col("target")), F.lit(0.0)
    )
    shapes = F.array(*[_segments(s) for s in schedules])
    shape = F.element_at(shapes, F.col("__kind") % len(schedules) + 1)
    positions = F.transform(
        F.sequence(F.lit(1), F.col("__copies").cast("int")),
        lambda copy: position_of(F.least(demand(copy - 1), F.lit(1.0)), F.col("__shape")),
    )
    return (
        rows.join(offsets, ["__source", "__bucket"])
        .withColumn("__start", start)
        .withColumn("__passes", passes)
        .withColumn("__copies", copies)
        .withColumn("__shape", shape)
        .withColumn(
            "positions",
            F.when(F.col("__copies") > 0, positions).otherwise(F.array().cast("array<double>")),
        )
        .select("__row", "size", "source_size", "target", "positions", "__order")
    )


def ordered_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus in training order: the columns of ``docs`` as far as no column of the plan has
    the name, then size, source_size, target, copy (from 0) and position, range-sorted by position."""
    planned = plan_mix(docs, **options)
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copy", "position")]
    return (
        planned.select("*", F.posexplode("positions").alias("copy", "position"))
        .orderBy("position", "__order", "copy")
        .select(*[F.col("__row")[c].alias(c) for c in own], "size", "source_size", "target", "copy", "position")
    )
