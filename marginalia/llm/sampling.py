"""Samples of bounded size by a hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lowest(rows: DataFrame, group: str, place: str, most: int) -> DataFrame:
    """Of each group the ``most`` rows with the lowest ``place``, a 64-bit hash that rows of equal content
    share; rows must be distinct. Groups must be few: the driver holds one count for each.

    Only the range of the hash that holds about twice as many rows is sorted, so no group is sorted
    as a whole. A group whose range happens to hold fewer gives fewer.
    """
    counts = rows.groupBy(group).count().filter(F.col(group).isNotNull()).collect()
    if not counts:
        return rows.limit(0)
    entries = []
    for value, count in counts:
        share = min(1.0, 2 * most / count)
        ceiling = (1 << 63) - 1 if share == 1 else int((share - 0.5) * (1 << 64))
        entries += [F.lit(value), F.lit(ceiling).cast("long")]
    near = rows.filter(F.col(place) <= F.create_map(*entries)[F.col(group)])
    order = Window.partitionBy(group).orderBy(place)
    return near.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= most).drop("__n")
