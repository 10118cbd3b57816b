"""Row-shaping helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_array(
    df: DataFrame, keep: Sequence[Column | str], array: Column, position: str, value: str
) -> DataFrame:
    """One row per element with its 0-based position; empty arrays give no row.

    A plain ``posexplode`` makes the optimizer add a filter on the array's size, which repeats the
    whole array expression below the projections that stage it. The outer form with a filter on the
    generated position does not.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(position, value)).filter(
        F.col(position).isNotNull()
    )


def spread(df: DataFrame) -> DataFrame:
    """Use every core for a scan of fewer splits than cores, i.e. one that is small."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def one_row(*parts: DataFrame) -> DataFrame:
    """One row out of one-row frames with different columns."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])
