"""Joins, grids and fills with data-frame (NULL-matches-NULL) semantics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspan.staging import stage


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; keys appear once.

    ``<=>`` is still a hash/sort-merge join in Spark, not a nested loop.
    """
    renamed = right.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        *[F.col(x) for x in right.columns if x not in keys],
    )
    condition = reduce(
        lambda a, b: a & b,
        [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys],
    )
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])


def complete_grid(
    df: DataFrame, keys: Sequence[str], axis: str, values: Sequence[int], fill: dict[str, object]
) -> DataFrame:
    """One row per existing key combination and axis value.

    Missing rows get the ``fill`` values, other columns stay NULL. The axis is
    exploded from a literal array next to each key, so no cross join is needed.
    """
    axis_array = F.array(*[F.lit(v) for v in values])
    grid = df.select(*keys).distinct().withColumn(axis, F.explode(axis_array))
    full = null_safe_join(grid, df, [*keys, axis], "left")
    for column, value in fill.items():
        full = full.withColumn(column, F.coalesce(F.col(column), F.lit(value)))
    return full


def fill_downup(df: DataFrame, keys: Sequence[str], order: str, column: str) -> DataFrame:
    """Fill gaps from the previous known value, leading gaps from the next one."""
    window = Window.partitionBy(*keys).orderBy(order)
    before = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = window.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return df.withColumn(
        column,
        F.coalesce(
            F.last(column, ignorenulls=True).over(before),
            F.first(column, ignorenulls=True).over(after),
        ),
    )


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts for every pair of levels of ``a`` and ``b``, long form.

    A NULL level is always present on both sides and empty pairs count 0. All
    rows are reduced to one count per pair first. The levels of ``a``, the short
    axis such as the school year, are unfolded next to each level of ``b``, which
    stay spread over the tasks however many there are.
    """
    counts = stage(df.groupBy(a, b).agg(F.count(F.lit(1)).alias("count")), "crosstab")
    null = lambda name: F.lit(None).cast(df.schema[name].dataType)
    axis = counts.select(a).distinct().agg(F.array_append(F.array_sort(F.collect_set(a)), null(a)).alias("levels"))
    b_levels = counts.select(b).where(F.col(b).isNotNull()).distinct()
    b_null = counts.select(null(b).alias(b)).limit(1)
    grid = (
        b_levels.unionByName(b_null)
        .withColumn("levels", axis.scalar())
        .select(F.explode("levels").alias(a), b)
    )
    return null_safe_join(grid, counts, [a, b], "left").withColumn(
        "count", F.coalesce(F.col("count"), F.lit(0))
    )
