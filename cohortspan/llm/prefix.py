"""Running totals over a whole table without gathering it in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspan.staging import stage


def running_totals(df: DataFrame, order: Sequence[Column], totals: Mapping[str, Column]) -> DataFrame:
    """Add, per entry of ``totals``, the sum over all rows before each row in ``order``.

    Rows are dealt out by range; each range's sum is known first, and a range
    starts where the sums of the ranges before it end. Only one row per range
    meets in one task. ``order`` should tell rows apart: rows it cannot tell
    apart stay in one range.
    """
    marked = df.withColumns({f"__of_{name}": value for name, value in totals.items()})
    ranged = stage(
        marked.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranged"
    )
    sums = ranged.groupBy("__range").agg(
        *[F.sum(f"__of_{name}").alias(f"__sum_{name}") for name in totals]
    )
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        F.col("__range"),
        *[F.coalesce(F.sum(f"__sum_{name}").over(before), F.lit(0)).alias(f"__base_{name}") for name in totals],
    )
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.join(bases, "__range").withColumns(
        {
            name: F.col(f"__base_{name}") + F.coalesce(F.sum(f"__of_{name}").over(inside), F.lit(0))
            for name in totals
        }
    )
    return found.select(*[c for c in df.columns if c not in totals], *totals)
