"""The summary table on disk, partitioned by level and school year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortspan.operators.gates import Gates
from cohortspan.staging import stage

PARTITIONS = ("level", "SchoolYear")


def write_app_data(df: DataFrame, path: str, gates: Gates | None = None) -> None:
    """Replace the summary table at ``path``.

    With the ``gates`` that ``df`` was built with, the table is staged first and replaces the one at ``path``
    only if no measure is above its limit; else ``QualityBreach`` is raised.

    The rebalance hint gathers each partition's rows so that small partitions
    become one file; adaptive execution splits a partition that grows large.
    """
    if gates is not None:
        df = stage(df, "app_data")
        gates.check()
    df.hint("rebalance", *PARTITIONS).write.mode("overwrite").partitionBy(*PARTITIONS).parquet(path)


def load_app_data(spark: SparkSession, path: str) -> DataFrame:
    """Read the summary table; filters on level and year prune its folders."""
    return spark.read.parquet(path)
