"""The trends of all schools as a table that answers for one school by opening one file.

The table is bucketed and sorted by school. Rows are dealt out by the hash that buckets use
before they are written, so a bucket is one file of one task, and Spark opens that file alone
when asked for one school; inside, the sort order lets it skip row groups. A view carries
the name readers use: a new version of the table is written beside the old one and the view is
then replaced, so readers always see one whole version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHOOLS_PER_BUCKET = 256
SERVED_BY = "scope_school"
SORTED_BY = ("scope_school", "scope_district")


def bucket_count(app: DataFrame, schools_each: int = SCHOOLS_PER_BUCKET) -> int:
    """Buckets for the trends of ``app``, a written summary table: one per ``schools_each`` names of schools."""
    schools = app.filter(F.col("level") == "school").agg(F.count_distinct("SchoolName")).first()[0]
    return max(1, -(-schools // schools_each))


def publish_trends(trends: DataFrame, name: str, buckets: int) -> str:
    """Write ``trends`` and let the view ``name`` show them; returns the table behind it.

    The version shown before stays, as readers may be in the middle of it; versions before that one go.
    Any frame with ``scope_school`` and ``scope_district`` will do, such as those of
    ``trend_all_scopes`` and ``monthly_trend_all_scopes``.
    """
    spark = trends.sparkSession
    table = f"{name}_v_{uuid.uuid4().hex}"
    before = published_table(spark, name)
    dealt = trends.repartition(buckets, SERVED_BY)
    dealt.write.format("parquet").bucketBy(buckets, SERVED_BY).sortBy(*SORTED_BY).saveAsTable(table)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {table}")
    for old in _versions(spark, name) - {table, before}:
        spark.sql(f"DROP TABLE IF EXISTS {old}")
    return table


def published_table(spark: SparkSession, name: str) -> str | None:
    """The table that the view ``name`` shows, if there is one."""
    if not spark.catalog.tableExists(name):
        return None
    rows = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    return (rows.get("View Text") or "").rpartition(" FROM ")[2] or None


def withdraw_trends(spark: SparkSession, name: str) -> None:
    """Remove the view and all its versions."""
    spark.sql(f"DROP VIEW IF EXISTS {name}")
    for table in _versions(spark, name):
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def school_trend(spark: SparkSession, name: str, school: str, district: str | None = None) -> DataFrame:
    """The lines of one school, its district and the state, from one bucket of the published table.

    ``district`` tells schools of one name apart. An unknown school has no lines.
    """
    rows = spark.table(name).filter(F.col("scope_school") == F.lit(school))
    return rows if district is None else rows.filter(F.col("scope_district") == F.lit(district))


def _versions(spark: SparkSession, name: str) -> set[str]:
    return {t.name for t in spark.catalog.listTables(pattern=f"{name}_v_*") if t.name.startswith(f"{name}_v_")}
