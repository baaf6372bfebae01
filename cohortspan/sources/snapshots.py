"""The latest snapshot of each school year, told without reading enrolment rows.

A folder of parquet files knows the answer where it is partitioned by school year:
the folders' names and the files' footers hold the years, the snapshot dates and how
many rows there are. Spark reads footers alone when it can push a whole aggregation
down to them, so the aggregation is asked for in two forms and the planner is asked
whether footers answer it. If they do not, two columns are scanned.
"""

from __future__ import annotations

from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.sources.tables import KEPT_TYPES, conform, read_source
from cohortspan.staging import stage_path

KEYS = {"SchoolYear": "int", "AsOf": "date"}
NO_STATISTICS = "No min/max found"  # what Spark says of a footer without the bounds of a column


def latest_snapshots(spark: SparkSession, spec: Mapping[str, object]) -> DataFrame:
    """``SchoolYear, maxasof`` of the enrolment table that ``spec`` names, as a written table.

    ``spec`` is the one ``read_source`` takes. The result equals ``latest_snapshot`` on the whole
    table: partitions and files without rows do not count, a year whose rows all lack a date
    comes with NULL. Only a folder of parquet files is answered from its footers.
    """
    path = stage_path(spark, "latest_snapshots")
    if spec.get("format") == "parquet" and "path" in spec:
        for found in footer_maxima(spark, spec):
            try:
                found.write.mode("overwrite").parquet(path)
            except Py4JJavaError as error:
                if NO_STATISTICS not in str(error):
                    raise
                continue
            return spark.read.schema(found.schema).parquet(path)
    found = conform(read_source(spark, spec), KEYS, KEPT_TYPES["enrollment"])
    found = found.groupBy("SchoolYear").agg(F.max("AsOf").alias("maxasof"))
    found.write.mode("overwrite").parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def footer_maxima(spark: SparkSession, spec: Mapping[str, object]) -> list[DataFrame]:
    """The forms of the aggregation that footers alone answer, cheapest first; none if rows would be read.

    Partitioned by year and snapshot, the rows per partition say which snapshots there are.
    Partitioned by year, the bounds of the snapshot column say the last.
    """
    table = _with_footers(spark, spec)
    named = {c.lower(): F.col(f"`{c}`") for c in table.columns}
    year, asof = (named[key.lower()].alias(key) for key in KEYS)
    rows, last = F.count(F.lit(1)).alias("rows"), F.max("AsOf").alias("maxasof")
    by_folder = conform(table.groupBy(year, asof).agg(rows).where("rows > 0"), KEYS, KEPT_TYPES["enrollment"])
    by_bounds = table.groupBy(year).agg(F.max(asof).alias("AsOf"), rows).where("rows > 0")
    by_bounds = conform(by_bounds, KEYS, KEPT_TYPES["enrollment"])
    forms = [by_folder.groupBy("SchoolYear").agg(last), by_bounds.groupBy("SchoolYear").agg(last)]
    return [form for form in forms if reads_footers_only(form)]


def reads_footers_only(df: DataFrame) -> bool:
    """Whether the plan's scans return aggregates that files' footers hold."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "Scan" in line]
    return bool(scans) and all("PushedAggregation: [" in s and "PushedAggregation: []" not in s for s in scans)


def _with_footers(spark: SparkSession, spec: Mapping[str, object]) -> DataFrame:
    """The folder as a table that aggregations can be pushed down to.

    A session of its own holds the settings that this takes. Spark binds a folder to the session that is
    active when it is opened, so that one is made active for as long.
    """
    session = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        session.conf.set(key, spark.conf.get(key))
    v1 = spark.conf.get("spark.sql.sources.useV1SourceList").split(",")
    session.conf.set("spark.sql.sources.useV1SourceList", ",".join(s for s in v1 if s.strip().lower() != "parquet"))
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    session.conf.set("spark.sql.caseSensitive", "true")  # else names of partitions with capitals are not recognised
    sessions = spark.sparkContext._jvm.org.apache.spark.sql.classic.SparkSession
    sessions.setActiveSession(session._jsparkSession)
    try:
        return session.read.format("parquet").options(**dict(spec.get("options", {}))).load(str(spec["path"]))
    finally:
        sessions.setActiveSession(spark._jsparkSession)
