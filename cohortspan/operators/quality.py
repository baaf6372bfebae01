"""Quality reports on the extract and on the summary table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.config import CohortConfig
from cohortspan.functions import columns as col
from cohortspan.functions.relational import crosstab

ENROLMENT_KEY = ("SchoolYear", "DistrictCode", "SchoolCode", "StudentID")


def duplicate_keys(rows: DataFrame, keys: Sequence[str] = ENROLMENT_KEY) -> DataFrame:
    """Key combinations that occur more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def multi_enrolled(rows: DataFrame) -> DataFrame:
    """Students in more than one district/school within a year."""
    return duplicate_keys(rows.select(*ENROLMENT_KEY).distinct(), ["SchoolYear", "StudentID"])


def yearly_crosstab(rows: DataFrame, column: str) -> DataFrame:
    """School year by ``column``, missing values and empty pairs included."""
    return crosstab(rows, "SchoolYear", column)


def coverage(app: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Counts of a cell family against its denominator.

    ``diff`` is above zero where a student of the family is in several cells.
    """
    family = ["level", "SchoolYear", "DistrictCode", "DistrictName", "SchoolCode", "SchoolName",
              "Grade", *cfg.subgroups]
    return app.groupBy(*family).agg(
        F.min("seniors").alias("seniors"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_n")
    ).withColumn("diff", F.col("total_n") - F.col("seniors"))


LOOKUP_KEYS = {
    "school": ("SchoolYear", "SchoolCode"), "district": ("SchoolYear", "DistrictCode"),
    "race_code": ("RaceReportCode",), "sped_code": ("SpEd",),
}


def lookup_reports(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Per code table its number of codes, and of codes it repeats, compared as the joins compare them."""
    reports = []
    for table, keys in LOOKUP_KEYS.items():
        codes = sources[table].select(*[
            F.col(k) if k == "SchoolYear" else col.code_text(F.col(k)).alias(k) for k in keys
        ])
        counts = codes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        reports.append(counts.agg(
            F.lit(table).alias("code_table"), F.count(F.lit(1)).alias("codes"),
            F.count(F.when(F.col("n") > 1, 1)).alias("repeated"),
        ))
    return reduce(DataFrame.unionByName, reports)


def repeated_lookup_codes(lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Codes a lookup table repeats; each would multiply the rows that join it."""
    return duplicate_keys(lookup, keys)
