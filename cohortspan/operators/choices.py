"""Lists a reader can choose from, and selections that follow from them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.config import MISSING_RACE, SUBGROUPS


def choices(rows: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values, missing ones left out."""
    return rows.filter(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def year_choices(app: DataFrame) -> DataFrame:
    return choices(app, "SchoolYear")


def all_districts(app: DataFrame) -> DataFrame:
    return choices(app.filter(F.col("level") == "school"), "DistrictName")


def all_schools(app: DataFrame) -> DataFrame:
    return choices(app.filter(F.col("level") == "school"), "SchoolName")


def gender_choices(app: DataFrame) -> DataFrame:
    return choices(app, "gender")


def race_choices(app: DataFrame) -> DataFrame:
    return choices(app.filter(F.col("race") != MISSING_RACE), "race")


def default_selection(app: DataFrame, subgroups: bool = True) -> DataFrame:
    """Opening selection as one row: last year and the first value of each list.

    The lists are independent, so the school need not lie in the district;
    ``resolve_selection`` gives a consistent one.
    """
    at_school = F.col("level") == "school"
    picks = [
        F.max("SchoolYear").alias("year"),
        F.min(F.when(at_school, F.col("DistrictName"))).alias("district"),
        F.min(F.when(at_school, F.col("SchoolName"))).alias("school"),
    ]
    if subgroups:
        picks += [
            F.min("gender").alias("gender"),
            F.min(F.when(F.col("race") != MISSING_RACE, F.col("race"))).alias("race"),
        ]
    return app.agg(*picks)


def _in_years(years: Sequence[int], whole_range: bool) -> Column:
    """Years of a range: its two end points, or everything between them."""
    if not years:
        raise ValueError("years must not be empty")
    if whole_range:
        return F.col("SchoolYear").between(min(years), max(years))
    return F.col("SchoolYear").isin(min(years), max(years))


def district_choices(app: DataFrame, years: Sequence[int], whole_range: bool = False) -> DataFrame:
    """Districts with data in the chosen years."""
    rows = app.filter((F.col("level") == "lea") & _in_years(years, whole_range))
    return choices(rows, "DistrictName")


def _school_rows(
    app: DataFrame, years: Sequence[int], whole_range: bool, **wanted: str | Sequence[str]
) -> DataFrame:
    for name, value in wanted.items():
        if not value:
            raise ValueError(f"{name} must not be empty")
    matches = [
        F.col(name).isin(*([value] if isinstance(value, str) else value))
        for name, value in wanted.items()
    ]
    return app.filter(
        reduce(and_, [F.col("level") == "school", _in_years(years, whole_range), *matches])
    )


def school_choices(
    app: DataFrame, years: Sequence[int], district: str, whole_range: bool = False
) -> DataFrame:
    """Schools of a district with data in the chosen years."""
    return choices(_school_rows(app, years, whole_range, DistrictName=district), "SchoolName")


def subgroup_choices(
    app: DataFrame,
    years: Sequence[int],
    district: str,
    school: str | Sequence[str],
    whole_range: bool = False,
    subgroups: Sequence[str] = SUBGROUPS,
) -> DataFrame:
    """Values of the subgroups present at the chosen school, as (kind, value)."""
    rows = _school_rows(app, years, whole_range, DistrictName=district, SchoolName=school)
    pairs = F.array(*[F.struct(F.lit(name).alias("kind"), F.col(name).alias("value")) for name in subgroups])
    return (
        rows.select(F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .distinct()
        .orderBy("kind", "value")
    )


def resolve_selection(
    app: DataFrame, years: Sequence[int], whole_range: bool = False, subgroups: bool = True
) -> DataFrame:
    """First choice at every step, as one row.

    First district, first school in it, first gender and race at that school:
    one aggregation by district and school, of which the first row is kept.
    """
    rows = app.filter(
        (F.col("level") == "school") & _in_years(years, whole_range) & F.col("DistrictName").isNotNull()
    )
    picks = [F.min(F.col(name)).alias(name) for name in ("gender", "race")] if subgroups else []
    per_school = rows.groupBy("DistrictName", "SchoolName").agg(
        F.lit(min(years)).alias("first_year"), F.lit(max(years)).alias("last_year"), *picks
    )
    first = per_school.orderBy("DistrictName", F.col("SchoolName").asc_nulls_last()).limit(1)
    return first.select(
        "first_year", "last_year",
        F.col("DistrictName").alias("district"), F.col("SchoolName").alias("school"),
        *(["gender", "race"] if subgroups else []),
    )
