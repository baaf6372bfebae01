"""One selection's rows, its detail table and its description."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan import config as c
from cohortspan.config import Selection

DASH = "–"


def scope_filter(app: DataFrame, selection: Selection) -> DataFrame:
    """Rows of the chosen school, its district and the state."""
    conditions = [
        F.col("SchoolYear").between(selection.first_year, selection.last_year),
        F.col("DistrictName").isin(selection.district, c.ALL_DISTRICTS),
        F.col("SchoolName").isin(selection.school, c.ALL_SCHOOLS),
    ]
    conditions += [F.col(name).isin(*values) for name, values in selection.subgroup_values.items()]
    return app.filter(reduce(and_, conditions))


def scope_meta(rows: DataFrame) -> DataFrame:
    """School and district name of the selection, as one row (none if no school row)."""
    names = rows.filter(F.col("level") == "school").select("SchoolName", "DistrictName").distinct()
    return names.orderBy(
        F.col("SchoolName").asc_nulls_last(), F.col("DistrictName").asc_nulls_last()
    ).limit(1)


def detail_table(rows: DataFrame, subgroups: tuple[str, ...] = c.SUBGROUPS) -> DataFrame:
    """Counts, denominators and percentages under reader-friendly names."""
    percent = F.when(
        F.col("seniors") > 0, F.bround(F.col("n").cast("double") / F.col("seniors") * 100, 1)
    )
    hidden = [name for name in c.SUBGROUPS if name not in subgroups]
    names = {k: v for k, v in c.DETAIL_NAMES.items() if k not in hidden}
    others = {name: name.replace("_", " ").title() for name in subgroups if name not in names}
    place = list(names).index("ApplicationReceiptMonth")
    ordered = [*list(names.items())[:place], *others.items(), *list(names.items())[place:]]
    return rows.select(*[F.col(k).alias(v) for k, v in ordered], percent.alias("Percent"))


def _note(rows: DataFrame, first_year: Column, last_year: Column, text: list[Column]) -> DataFrame:
    """One row built from the years of all rows and the names of the school rows."""
    at_school = F.col("level") == "school"
    named = F.when(at_school, F.struct("SchoolName", "DistrictName"))
    summary = rows.agg(
        F.min(named).alias("names"), first_year.alias("first_year"), last_year.alias("last_year")
    ).filter(F.col("names").isNotNull())
    return summary.select("names.*", "first_year", "last_year").select(F.concat(*text).alias("note"))


def scope_note(rows: DataFrame) -> DataFrame:
    """Sentence that describes a selection with subgroups, no row if there is no school."""
    year, last = F.col("first_year").cast("string"), F.col("last_year").cast("string")
    years = F.when(year == last, year).otherwise(F.concat(year, F.lit(DASH), last))
    showing, compared, state, end = map(F.lit, c.NOTE)
    text = [showing, F.col("SchoolName"), compared, F.col("DistrictName"), state, years, end]
    return _note(rows, F.min("SchoolYear"), F.max("SchoolYear"), text)


def scope_note_year(rows: DataFrame) -> DataFrame:
    """Sentence that describes a one-year selection without subgroups."""
    year = F.col("first_year")
    years = F.concat((year - 1).cast("string"), F.lit(DASH), (year - 2000).cast("string"))
    showing, compared, state, end = map(F.lit, c.NOTE_YEAR)
    text = [showing, F.col("SchoolName"), compared, F.col("DistrictName"), state, years, end]
    return _note(rows, F.min("SchoolYear"), F.max("SchoolYear"), text)
