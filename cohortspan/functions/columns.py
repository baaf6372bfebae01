"""Column expressions: recodes, receipt months, labels, percentages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortspan import config as c
from cohortspan.config import CohortConfig


def recode(column: Column, labels: Mapping[str, str], default: Column | None = None) -> Column:
    """Replace coded values by labels; anything else becomes ``default`` (NULL)."""
    result = F.lit(None).cast("string") if default is None else default
    for code, label in labels.items():
        result = F.when(column == code, F.lit(label)).otherwise(result)
    return result


def code_text(column: Column) -> Column:
    """A code as text without trailing blanks, as codes are compared."""
    return F.rtrim(column.cast("string"))


def code_number(column: Column) -> Column:
    """A code as text, without blanks around it and, where it is a number, without leading zeros."""
    return F.regexp_replace(F.trim(column.cast("string")), "^0+(?=[0-9]+$)", "")


def gender_label(column: Column, cfg: CohortConfig) -> Column:
    return recode(column, cfg.gender_labels)


def race_label(column: Column, cfg: CohortConfig) -> Column:
    return recode(column, cfg.race_labels, default=column)


def status_label(column: Column, cfg: CohortConfig) -> Column:
    return recode(column, cfg.status_labels)


def month_index(date: Column) -> Column:
    """Position in the academic year, 1 = October; one past the end without a date."""
    position = F.pmod(F.month(date) - F.lit(c.FIRST_MONTH), F.lit(len(c.MONTHS))) + 1
    return F.when(date.isNull(), F.lit(len(c.MONTHS) + 1)).otherwise(position).cast("int")


def month_name(index: Column) -> Column:
    """Label for a ``month_index``; NULL outside 1..13."""
    names = F.array(*[F.lit(name) for name in (*c.MONTHS, c.NO_RECEIPT)])
    return F.try_element_at(names, index)


def month_abbreviation(name: Column) -> Column:
    return F.substring(name, 1, 3)


def line_label(level: Column, district: Column, school: Column) -> Column:
    """Name of the line a summary row belongs to."""
    return (
        F.when(level == c.LEVELS[0], school)
        .when(level == c.LEVELS[1], district)
        .when(level == c.LEVELS[2], F.lit(c.STATE))
    )


def level_index(level: Column) -> Column:
    result = F.lit(None).cast("int")
    for position, name in enumerate(c.LEVELS, start=1):
        result = F.when(level == name, F.lit(position)).otherwise(result)
    return result


def rate(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, NULL unless the denominator is positive."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double"))


def percent_text(share: Column, decimals: int = 0) -> Column:
    """A share as text, e.g. ``47%``; ties go to the even digit, NULL stays NULL."""
    text = F.format_string(f"%.{decimals}f%%", F.bround(share * 100, decimals))
    return F.when(share.isNotNull(), text)
