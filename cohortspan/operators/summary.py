"""Distinct-student counts per school, district and state.

A student counts once per cell and once in the denominator of its cell family,
at each level anew: district figures are not sums of school figures, as one
student may attend several schools.

Student rows are shuffled twice. First they are reduced to one row per student
and school-level family, which holds the student's receipt months as bits, one
set of bits per status; the reduction starts before the shuffle. Those compact
rows are then spread by year and student, after which district and state
families of the same student are local and cost no shuffle of their own. The
families of all levels are counted in one aggregation: the students, and for each
cell (receipt month x status) those with its bit set. Only these counts travel,
and the cells that occur are unfolded at the end.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan import config as c
from cohortspan.config import CohortConfig
from cohortspan.functions import columns as col
from cohortspan.operators.gates import Gates

SCOPE = {
    "school": ("DistrictCode", "DistrictName", "SchoolCode", "SchoolName"),
    "lea": ("DistrictCode", "DistrictName"),
    "state": (),
}
ALL_SCOPE_COLUMNS = SCOPE["school"]
SENTINELS = {
    "DistrictCode": c.ALL_DISTRICTS, "DistrictName": c.ALL_DISTRICTS,
    "SchoolCode": c.ALL_SCHOOLS, "SchoolName": c.ALL_SCHOOLS,
}

# 13 receipt months and one slot for none of them.
MONTH_SLOTS = len(c.MONTHS) + 2
REPEATED = 1 << MONTH_SLOTS  # beside a student's months: several rows of the extract are behind them
MONTH_NAMES = (*c.MONTHS, c.NO_RECEIPT, None)


def family_keys(level: str, cfg: CohortConfig) -> list[str]:
    """Columns that identify a cell family, i.e. one denominator."""
    return ["SchoolYear", *SCOPE[level], "Grade", *cfg.subgroups]


def _bits(cfg: CohortConfig) -> dict[str, Column]:
    """Per status, and for rows without one, the row's receipt month as a bit."""
    month = F.coalesce(F.col("month_idx"), F.lit(MONTH_SLOTS)) - 1
    bit = F.call_function("shiftleft", F.lit(1), month)
    status = F.col("completedFAFSA")
    known = F.coalesce(status.isin(*cfg.statuses), F.lit(False))
    slots = [status.eqNullSafe(label) for label in cfg.statuses] + [~known]
    return {f"months_{k}": F.when(here, bit).otherwise(F.lit(0)) for k, here in enumerate(slots)}


def student_families(prepared: DataFrame, cfg: CohortConfig, gates: Gates | None = None) -> dict[str, DataFrame]:
    """Per level, one row per family and student with the student's months as bits."""
    bits = _bits(cfg)
    either = [F.bit_or(name).alias(name) for name in bits]
    first = [F.bit_or("months_0").bitwiseOR(F.when(F.count(F.lit(1)) > 1, REPEATED).otherwise(0)).alias("months_0")]
    reduced = first + either[1:] if gates else either
    school = prepared.withColumns(bits).groupBy(*family_keys("school", cfg), "StudentID").agg(*reduced)
    # A student has at most one row per school-level family by now, so no
    # partition can be overrun by one student, nor by rows without a student.
    lea = school.repartition("SchoolYear", "StudentID")
    if gates:
        lea = gates.watch_students(lea, F.col("months_0").bitwiseAND(REPEATED) != 0)
    lea = lea.groupBy(*family_keys("lea", cfg), "StudentID").agg(*either)
    state = lea.groupBy(*family_keys("state", cfg), "StudentID").agg(*either)
    return {"school": school, "lea": lea, "state": state}


def denominators(prepared: DataFrame, level: str, cfg: CohortConfig) -> DataFrame:
    """Distinct students per cell family."""
    students = student_families(prepared, cfg)[level]
    return students.groupBy(*family_keys(level, cfg)).agg(F.count(F.lit(1)).alias("seniors"))


def _labelled(students: DataFrame, level: str, cfg: CohortConfig) -> DataFrame:
    """Student rows of one level under the summary table's scope columns."""
    scope = [
        (F.col(name) if name in SCOPE[level] else F.lit(SENTINELS[name])).alias(name)
        for name in ALL_SCOPE_COLUMNS
    ]
    return students.select(
        F.lit(level).alias("level"), "SchoolYear", *scope, "Grade", *cfg.subgroups, *_bits(cfg)
    )


def _count_cells(students: DataFrame, cfg: CohortConfig, gates: Gates | None = None) -> DataFrame:
    """``seniors`` per family and ``n`` per cell, from one aggregation."""
    family = ["level", "SchoolYear", *ALL_SCOPE_COLUMNS, "Grade", *cfg.subgroups]
    cells = [
        (month, status, f"n_{month}_{slot}", f"sum(getbit(months_{slot}, {month - 1}))")
        for month in range(1, MONTH_SLOTS + 1)
        for slot, status in enumerate((*cfg.statuses, None))
    ]
    wide = students.groupBy(*family).agg(
        F.count(F.lit(1)).alias("seniors"), *[F.expr(count).alias(name) for *_, name, count in cells]
    )
    if gates:
        wide = gates.watch_families(wide, reduce(add, [F.col(name) for *_, name, _ in cells]))
    unfolded = F.array(*[
        F.struct(
            F.lit(MONTH_NAMES[month - 1]).cast("string").alias("ApplicationReceiptMonth"),
            F.lit(status).cast("string").alias("completedFAFSA"),
            F.col(name).alias("n"),
            F.lit(month if month < MONTH_SLOTS else None).cast("int").alias("month_idx"),
        )
        for month, status, name, _ in cells
    ])
    counts = wide.select(*family, "seniors", F.inline(F.filter(unfolded, lambda cell: cell["n"] > 0)))
    return counts.select(
        *family, "ApplicationReceiptMonth", "completedFAFSA", "n", "seniors", "month_idx",
        col.level_index(F.col("level")).alias("level_idx"),
    )


def summarise(prepared: DataFrame, level: str, cfg: CohortConfig) -> DataFrame:
    """The summary of one level."""
    return _count_cells(_labelled(student_families(prepared, cfg)[level], level, cfg), cfg)


def summarise_levels(prepared: DataFrame, cfg: CohortConfig, gates: Gates | None = None) -> DataFrame:
    """The summary table: schools, districts and state in one job, which also takes the measures of ``gates``."""
    students = student_families(prepared, cfg, gates)
    school, lea, state = (_labelled(students[level], level, cfg) for level in c.LEVELS)
    return _count_cells(school.unionByName(lea).unionByName(state), cfg, gates)


def sort_app_data(
    app: DataFrame, cfg: CohortConfig, level_order: Sequence[str] = tuple(sorted(c.LEVELS))
) -> DataFrame:
    """Presentation order, missing values last; for sinks only."""
    rank = F.array_position(F.array(*[F.lit(level) for level in level_order]), F.col("level"))
    keys = ["SchoolYear", "DistrictCode", "SchoolCode", *cfg.subgroups, "month_idx", "completedFAFSA"]
    return app.orderBy(rank, *[F.col(k).asc_nulls_last() for k in keys])
