"""An index that answers the dependent choices without the summary table.

Each choice (a district, a school of a district, a subgroup's value at a school) is a row with the
years that have it as bits of a long; a row holds the 64 years of one ``era``, so any year has its
bit. The index is a few hundredths of the summary's size. Written by kind and sorted, a question about one
district reads one folder and skips the row groups of others.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.config import SUBGROUPS
from cohortspan.operators.choices import choices

YEARS_PER_ERA = 64
KEYS = ("kind", "DistrictName", "SchoolName", "value", "era")
DISTRICT, SCHOOL = "district", "school"


def build_choice_index(app: DataFrame, subgroups: Sequence[str] = SUBGROUPS) -> DataFrame:
    """``kind, DistrictName, SchoolName, value, era, years`` for every choice of the summary table.

    ``app`` is read once. Its rows are reduced to one per choice before they are
    shuffled. Missing names and values are kept, as a selection may be resolved to them.
    """
    clash = {DISTRICT, SCHOOL} & set(subgroups)
    if clash:
        raise ValueError(f"a subgroup cannot be named {sorted(clash)}")

    def entry(kind: str, value: Column, at_school: bool) -> Column:
        school = F.col("SchoolName") if at_school else F.lit(None).cast("string")
        return F.struct(
            F.lit(kind).alias("kind"), F.col("DistrictName").alias("DistrictName"), school.alias("SchoolName"),
            value.cast("string").alias("value"),
        )

    district = F.array(entry(DISTRICT, F.col("DistrictName"), False))
    at_school = F.array(
        entry(SCHOOL, F.col("SchoolName"), True), *[entry(name, F.col(name), True) for name in subgroups]
    )
    level, year = F.col("level"), F.col("SchoolYear").cast("long")
    rows = app.filter(level.isin("lea", "school") & year.isNotNull()).select(
        year.alias("year"), F.inline(F.when(level == "lea", district).otherwise(at_school))
    )
    bit = F.pmod("year", F.lit(YEARS_PER_ERA))
    marked = rows.select(
        *KEYS[:-1], ((F.col("year") - bit) / YEARS_PER_ERA).cast("int").alias("era"),
        F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int")).alias("bit"),
    )
    return marked.groupBy(*KEYS).agg(F.bit_or("bit").alias("years"))


def write_choice_index(index: DataFrame, path: str) -> None:
    """Replace the index at ``path``: a folder per kind, sorted by district and school."""
    dealt = index.repartitionByRange("kind", "DistrictName", "SchoolName")
    dealt.sortWithinPartitions("kind", "DistrictName", "SchoolName").write.mode("overwrite").partitionBy("kind").parquet(path)


def load_choice_index(spark: SparkSession, path: str) -> DataFrame:
    """Read the index; its folders' names are text whatever they look like."""
    schema = "DistrictName string, SchoolName string, value string, era int, years long, kind string"
    return spark.read.schema(schema).parquet(path)


def in_years(years: Sequence[int], whole_range: bool = False) -> Column:
    """Whether a choice occurs in the end points of ``years``, or anywhere between them."""
    if not years:
        raise ValueError("years must not be empty")
    first, last = min(years), max(years)
    masks: dict[int, int] = {}
    for year in range(first, last + 1) if whole_range else (first, last):
        era, bit = divmod(year, YEARS_PER_ERA)
        masks[era] = masks.get(era, 0) | 1 << bit
    signed = {era: mask - (1 << 64) if mask >> 63 else mask for era, mask in masks.items()}
    return reduce(or_, [
        (F.col("era") == era) & (F.col("years").bitwiseAND(F.lit(mask).cast("long")) != 0) for era, mask in signed.items()
    ])


def _rows(index: DataFrame, kind: str, years: Sequence[int], whole_range: bool, **wanted: str | Sequence[str]) -> DataFrame:
    for name, value in wanted.items():
        if not value:
            raise ValueError(f"{name} must not be empty")
    matches = [F.col(n).isin(*([v] if isinstance(v, str) else v)) for n, v in wanted.items()]
    return index.filter(reduce(and_, [F.col("kind") == kind, in_years(years, whole_range), *matches]))


def indexed_districts(index: DataFrame, years: Sequence[int], whole_range: bool = False) -> DataFrame:
    """What ``district_choices`` finds in the summary."""
    return choices(_rows(index, DISTRICT, years, whole_range), "DistrictName")


def indexed_schools(index: DataFrame, years: Sequence[int], district: str, whole_range: bool = False) -> DataFrame:
    """What ``school_choices`` finds in the summary."""
    return choices(_rows(index, SCHOOL, years, whole_range, DistrictName=district), "SchoolName")


def indexed_subgroups(
    index: DataFrame, years: Sequence[int], district: str, school: str | Sequence[str],
    whole_range: bool = False, subgroups: Sequence[str] = SUBGROUPS,
) -> DataFrame:
    """What ``subgroup_choices`` finds in the summary."""
    found = [_rows(index, name, years, whole_range, DistrictName=district, SchoolName=school) for name in subgroups]
    rows = reduce(DataFrame.unionByName, found).filter(F.col("value").isNotNull())
    return rows.select("kind", "value").distinct().orderBy("kind", "value")


def indexed_selection(
    index: DataFrame, years: Sequence[int], whole_range: bool = False, subgroups: Sequence[str] = ("gender", "race")
) -> DataFrame:
    """What ``resolve_selection`` finds in the summary: the first choice at every step, as one row."""
    schools = _rows(index, SCHOOL, years, whole_range).filter(F.col("DistrictName").isNotNull())
    first = schools.select("DistrictName", "SchoolName").orderBy("DistrictName", F.col("SchoolName").asc_nulls_last()).limit(1)
    picked = first.select(
        F.lit(min(years)).alias("first_year"), F.lit(max(years)).alias("last_year"),
        F.col("DistrictName").alias("district"), F.col("SchoolName").alias("school"),
    )
    if not subgroups:
        return picked
    values = reduce(DataFrame.unionByName, [_rows(index, name, years, whole_range) for name in subgroups])
    at_first = picked.join(
        values, F.col("district").eqNullSafe(F.col("DistrictName")) & F.col("school").eqNullSafe(F.col("SchoolName")), "left"
    )
    return at_first.groupBy(*picked.columns).agg(
        *[F.min(F.when(F.col("kind") == name, F.col("value"))).alias(name) for name in subgroups]
    )
