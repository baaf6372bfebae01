"""Student-level extract: latest snapshot, one row per student, latest application."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from cohortspan.config import CohortConfig
from cohortspan.functions import columns as col
from cohortspan.sources.schemas import EXTRACT_SCHEMA, SOURCE_SCHEMAS
from cohortspan.staging import stage, stage_all

GRAIN = ("SchoolYear", "StudentID", "SchoolCode")
PERSON = ("LastName", "FirstName", "BirthDate")
# Application columns that identify the same person, in the order of PERSON.
APPLICANT = ("StudentLastName", "StudentFirstName", "StudentDateOfBirth")

# Person keys that a sketch keeps track of, and those it lists.
PEOPLE_TRACKED, PEOPLE_LISTED = 2048, 256

# Rows without a full person key match nobody, yet would all hash to one
# partition of the match; they are spread over this many slots instead.
UNMATCHABLE_SLOTS = 4096


def optional_eq(df: DataFrame, column: str, value: object | None) -> DataFrame:
    """Filter on equality; ``None`` means all rows."""
    return df if value is None else df.filter(F.col(column) == F.lit(value))


def latest_snapshot(enrollment: DataFrame) -> DataFrame:
    """Date of the last snapshot of each school year."""
    return enrollment.groupBy("SchoolYear").agg(F.max("AsOf").alias("maxasof"))


def person_key(year: str, last: str, first: str, born: str) -> Column:
    """A person of a year in 64 bits, NULL if part of the key is missing."""
    parts = [F.col(year).cast("int"), F.col(last).cast("string"), F.col(first).cast("string"), F.col(born).cast("date")]
    return F.when(reduce(and_, [part.isNotNull() for part in parts]), F.xxhash64(*parts))


def latest_snapshot_with_people(enrollment: DataFrame, cfg: CohortConfig) -> DataFrame:
    """``latest_snapshot`` with ``people``: the most frequent person keys of its cohort rows and their counts.

    A sketch per snapshot rides along with the pass that finds the dates. It keeps ``PEOPLE_TRACKED`` keys, so every
    key that holds more than a few hundredths of a per cent of a snapshot's cohort is among them.
    """
    key, cohort = person_key("SchoolYear", *PERSON), F.col("Grade") == F.lit(cfg.cohort_grade)
    people = enrollment.select("SchoolYear", "AsOf", F.when(cohort, key).alias("person"))
    per_snapshot = people.groupBy("SchoolYear", "AsOf").agg(
        F.expr(f"approx_top_k_accumulate(person, {PEOPLE_TRACKED}) FILTER (WHERE person IS NOT NULL)").alias("sketch")
    )
    latest = per_snapshot.groupBy("SchoolYear").agg(F.max("AsOf").alias("maxasof"), F.max_by("sketch", "AsOf").alias("sketch"))
    top = F.when(F.col("sketch").isNotNull(), F.expr(f"approx_top_k_estimate(sketch, {PEOPLE_LISTED})"))
    return latest.select("SchoolYear", "maxasof", top.alias("people"))


def frequent_people(listed: DataFrame, hot_rows: int) -> list[int]:
    """Person keys that ``hot_rows`` rows or more share, from the lists of ``latest_snapshot_with_people``."""
    frequent = listed.select(F.inline("people")).filter(F.col("item").isNotNull() & (F.col("count") >= hot_rows))
    return sorted({row["item"] for row in frequent.select("item").collect()})


def snapshot_rows(enrollment: DataFrame, latest: DataFrame) -> DataFrame:
    """Rows of the latest snapshots only.

    The comparison with the lowest int is always true: partition pruning at run
    time needs some predicate on the side that lists the snapshots.
    """
    wanted = latest.select(
        F.col("SchoolYear").alias("__year"), F.col("maxasof").alias("__asof")
    ).filter(F.col("__year") >= F.lit(-(2**31)))
    return enrollment.join(
        wanted,
        (enrollment["SchoolYear"] == wanted["__year"]) & (enrollment["AsOf"] == wanted["__asof"]),
    ).drop("__year", "__asof")


def cohort_filter(enrollment: DataFrame, cfg: CohortConfig) -> DataFrame:
    """The cohort's grade, without the excluded schools.

    School codes are compared as numbers where they are numbers, so ``0516`` is
    excluded with ``516``. A numeric column is compared as it is, which lets the
    source skip rows.
    """
    kept = enrollment.filter(F.col("Grade") == F.lit(cfg.cohort_grade))
    if not cfg.excluded_schools:
        return kept
    if isinstance(enrollment.schema["SchoolCode"].dataType, NumericType):
        numbers = [int(code) for code in cfg.excluded_schools if code.strip().isdigit()]
        return kept.filter(~F.col("SchoolCode").isin(*numbers)) if numbers else kept
    excluded = [code.strip().lstrip("0") or "0" if code.strip().isdigit() else code.strip() for code in cfg.excluded_schools]
    return kept.filter(~col.code_number(F.col("SchoolCode")).isin(*excluded))


def add_names(rows: DataFrame, school: DataFrame, district: DataFrame) -> DataFrame:
    """School and district name of the row's own year; unknown codes drop out.

    Trailing blanks do not tell codes apart.
    """

    def named(df: DataFrame, names: DataFrame, code: str, name: str) -> DataFrame:
        theirs = names.select(
            F.col("SchoolYear").alias("__year"), col.code_text(F.col(code)).alias("__code"), name
        )
        same = (df["SchoolYear"] == theirs["__year"]) & (col.code_text(df[code]) == theirs["__code"])
        return df.join(theirs, same).drop("__year", "__code")

    return named(named(rows, school, "SchoolCode", "SchoolName"), district, "DistrictCode", "DistrictName")


def cohort_columns(rows: DataFrame) -> DataFrame:
    """The columns carried on, in their final types, with the race column under its real meaning."""
    kinds = SOURCE_SCHEMAS["enrollment"]
    return rows.select(
        *[F.col(c).cast(kind).alias(c) for c, kind in kinds.items() if c not in ("AsOf", "RaceEDEN")],
        "SchoolName", "DistrictName", F.col("RaceEDEN").cast(kinds["RaceEDEN"]).alias("RaceReportCode"),
    )


def dedup_cohort(rows: DataFrame) -> DataFrame:
    """One row per school year, student and school: the first by name and birth date.

    The remaining columns break ties, which keeps reruns identical. Spark limits
    each group to its first row before the shuffle, so a hot student does not
    travel.
    """
    others = sorted(c for c in rows.columns if c not in (*GRAIN, *PERSON))
    window = Window.partitionBy(*GRAIN).orderBy(*PERSON, *others)  # missing values first
    return (
        rows.withColumn("__rn", F.row_number().over(window)).filter(F.col("__rn") == 1).drop("__rn")
    )


def latest_application(isir: DataFrame) -> DataFrame:
    """Latest receipt date per year and person, NULL if none was ever received.

    The chosen application is the one received last, and the receipt date is the
    only thing kept of it, so this is a plain maximum: it combines before the
    shuffle and needs no sort. ``latest_application_rows`` returns whole rows.
    """
    return isir.groupBy("ISIRYear", *APPLICANT).agg(
        F.max("ApplicationReceiptDate").alias("ApplicationReceiptDate")
    )


def latest_application_rows(isir: DataFrame) -> DataFrame:
    """The whole latest application per year and person, ties broken by date and id."""
    window = Window.partitionBy("ISIRYear", *APPLICANT).orderBy(
        F.col("ApplicationReceiptDate").desc_nulls_last(),
        F.col("TransactionReceiptDate").desc_nulls_last(),
        F.col("ISIRID").desc_nulls_last(),
    )
    return (
        isir.withColumn("__rn", F.row_number().over(window)).filter(F.col("__rn") == 1).drop("__rn")
    )


def _collate(df: DataFrame, columns: Sequence[str], cfg: CohortConfig) -> DataFrame:
    if cfg.name_collation is None:
        return df
    return df.withColumns({c: F.collate(F.col(c), cfg.name_collation) for c in columns})


def match_applications(
    students: DataFrame, isir: DataFrame, cfg: CohortConfig, hot: Sequence[int] | None = None
) -> DataFrame:
    """Add each student's latest receipt date, matched on year, name and birth date.

    ``hot`` lists the person keys that very many students share, as ``frequent_people`` finds them. Their
    applications, one row per key, are broadcast; their students, and those lacking part of
    the key, get a place of their own in the join of all others, where they match nobody. Nothing else is done to
    either side, so an application is shuffled once: what combined it is what the join needs.

    Without a list, or where names are matched by a collation, a slot beside the key makes the application side
    shuffle once more, as bare rows, the shape in which adaptive execution can split a key.
    """
    # Without a receipt date an application changes nothing, matched or not.
    received = isir.filter(F.col("ApplicationReceiptDate").isNotNull()).withColumn(
        "ISIRYear", F.col("ISIRYear").cast("int")
    )
    if hot is None or cfg.name_collation is not None:
        return _match_in_slots(students, received, cfg)
    mine, theirs = person_key("SchoolYear", *PERSON), person_key("ISIRYear", *APPLICANT)
    apart = mine.isNull() | (mine.isin(*hot) if hot else F.lit(False))
    spread = F.pmod(F.xxhash64("StudentID", "SchoolCode"), F.lit(UNMATCHABLE_SLOTS)).cast("string")
    last, first, born = PERSON
    left = students.select(
        "*", F.when(apart, spread).otherwise(F.col(last)).alias(f"__{last}"),
        F.when(~apart, F.col(first)).alias(f"__{first}"), F.col(born).alias(f"__{born}"),
    )
    usual = _same_person(left, latest_application(received.filter(~theirs.isin(*hot)) if hot else received), "__")
    if not hot:
        return usual
    # at most one row per key that is hot, or shares its hash
    few = stage(latest_application(received.filter(theirs.isin(*hot))), "hot_applications")
    few = few.withColumnRenamed("ApplicationReceiptDate", "__hot_receipt")
    both = _same_person(usual, few, "")
    receipt = F.coalesce("ApplicationReceiptDate", "__hot_receipt").alias("ApplicationReceiptDate")
    return both.select(*students.columns, receipt)


def _same_person(students: DataFrame, applications: DataFrame, prefix: str) -> DataFrame:
    """Left join on year and person; ``prefix`` marks the students' key columns and those go with them."""
    same = F.col("SchoolYear") == F.col("ISIRYear")
    for mine, theirs in zip(PERSON, APPLICANT):
        same = same & (F.col(f"{prefix}{mine}") == F.col(theirs))
    helpers = [f"{prefix}{c}" for c in PERSON] if prefix else []
    return students.join(applications, same, "left").drop("ISIRYear", *APPLICANT, *helpers)


def _match_in_slots(students: DataFrame, received: DataFrame, cfg: CohortConfig) -> DataFrame:
    left = students.select("*", *[F.col(c).alias(f"__{c}") for c in PERSON])
    left = _collate(left, [f"__{c}" for c in PERSON[:2]], cfg)
    incomplete = reduce(or_, [F.col(c).isNull() for c in ("SchoolYear", *PERSON)])
    spread = F.pmod(F.xxhash64("StudentID", "SchoolCode"), F.lit(UNMATCHABLE_SLOTS)).cast("int") + 1
    left = left.withColumn("__slot", F.when(incomplete, spread).otherwise(F.lit(0)))
    right = latest_application(_collate(received, APPLICANT[:2], cfg)).select(
        F.col("ISIRYear"),
        *APPLICANT,
        "ApplicationReceiptDate",
        # always 0, written so that the optimizer keeps it as a join key
        F.pmod(F.col("ISIRYear"), F.lit(1)).alias("__app_slot"),
    )
    condition: Column = (F.col("SchoolYear") == F.col("ISIRYear")) & (
        F.col("__slot") == F.col("__app_slot")
    )
    for mine, theirs in zip(PERSON, APPLICANT):
        condition = condition & (F.col(f"__{mine}") == F.col(theirs))
    return left.join(right, condition, "left").drop(
        "ISIRYear", *APPLICANT, "__slot", "__app_slot", *[f"__{c}" for c in PERSON]
    )


def add_race_title(rows: DataFrame, race_code: DataFrame) -> DataFrame:
    """Race title of the code, or the code itself where it has no title."""
    titles = race_code.select(
        col.code_text(F.col("RaceReportCode")).alias("__code"), F.col("RaceReportTitle").alias("__title")
    )
    mine = F.col("RaceReportCode").cast("string")
    return (
        rows.join(titles, col.code_text(mine) == F.col("__code"), "left")
        .withColumn("RaceReportTitle", F.coalesce("__title", mine))
        .drop("__code", "__title")
    )


def add_sped_definition(rows: DataFrame, sped_code: DataFrame) -> DataFrame:
    """Definition of the special-education code, NULL where it has none."""
    codes = sped_code.select(col.code_text(F.col("SpEd")).alias("__sped"), "SpEdDefinition")
    return rows.join(codes, col.code_text(F.col("SPEDCode")) == F.col("__sped"), "left").drop("__sped")


def completion_flag(receipt_date: Column) -> Column:
    """``Y`` once an application was received, else ``N``."""
    return F.when(receipt_date.isNotNull(), F.lit("Y")).otherwise(F.lit("N"))


def build_extract(
    sources: Mapping[str, DataFrame],
    cfg: CohortConfig,
    school_year: int | None = None,
    school_name: str | None = None,
    as_of: dt.date | None = None,
    snapshots: DataFrame | None = None,
) -> DataFrame:
    """The whole extract, one row per school year, student and school.

    ``snapshots`` lists the latest snapshots if they are known already, as
    ``sources.latest_snapshots`` tells them from folders and footers; else they take a pass
    over two columns. That list and the code tables are staged first, side by side, unless Spark knows
    already that they are small: of unknown size, each would have all students shuffled on its few codes.
    Give ``lookup_reports`` a look first if the code tables are not known to be
    clean, as a repeated code multiplies students.
    """
    enrollment = optional_eq(sources["enrollment"], "SchoolYear", school_year)
    isir = optional_eq(sources["isir"], "ISIRYear", school_year)
    small = {name: sources[name] for name in ("school", "district", "race_code", "sped_code")}
    if snapshots is None:
        find_hot = cfg.hot_rows is not None and cfg.name_collation is None
        small["latest_snapshot"] = latest_snapshot_with_people(enrollment, cfg) if find_hot else latest_snapshot(enrollment)
        codes = stage_all(small)
        listed = codes["latest_snapshot"]
    else:
        codes = stage_all(small)
        listed = optional_eq(snapshots, "SchoolYear", school_year)
    latest = listed.select("SchoolYear", "maxasof")
    hot = frequent_people(listed, cfg.hot_rows) if "people" in listed.columns and cfg.hot_rows is not None else None

    cohort = snapshot_rows(cohort_filter(enrollment, cfg), latest)
    named = cohort_columns(add_names(cohort, codes["school"], codes["district"]))
    matched = match_applications(dedup_cohort(named), isir, cfg, hot)
    labelled = add_sped_definition(
        add_race_title(matched, codes["race_code"]), codes["sped_code"]
    )
    extract = labelled.withColumns(
        {
            "asOf": F.lit(as_of) if as_of else F.current_date(),
            "CompletedFAFSA": completion_flag(F.col("ApplicationReceiptDate")),
        }
    )
    return optional_eq(extract, "SchoolName", school_name).select(*EXTRACT_SCHEMA)


def sort_extract(extract: DataFrame) -> DataFrame:
    """Presentation order, newest year first; for sinks only."""
    return extract.orderBy(
        F.col("SchoolYear").desc_nulls_last(),
        *[F.col(c).asc_nulls_first() for c in ("DistrictName", "SchoolName", "StudentID")],
    )
