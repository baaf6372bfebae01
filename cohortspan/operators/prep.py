"""From the extract to rows ready for counting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.config import CohortConfig
from cohortspan.functions import columns as col
from cohortspan.functions.relational import null_safe_join
from cohortspan.sources.schemas import EXTRACT_SCHEMA
from cohortspan.staging import stage

ROSTER = ("DistrictCode", "DistrictName", "SchoolCode", "SchoolName")
PREP_COLUMNS = tuple(c for c in EXTRACT_SCHEMA if c not in ("asOf", "BirthDate", "SPEDCode"))


def summary_columns(cfg: CohortConfig) -> list[str]:
    """The extract's columns that the summary table depends on."""
    subgroups = [cfg.subgroup(name).source for name in cfg.subgroups]
    return ["SchoolYear", "StudentID", *ROSTER, "Grade", *subgroups,
            "ApplicationReceiptDate", "CompletedFAFSA"]


def latest_year(extract: DataFrame) -> DataFrame:
    """Most recent school year, as one row."""
    return extract.agg(F.max("SchoolYear").alias("latest_year"))


def school_roster(extract: DataFrame) -> DataFrame:
    """Schools of the latest year with their districts and current names."""
    newest = latest_year(extract).scalar()
    return extract.filter(F.col("SchoolYear") == newest).select(*ROSTER).distinct()


def restrict_relabel(extract: DataFrame, roster: DataFrame) -> DataFrame:
    """Keep schools on the roster and show every year under today's names.

    The extract may come with fewer columns than usual; those present are kept.
    """
    bare = extract.drop("DistrictName", "SchoolName")
    return null_safe_join(bare, roster, ["DistrictCode", "SchoolCode"]).select(
        *[c for c in PREP_COLUMNS if c in extract.columns]
    )


def year_floor(rows: DataFrame, cfg: CohortConfig) -> DataFrame:
    return rows.filter(F.col("SchoolYear") >= cfg.min_year)


def recode_rows(rows: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Codes as text, labels for the subgroups and the status, receipt month."""
    labels = {
        "DistrictCode": F.col("DistrictCode").cast("string"),
        "SchoolCode": F.col("SchoolCode").cast("string"),
        "completedFAFSA": col.status_label(F.col("CompletedFAFSA"), cfg),
        "month_idx": col.month_index(F.col("ApplicationReceiptDate")),
    }
    for name in cfg.subgroups:
        subgroup = cfg.subgroup(name)
        code = F.col(subgroup.source)
        labels[name] = col.recode(code, subgroup.labels, default=code if subgroup.keeps_others else None)
    replaced = {name.lower() for name in labels}
    kept = [F.col(c) for c in rows.columns if c.lower() not in replaced]
    return rows.select(
        *kept,
        *[column.alias(name) for name, column in labels.items()],
        col.month_name(labels["month_idx"]).alias("ApplicationReceiptMonth"),
    )


def prepare(extract: DataFrame, cfg: CohortConfig, roster: DataFrame | None = None) -> DataFrame:
    """Current schools only, relabelled, from the first wanted year on, recoded.

    Without a ``roster``, ``extract`` is read three times (latest year, roster, rows): pass a table,
    a file or a staged frame. The roster is staged so that its size is known.
    """
    if roster is None:
        roster = stage(school_roster(extract), "roster")
    return recode_rows(year_floor(restrict_relabel(extract, roster), cfg), cfg)
