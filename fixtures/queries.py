"""One Spark query per operator, over the fixture views."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.config import Selection
from cohortspan.functions import columns as col
from cohortspan.operators import choice_index, choices, detail, extract, prep, quality, summary, trend
from cohortspan.operators.gates import Gates
from cohortspan.plans import build_app_data, refresh_app_data, selection_outputs
from cohortspan.sources import (
    export_csv, export_file, latest_snapshots, load_app_data, load_sources, read_extract, write_app_data,
)
from cohortspan.sources.served import bucket_count, publish_trends, school_trend
from cohortspan.sources.tables import conform
from cohortspan.staging import stage, stage_path
from fixtures import views
from fixtures.views import AS_OF, CONFIG, LOW_INCOME

NOSUB = replace(CONFIG, subgroups=())
YEARS = (1999, 2001)
ENDS = (1996, 2000)  # between them lies a school that neither end has
ONE_YEAR = 1999
DISTRICT = "NATION_11"
SCHOOL = "School 116 (2001)"
SELECTION = Selection(
    YEARS, DISTRICT, SCHOOL, genders=("Female", "Male"), races=("Black", "AI & AN", "Latine", "5")
)
YEAR_SELECTION = Selection((ONE_YEAR,), DISTRICT, SCHOOL)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


# -- shared steps -----------------------------------------------------------

def _cohort(spark, sf_dir):
    """Named cohort rows of the latest snapshots, before deduplication."""
    src = views.sources(spark, sf_dir)
    latest = stage(extract.latest_snapshot(src["enrollment"]), "latest_snapshot")
    rows = extract.snapshot_rows(extract.cohort_filter(src["enrollment"], CONFIG), latest)
    return extract.cohort_columns(extract.add_names(rows, src["school"], src["district"]))


def _students(spark, sf_dir):
    return extract.dedup_cohort(_cohort(spark, sf_dir))


def _matched(spark, sf_dir):
    return extract.match_applications(_students(spark, sf_dir), views.isir(spark, sf_dir), CONFIG)


def _extract(spark, sf_dir):
    return extract.build_extract(views.sources(spark, sf_dir), CONFIG, as_of=AS_OF)


def _staged_extract(spark, sf_dir):
    return stage(_extract(spark, sf_dir), "extract")


def _restricted(spark, sf_dir):
    rows = _staged_extract(spark, sf_dir)
    return prep.restrict_relabel(rows, stage(prep.school_roster(rows), "roster"))


def _prepared(spark, sf_dir, cfg=CONFIG):
    return prep.prepare(_staged_extract(spark, sf_dir), cfg)


def _app(spark, sf_dir, cfg=CONFIG):
    return build_app_data(views.sources(spark, sf_dir), cfg, as_of=AS_OF)


def _selected(spark, sf_dir):
    return detail.scope_filter(_app(spark, sf_dir), SELECTION)


def _selected_year(spark, sf_dir):
    return detail.scope_filter(_app(spark, sf_dir, NOSUB), YEAR_SELECTION)


# -- sources ----------------------------------------------------------------

@query
def src_enrollment(spark, sf_dir):
    return views.sources(spark, sf_dir)["enrollment"]


@query
def src_isir(spark, sf_dir):
    return views.sources(spark, sf_dir)["isir"]


@query
def csv_na_tokens(spark, sf_dir):
    """The extract written as CSV with every spelling of a missing value, read back."""
    rows = _extract(spark, sf_dir)
    tokens = {"Gender": "NA", "SpEdDefinition": "NULL", "CD504": " NA ", "ELL": ""}
    text = rows.select([F.col(c).cast("string").alias(c) for c in rows.columns]).fillna(tokens)
    path = stage_path(spark, "extract_csv")
    text.write.option("header", True).option("nullValue", "NULL").csv(path)
    return read_extract(spark, path)


# -- extract ----------------------------------------------------------------

@query
def optional_year_filter(spark, sf_dir):
    rows = views.sources(spark, sf_dir)["enrollment"]
    return extract.optional_eq(
        extract.optional_eq(rows, "SchoolYear", 1999), "SchoolCode", None
    ).select("SchoolYear", "StudentID", "SchoolCode", "Grade")


@query
def latest_snapshot(spark, sf_dir):
    return extract.latest_snapshot(views.sources(spark, sf_dir)["enrollment"])


def _enrollment_folder(spark, sf_dir, *partitions):
    """The enrolment view as a folder of parquet files, and how to read it."""
    path = stage_path(spark, "enrollment")
    rows = views.enrollment(spark, sf_dir)
    rows.repartition(*partitions).write.partitionBy(*partitions).parquet(path)
    return {"format": "parquet", "path": path}


@query
def latest_snapshot_folders(spark, sf_dir):
    return latest_snapshots(spark, _enrollment_folder(spark, sf_dir, "SchoolYear", "AsOf"))


@query
def latest_snapshot_footers(spark, sf_dir):
    return latest_snapshots(spark, _enrollment_folder(spark, sf_dir, "SchoolYear"))


@query
def extract_listed_snapshots(spark, sf_dir):
    spec = _enrollment_folder(spark, sf_dir, "SchoolYear", "AsOf")
    sources = load_sources(spark, {**views.sources(spark, sf_dir), "enrollment": spec})
    return extract.build_extract(sources, CONFIG, as_of=AS_OF, snapshots=latest_snapshots(spark, spec))


@query
def dim_join(spark, sf_dir):
    src = views.sources(spark, sf_dir)
    return extract.add_names(src["enrollment"], src["school"], src["district"]).select(
        "SchoolYear", "StudentID", "SchoolCode", "SchoolName", "DistrictCode", "DistrictName"
    )


@query
def snapshot_rows(spark, sf_dir):
    rows = views.sources(spark, sf_dir)["enrollment"]
    latest = stage(extract.latest_snapshot(rows), "latest_snapshot")
    return extract.snapshot_rows(rows, latest).select("SchoolYear", "AsOf", "StudentID", "SchoolCode", "Grade")


@query
def cohort_filter(spark, sf_dir):
    rows = views.sources(spark, sf_dir)["enrollment"]
    return extract.cohort_filter(rows, CONFIG).select("SchoolYear", "StudentID", "SchoolCode", "Grade")


@query
def dedup_cohort(spark, sf_dir):
    return _students(spark, sf_dir)


@query
def latest_application(spark, sf_dir):
    return extract.latest_application(views.isir(spark, sf_dir))


@query
def latest_application_rows(spark, sf_dir):
    return extract.latest_application_rows(views.isir(spark, sf_dir))


@query
def match_applications(spark, sf_dir):
    return _matched(spark, sf_dir).select(*extract.GRAIN, *extract.PERSON, "ApplicationReceiptDate")


@query
def race_title(spark, sf_dir):
    lookup = views.sources(spark, sf_dir)["race_code"]
    return extract.add_race_title(_students(spark, sf_dir), lookup).select(
        *extract.GRAIN, "RaceReportCode", "RaceReportTitle"
    )


@query
def sped_lookup(spark, sf_dir):
    lookup = views.sources(spark, sf_dir)["sped_code"]
    return extract.add_sped_definition(_students(spark, sf_dir), lookup).select(
        *extract.GRAIN, "SPEDCode", "SpEdDefinition"
    )


@query
def completion_flag(spark, sf_dir):
    receipt = F.col("ApplicationReceiptDate")
    return _matched(spark, sf_dir).select(
        *extract.GRAIN, receipt, extract.completion_flag(receipt).alias("CompletedFAFSA")
    )


@query
def extract_rows(spark, sf_dir):
    return _extract(spark, sf_dir)


@query
def extract_hot_people(spark, sf_dir):
    """The extract with frequent people matched apart; two rows count as many here."""
    return extract.build_extract(views.sources(spark, sf_dir), replace(CONFIG, hot_rows=2), as_of=AS_OF)


QUERIES["extract"] = QUERIES.pop("extract_rows")


@query
def extract_one_school(spark, sf_dir):
    return extract.build_extract(
        views.sources(spark, sf_dir), CONFIG, school_year=2001, school_name=SCHOOL, as_of=AS_OF
    )


@query
def extract_sorted(spark, sf_dir):
    return extract.sort_extract(_extract(spark, sf_dir))


# -- preparation ------------------------------------------------------------

@query
def latest_year(spark, sf_dir):
    return prep.latest_year(_extract(spark, sf_dir))


@query
def school_roster(spark, sf_dir):
    return prep.school_roster(_staged_extract(spark, sf_dir))


@query
def qa_duplicate_keys(spark, sf_dir):
    """Empty where the extract keeps its grain."""
    return quality.duplicate_keys(_extract(spark, sf_dir))


@query
def qa_duplicate_keys_raw(spark, sf_dir):
    """The same report on the cohort before deduplication."""
    return quality.duplicate_keys(_cohort(spark, sf_dir))


@query
def qa_multi_enrolled(spark, sf_dir):
    return quality.multi_enrolled(_extract(spark, sf_dir))


@query
def qa_lookup_codes(spark, sf_dir):
    """Codes of the four code tables, and how many of them a table repeats."""
    return quality.lookup_reports(views.sources(spark, sf_dir))


@query
def qa_gates(spark, sf_dir):
    """What the gates measure while the summary is written."""
    gates = Gates()
    stage(build_app_data(views.sources(spark, sf_dir), CONFIG, as_of=AS_OF, gates=gates), "app_data")
    report = gates.check()
    return spark.createDataFrame([tuple(report.values())], ", ".join(f"{name} long" for name in report))


@query
def export_whole_file(spark, sf_dir):
    """The summary as one CSV file, read back."""
    app = _app(spark, sf_dir)
    path = export_file(app, stage_path(spark, "export"), AS_OF)
    return spark.read.csv(path, header=True, schema=app.schema, nullValue="NA", escape='"', enforceSchema=False)


@query
def qa_crosstab_status(spark, sf_dir):
    return quality.yearly_crosstab(_extract(spark, sf_dir), "CompletedFAFSA")


@query
def qa_crosstab_gender(spark, sf_dir):
    return quality.yearly_crosstab(_extract(spark, sf_dir), "Gender")


@query
def qa_crosstab_race(spark, sf_dir):
    return quality.yearly_crosstab(_extract(spark, sf_dir), "RaceReportTitle")


@query
def restrict_relabel(spark, sf_dir):
    return _restricted(spark, sf_dir)


@query
def year_floor(spark, sf_dir):
    return prep.year_floor(_restricted(spark, sf_dir), CONFIG).select(*extract.GRAIN, "CompletedFAFSA")


@query
def recode_gender(spark, sf_dir):
    rows = views.sources(spark, sf_dir)["enrollment"]
    return rows.select(
        "SchoolYear", "StudentID", F.col("Gender").alias("gender_code"),
        col.gender_label(F.col("Gender"), CONFIG).alias("gender"),
    )


@query
def recode_race(spark, sf_dir):
    src = views.sources(spark, sf_dir)
    rows = src["enrollment"].withColumnRenamed("RaceEDEN", "RaceReportCode")
    return extract.add_race_title(rows, src["race_code"]).select(
        "SchoolYear", "StudentID", "RaceReportTitle",
        col.race_label(F.col("RaceReportTitle"), CONFIG).alias("race"),
    )


@query
def recode_status(spark, sf_dir):
    return _extract(spark, sf_dir).select(
        *extract.GRAIN, F.col("CompletedFAFSA").alias("status_code"),
        col.status_label(F.col("CompletedFAFSA"), CONFIG).alias("completedFAFSA"),
    )


@query
def receipt_month(spark, sf_dir):
    month = col.month_index(F.col("ApplicationReceiptDate"))
    return views.isir(spark, sf_dir).select(
        "ISIRYear", "ISIRID", "ApplicationReceiptDate",
        col.month_name(month).alias("ApplicationReceiptMonth"), month.alias("month_idx"),
    )


@query
def prepared(spark, sf_dir):
    return _prepared(spark, sf_dir)


# -- summaries --------------------------------------------------------------

for _level in summary.SCOPE:
    QUERIES[f"denoms_{_level}"] = (
        lambda spark, sf_dir, level=_level: summary.denominators(_prepared(spark, sf_dir), level, CONFIG)
    )
    QUERIES[f"summary_{_level}"] = (
        lambda spark, sf_dir, level=_level: summary.summarise(_prepared(spark, sf_dir), level, CONFIG)
    )


@query
def app_data(spark, sf_dir):
    return _app(spark, sf_dir)


@query
def app_data_nosub(spark, sf_dir):
    return _app(spark, sf_dir, NOSUB)


@query
def app_data_sorted(spark, sf_dir):
    return summary.sort_app_data(_app(spark, sf_dir), CONFIG)


@query
def app_data_nosub_sorted(spark, sf_dir):
    return summary.sort_app_data(_app(spark, sf_dir, NOSUB), NOSUB, level_order=("school", "lea", "state"))


@query
def app_data_roundtrip(spark, sf_dir):
    path = stage_path(spark, "app_data")
    write_app_data(_app(spark, sf_dir), path)
    return load_app_data(spark, path)


def earlier_sources(sources):
    """The sources as they may have been before: snapshots and applications to come, a school still called otherwise."""
    years = F.col("SchoolYear").isin(1997, 2001)
    late = years & (F.month("AsOf") > 4)
    renamed = F.when(F.col("SchoolCode") == "112", F.lit("Old school")).otherwise(F.col("SchoolName"))
    return {
        **sources,
        "enrollment": sources["enrollment"].filter(~late),
        "isir": sources["isir"].filter("ISIRYear <> 1999 OR ISIRID % 3 > 0"),
        "school": sources["school"].withColumn("SchoolName", renamed),
    }


@query
def app_data_refreshed(spark, sf_dir):
    """The summary table built from earlier sources and then brought up to date."""
    name, path = f"app_data_{uuid.uuid4().hex}", stage_path(spark, "app_data")
    sources = views.sources(spark, sf_dir)
    for state in (earlier_sources(sources), sources):
        refresh_app_data(state, CONFIG, name, path, as_of=AS_OF)
    return spark.table(name)


@query
def qa_coverage(spark, sf_dir):
    return quality.coverage(_app(spark, sf_dir), CONFIG)


@query
def qa_coverage_nosub(spark, sf_dir):
    return quality.coverage(_app(spark, sf_dir, NOSUB), NOSUB)


# -- choices ----------------------------------------------------------------

@query
def choice_years(spark, sf_dir):
    return choices.year_choices(_app(spark, sf_dir))


@query
def choice_districts(spark, sf_dir):
    return choices.all_districts(_app(spark, sf_dir))


@query
def choice_schools(spark, sf_dir):
    return choices.all_schools(_app(spark, sf_dir))


@query
def choice_genders(spark, sf_dir):
    return choices.gender_choices(_app(spark, sf_dir))


@query
def choice_races(spark, sf_dir):
    return choices.race_choices(_app(spark, sf_dir))


@query
def default_selection(spark, sf_dir):
    return choices.default_selection(_app(spark, sf_dir))


@query
def district_choices(spark, sf_dir):
    return choices.district_choices(_app(spark, sf_dir), YEARS)


@query
def school_choices(spark, sf_dir):
    return choices.school_choices(_app(spark, sf_dir), ENDS, DISTRICT)


@query
def school_choices_range(spark, sf_dir):
    return choices.school_choices(_app(spark, sf_dir), ENDS, DISTRICT, whole_range=True)


@query
def subgroup_choices(spark, sf_dir):
    return choices.subgroup_choices(_app(spark, sf_dir), YEARS, DISTRICT, SCHOOL)


@query
def resolve_selection(spark, sf_dir):
    return choices.resolve_selection(_app(spark, sf_dir), YEARS)


def _choice_index(spark, sf_dir):
    """The index written and read back; the summary it comes from is not read again."""
    path = stage_path(spark, "choice_index")
    choice_index.write_choice_index(choice_index.build_choice_index(_app(spark, sf_dir)), path)
    return choice_index.load_choice_index(spark, path)


@query
def indexed_districts(spark, sf_dir):
    return choice_index.indexed_districts(_choice_index(spark, sf_dir), YEARS)


@query
def indexed_schools(spark, sf_dir):
    return choice_index.indexed_schools(_choice_index(spark, sf_dir), ENDS, DISTRICT)


@query
def indexed_schools_range(spark, sf_dir):
    return choice_index.indexed_schools(_choice_index(spark, sf_dir), ENDS, DISTRICT, whole_range=True)


@query
def indexed_subgroups(spark, sf_dir):
    return choice_index.indexed_subgroups(_choice_index(spark, sf_dir), YEARS, DISTRICT, SCHOOL)


@query
def indexed_selection(spark, sf_dir):
    return choice_index.indexed_selection(_choice_index(spark, sf_dir), YEARS)


# -- one selection ----------------------------------------------------------

@query
def scope_filter(spark, sf_dir):
    return _selected(spark, sf_dir)


@query
def scope_filter_year(spark, sf_dir):
    return _selected_year(spark, sf_dir)


@query
def scope_meta(spark, sf_dir):
    return detail.scope_meta(_selected(spark, sf_dir))


@query
def detail_table(spark, sf_dir):
    return detail.detail_table(_selected(spark, sf_dir))


@query
def detail_table_nosub(spark, sf_dir):
    return detail.detail_table(_selected_year(spark, sf_dir), ())


@query
def export_detail(spark, sf_dir):
    """The detail table exported as CSV and read back."""
    table = detail.detail_table(_selected(spark, sf_dir))
    path = export_csv(table, stage_path(spark, "export"), run_date=AS_OF)
    kinds = {field.name: field.dataType.simpleString() for field in table.schema}
    return conform(spark.read.csv(path, header=True, nullValue="NA"), kinds)


@query
def scope_note(spark, sf_dir):
    return detail.scope_note(_selected(spark, sf_dir))


@query
def scope_note_year(spark, sf_dir):
    return detail.scope_note_year(_selected_year(spark, sf_dir))


# -- trends -----------------------------------------------------------------

@query
def pooled_denoms(spark, sf_dir):
    return trend.pooled_denoms(_selected(spark, sf_dir), CONFIG)


@query
def monthly_completed(spark, sf_dir):
    rows = stage(_selected(spark, sf_dir), "selection")
    return trend.monthly_completed(rows, CONFIG)


@query
def complete_months(spark, sf_dir):
    rows = stage(_selected(spark, sf_dir), "selection")
    monthly = stage(trend.monthly_completed(rows, CONFIG), "monthly")
    return trend.complete_months(monthly, CONFIG)


@query
def fill_downup(spark, sf_dir):
    rows = stage(_selected(spark, sf_dir), "selection")
    monthly = stage(trend.monthly_completed(rows, CONFIG), "monthly")
    return trend.fill_denominators(trend.complete_months(monthly, CONFIG), CONFIG)


@query
def cumulative_trend(spark, sf_dir):
    return trend.cumulative_trend(_selected(spark, sf_dir), CONFIG)


@query
def trend_labels(spark, sf_dir):
    return trend.trend_labels(trend.cumulative_trend(_selected(spark, sf_dir), CONFIG))


@query
def monthly_trend(spark, sf_dir):
    return trend.monthly_trend(_selected_year(spark, sf_dir), NOSUB)


@query
def monthly_trend_labels(spark, sf_dir):
    return trend.trend_labels(trend.monthly_trend(_selected_year(spark, sf_dir), NOSUB), decimals=1)


@query
def monthly_trend_lines(spark, sf_dir):
    """Every school, district and the state in every year."""
    return trend.monthly_trend(_app(spark, sf_dir, NOSUB), NOSUB)


@query
def trend_zero_scope(spark, sf_dir):
    """Lines without any completion in the trend months, of all scopes and years."""
    return trend.monthly_trend_empty(_app(spark, sf_dir, NOSUB), NOSUB)


@query
def trend_all_scopes(spark, sf_dir):
    return trend.trend_all_scopes(stage(_app(spark, sf_dir), "app_data"), CONFIG)


def _published_trends(spark, sf_dir):
    name = f"trends_{uuid.uuid4().hex}"
    app = stage(_app(spark, sf_dir), "app_data")
    publish_trends(trend.trend_all_scopes(app, CONFIG), name, bucket_count(app, schools_each=16))
    return name


@query
def served_trends(spark, sf_dir):
    """All trends, from the table that serves them."""
    return spark.table(_published_trends(spark, sf_dir))


@query
def served_school_trend(spark, sf_dir):
    """One school's lines, from its bucket."""
    return school_trend(spark, _published_trends(spark, sf_dir), SCHOOL, DISTRICT)


@query
def trend_all_scopes_range(spark, sf_dir):
    """The same for a choice of years."""
    return trend.trend_all_scopes(stage(_app(spark, sf_dir), "app_data"), CONFIG, years=YEARS)


@query
def trend_all_scopes_per_year(spark, sf_dir):
    """Each year alone, the latest of which is the opening view."""
    return trend.trend_all_scopes(stage(_app(spark, sf_dir), "app_data"), CONFIG, per_year=True)


@query
def app_data_other_subgroup(spark, sf_dir):
    """The summary by a subgroup that only the configuration knows."""
    return _app(spark, sf_dir, LOW_INCOME)


@query
def trend_other_subgroup(spark, sf_dir):
    return trend.trend_all_scopes(stage(_app(spark, sf_dir, LOW_INCOME), "app_data"), LOW_INCOME)


def _as_one(outputs):
    """Trend, note and table of one selection as parts of one result."""
    parts = {
        "trend": {
            "line": "group", "month": "ApplicationReceiptMonth", "n": "completed", "seniors": "seniors",
            "label": "rate_label",
        },
        "note": {"label": "note"},
        "table": {
            "year": "School Year", "line": "School Name", "month": "Application Receipt Month", "n": "Count",
            "seniors": "Seniors", "label": "Status",
        },
    }
    kinds = {"year": "int", "line": "string", "month": "string", "n": "bigint", "seniors": "bigint", "label": "string"}
    frames = [
        outputs[part].select(
            F.lit(part).alias("part"),
            *[(F.col(f"`{names[c]}`") if c in names else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()],
        )
        for part, names in parts.items()
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query
def selection_outputs_range(spark, sf_dir):
    return _as_one(selection_outputs(stage(_app(spark, sf_dir), "app_data"), SELECTION, CONFIG))


@query
def selection_outputs_year(spark, sf_dir):
    return _as_one(selection_outputs(stage(_app(spark, sf_dir, NOSUB), "app_data"), YEAR_SELECTION, CONFIG))


@query
def monthly_trend_all_scopes(spark, sf_dir):
    return trend.monthly_trend_all_scopes(stage(_app(spark, sf_dir, NOSUB), "app_data"), NOSUB)
