"""Measures taken in the summary's own pass, limits, and the single-file export."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from cohortspan.operators import quality
from cohortspan.operators.gates import Gates, QualityBreach
from cohortspan.operators.prep import prepare, summary_columns
from cohortspan.operators.summary import summarise_levels
from cohortspan.plans import drop_app_data, refresh_app_data
from cohortspan.sources import export_csv, export_file, load_app_data, write_app_data
from cohortspan.staging import stage, stage_path
from fixtures import views
from fixtures.queries import CONFIG
from tests.conftest import SF_DIR, final_plan


@pytest.fixture(scope="module")
def prepared(spark):
    from cohortspan.operators.extract import build_extract

    extract = stage(build_extract(views.sources(spark, SF_DIR), CONFIG).select(*summary_columns(CONFIG)), "extract")
    rows = prepare(extract, CONFIG)
    again = rows.where("StudentID % 11 = 0").withColumn("gender", F.lit("Female"))  # rows that repeat a key
    lost = rows.limit(5).withColumn("StudentID", F.lit(None).cast("long"))
    return stage(rows.unionByName(again).unionByName(lost), "prepared")


def test_measures_equal_the_reports(spark, prepared):
    gates = Gates(duplicate_keys=None)
    app = stage(summarise_levels(prepared, CONFIG, gates), "app")
    report = gates.check()
    coverage = quality.coverage(app, CONFIG).agg(
        F.count(F.lit(1)), F.count(F.when(F.col("diff") > 0, 1)), F.count(F.when(F.col("diff") < 0, 1)), F.max("diff")
    ).first()
    assert report["duplicate_keys"] == quality.duplicate_keys(prepared).count() > 0
    assert report["multi_enrolled"] == quality.multi_enrolled(prepared).count()
    assert report["students"] == prepared.select("SchoolYear", "StudentID").distinct().count()
    assert tuple(report[k] for k in ("families", "families_over", "families_short", "largest_excess")) == tuple(coverage)
    assert sorted(map(str, app.collect())) == sorted(map(str, summarise_levels(prepared, CONFIG).collect()))


def test_measures_cost_no_scan_and_no_shuffle(spark, prepared):
    def cost(df):
        plan = final_plan(df)
        return plan.count("Exchange hashpartitioning"), plan.count("Scan parquet")

    assert cost(summarise_levels(prepared, CONFIG, Gates())) == cost(summarise_levels(prepared, CONFIG))


def test_a_breach_keeps_the_table_as_it_was(spark, prepared, tmp_path):
    path = str(tmp_path / "app")
    write_app_data(summarise_levels(prepared.where("SchoolYear = 1998"), CONFIG), path)
    before = sorted(os.listdir(path)), load_app_data(spark, path).count()
    gates = Gates(duplicate_keys=0)
    with pytest.raises(QualityBreach) as breach:
        write_app_data(summarise_levels(prepared, CONFIG, gates), path, gates)
    assert "duplicate_keys" in str(breach.value) and breach.value.report["students"] > 0
    assert (sorted(os.listdir(path)), load_app_data(spark, path).count()) == before
    gates = Gates(duplicate_keys=None, families_over=10**9)
    write_app_data(summarise_levels(prepared, CONFIG, gates), path, gates)
    assert load_app_data(spark, path).count() > before[1]


def test_a_breach_stops_a_refresh(spark):
    name, path = "app_gated", stage_path(spark, "app")
    sources = views.sources(spark, SF_DIR)
    refresh_app_data(sources, CONFIG, name, path)
    before = spark.table(name).count()
    twice = sources["race_code"].unionByName(sources["race_code"])
    with pytest.raises(QualityBreach):
        refresh_app_data({**sources, "race_code": twice}, CONFIG, name, path, gates=Gates())
    assert spark.table(name).count() == before
    assert len([run for run in os.listdir(path.removeprefix("file://")) if run.startswith("run-")]) == 1
    drop_app_data(spark, name, path)


def test_gates_of_an_empty_summary(spark, prepared):
    gates = Gates()
    assert summarise_levels(prepared.limit(0), CONFIG, gates).collect() == []
    assert set(gates.check().values()) == {0}


# -- export as one file --------------------------------------------------------------

def test_one_file_of_many_parts(spark, tmp_path):
    rows = spark.range(1000).repartitionByRange(7, "id").sortWithinPartitions("id").select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit('a "quoted", text\nof two lines')).alias("School Name")
    )
    for _ in range(2):  # the second replaces the first
        path = export_file(rows, str(tmp_path), dt.date(2024, 2, 3))
    assert os.path.isfile(path) and [f for f in os.listdir(tmp_path) if not f.startswith(".")] == [os.path.basename(path)]
    with open(path) as lines:
        head, first = next(lines), next(lines)
    assert head == "id,School Name\n" and first == "0,NA\n"
    back = spark.read.csv(path, header=True, nullValue="NA", escape='"', multiLine=True).collect()
    assert [int(r["id"]) for r in back] == list(range(1000))
    assert back == spark.read.csv(
        export_csv(rows, str(tmp_path / "parts"), dt.date(2024, 2, 3)), header=True, nullValue="NA", escape='"', multiLine=True
    ).orderBy(F.col("id").cast("int")).collect()


def test_no_stage_of_one_task_writes_the_rows(spark, tmp_path):
    rows = spark.range(0, 400, numPartitions=6)
    marked = rows.withColumn("task", F.spark_partition_id())
    path = export_file(marked, str(tmp_path), dt.date(2024, 2, 3))
    assert spark.read.csv(path, header=True).select("task").distinct().count() == 6


def test_an_export_without_rows_has_its_header(spark, tmp_path):
    path = export_file(spark.range(0).withColumn("b", F.lit("x")), str(tmp_path), dt.date(2024, 2, 3))
    with open(path) as file:
        assert file.read() == "id,b\n"
