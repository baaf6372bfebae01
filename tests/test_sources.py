import datetime as dt
import glob

import pytest

from cohortspan import staging
from cohortspan.config import CohortConfig
from cohortspan.operators import detail
from cohortspan.sources import export_csv, load_app_data, load_sources, read_extract, write_app_data
from cohortspan.sources.schemas import EXTRACT_SCHEMA, SOURCE_SCHEMAS
from fixtures import views
from tests.conftest import SF_DIR, final_plan, records
from tests.test_trend import app_rows, cell

CFG = CohortConfig()


def test_sources_load_from_files_and_tables(spark, tmp_path):
    frames = views.sources(spark, SF_DIR)
    specs = {}
    for role, frame in frames.items():
        path = str(tmp_path / role)
        if role == "isir":
            frame.write.option("header", True).csv(path)
            specs[role] = {"format": "csv", "path": path, "options": {"header": "true"}}
        elif role == "school":
            frame.createOrReplaceTempView("school_codes")
            specs[role] = {"table": "school_codes"}
        else:
            frame.write.parquet(path)
            specs[role] = {"format": "parquet", "path": path}
    loaded = load_sources(spark, specs)
    for role, frame in loaded.items():
        assert {f.name: f.dataType.simpleString() for f in frame.schema} == SOURCE_SCHEMAS[role]
        assert sorted(map(str, frame.collect())) == sorted(map(str, frames[role].collect()))


def test_sources_are_checked(spark):
    frames = views.sources(spark, SF_DIR)
    with pytest.raises(ValueError, match="missing columns: SchoolName"):
        load_sources(spark, frames | {"school": frames["school"].drop("SchoolName")})
    with pytest.raises(ValueError, match="absent"):
        load_sources(spark, {k: v for k, v in frames.items() if k != "isir"})


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "enrollment")
    views.sources(spark, SF_DIR)["enrollment"].write.parquet(path)
    from cohortspan.operators.extract import cohort_filter

    table = spark.read.parquet(path)
    plan = final_plan(cohort_filter(table, CFG).select("StudentID"))
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "EqualTo(Grade,12)" in scan and "ReadSchema: struct<StudentID:bigint,SchoolCode:string,Grade:string>" in scan


def test_every_spelling_of_missing_is_read_as_null(spark, tmp_path):
    names = list(EXTRACT_SCHEMA)[::-1]  # column order does not matter
    values = {"SchoolYear": "2020", "StudentID": " 7 ", "SchoolCode": "0516", "Gender": "NA", "ELL": "NULL",
              "Migrant": '" NA "', "SchoolName": '"A ""quoted"", name"', "ApplicationReceiptDate": "2020-03-01",
              "CompletedFAFSA": "Y"}
    line = ",".join(values.get(name, "") for name in names)
    (tmp_path / "extract.csv").write_text(",".join(names) + "\n" + line + "\n")
    row = records(read_extract(spark, str(tmp_path / "extract.csv")))[0]
    assert list(row) == list(EXTRACT_SCHEMA)
    assert row["SchoolYear"] == 2020 and row["StudentID"] == 7 and row["SchoolCode"] == "0516"
    assert row["ApplicationReceiptDate"] == dt.date(2020, 3, 1) and row["CompletedFAFSA"] == "Y"
    assert row["SchoolName"] == 'A "quoted", name'
    assert [row[c] for c in ("Gender", "ELL", "Migrant", "BirthDate")] == [None] * 4


def test_app_data_round_trip_prunes_partitions(spark, tmp_path):
    app = app_rows(spark, cell("school", 1, 1, 2), cell("lea", 1, 1, 2, year=2021), cell("state", 13, 1, 2, gender=None))
    path = str(tmp_path / "nested" / "app_data")
    write_app_data(app, path)
    write_app_data(app, path)  # replaces
    back = load_app_data(spark, path)
    assert sorted(map(str, back.select(app.columns).collect())) == sorted(map(str, app.collect()))
    plan = final_plan(back.filter("level = 'lea' AND SchoolYear = 2021"))
    assert "PartitionFilters: [isnotnull(level" in plan
    assert len(glob.glob(f"{path}/level=*/SchoolYear=*/*.parquet")) == 3


def test_export_has_header_and_na(spark, tmp_path):
    rows = app_rows(spark, cell("school", 1, 1, 3), cell("state", 13, 1, None, status=None))
    path = export_csv(detail.detail_table(rows), str(tmp_path), dt.date(2024, 2, 3), single_file=True)
    assert path.endswith("/fafsa_completion_2024-02-03.csv")
    (part,) = glob.glob(f"{path}/part-*.csv")
    assert open(part).read().splitlines() == [
        "School Year,District Name,School Name,Grade,Gender,Race,Application Receipt Month,Status,Count,Seniors,Percent",
        "2020,North,One,12,Female,White,October,Complete,1,3,33.3",
        "2020,All LEAs,All Schools,12,Female,White,No Receipt,NA,1,NA,NA",
    ]


def test_staged_frame_has_a_known_size(spark):
    table = staging.stage(spark.range(1000).selectExpr("id", "id % 7 AS k"), "numbers")
    assert table.count() == 1000
    size = table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert 0 < size < 100_000


def session(master, folder=None):
    from types import SimpleNamespace

    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: folder or default),
        sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"),
    )


def test_shared_folder_comes_from_the_session():
    assert staging.shared_dir(session("yarn", "hdfs://shared/")) == "hdfs://shared"
    own = staging.shared_dir(session("local[8]"))
    assert own == staging.shared_dir(session("local[8]")) != staging.shared_dir(session("local[4]"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_dir(session("spark://host:7077"))


def test_staged_tables_go_with_their_scope(spark):
    with staging.staged_tables(spark) as kept:
        inner = staging.stage(spark.range(5), "inner")
        result = kept(inner.selectExpr("id + 1 AS id"), "result")
        (inside,) = {f.rsplit("/", 1)[0] for f in inner.inputFiles()}
    assert not glob.glob(inside.removeprefix("file://"))
    assert result.count() == 5


def test_csv_files_must_agree_on_their_header(spark, tmp_path):
    names = list(EXTRACT_SCHEMA)
    (tmp_path / "a.csv").write_text(",".join(names) + "\n" + ",".join(["NA"] * len(names)) + "\n")
    (tmp_path / "b.csv").write_text(",".join(names[::-1]) + "\n" + ",".join(["NA"] * len(names)) + "\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_extract(spark, str(tmp_path)).collect()
