import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortspan.config import EXCLUDED_SCHOOLS, CohortConfig
from cohortspan.operators import extract
from cohortspan.sources.schemas import EXTRACT_SCHEMA, SOURCE_SCHEMAS
from cohortspan.staging import stage
from tests.conftest import SF_DIR, final_plan, records

CFG = CohortConfig()
BORN = dt.date(2000, 5, 1)
TYPES = {role: ", ".join(f"{k} {v}" for k, v in schema.items()) for role, schema in SOURCE_SCHEMAS.items()}


def enrolled(spark, *rows):
    """Enrolment rows from the given values over defaults."""
    default = {name: None for name in SOURCE_SCHEMAS["enrollment"]} | {
        "SchoolYear": 2020, "AsOf": dt.date(2020, 6, 1), "StudentID": 1, "LastName": "Li",
        "FirstName": "Ana", "BirthDate": BORN, "SchoolCode": "S1", "DistrictCode": "D1", "Grade": "12",
    }
    return spark.createDataFrame([tuple((default | r).values()) for r in rows], TYPES["enrollment"])


def applied(spark, *rows):
    default = {
        "ISIRYear": 2020, "ISIRID": 1, "StudentFirstName": "Ana", "StudentLastName": "Li",
        "StudentDateOfBirth": BORN, "ApplicationReceiptDate": None, "TransactionReceiptDate": None,
    }
    return spark.createDataFrame([tuple((default | r).values()) for r in rows], TYPES["isir"])


def sources(spark, enrollment, isir, **tables):
    rows = {
        "school": [(2020, "S1", "One"), (2020, "S2", "Two")],
        "district": [(2020, "D1", "North"), (2020, "D2", "South")],
        "race_code": [("1", "African American")],
        "sped_code": [("2", "Learning")],
    } | tables
    frames = {role: spark.createDataFrame(data, TYPES[role]) for role, data in rows.items()}
    return frames | {"enrollment": enrollment, "isir": isir}


def test_only_the_last_snapshot_of_each_year_counts(spark):
    rows = enrolled(
        spark, {"AsOf": dt.date(2020, 1, 1), "StudentID": 1}, {"StudentID": 2},
        {"SchoolYear": 2019, "AsOf": dt.date(2019, 2, 1), "StudentID": 3},
    )
    kept = extract.snapshot_rows(rows, extract.latest_snapshot(rows))
    assert sorted(r["StudentID"] for r in records(kept)) == [2, 3]


def test_cohort_filter_drops_other_grades_excluded_and_unknown_schools(spark):
    rows = enrolled(
        spark, {"StudentID": 1}, {"StudentID": 2, "Grade": "11"}, {"StudentID": 3, "Grade": None},
        {"StudentID": 4, "SchoolCode": EXCLUDED_SCHOOLS[0]}, {"StudentID": 5, "SchoolCode": None},
    )
    assert [r["StudentID"] for r in records(extract.cohort_filter(rows, CFG))] == [1]


def test_first_name_wins_and_missing_students_are_one_group(spark):
    rows = enrolled(
        spark, {"LastName": "Zed"}, {"LastName": "Abe", "Gender": "F"}, {"LastName": "Abe", "Gender": "M"},
        {"StudentID": None, "LastName": "B"}, {"StudentID": None, "LastName": "A"},
    ).selectExpr("*", "'One' AS SchoolName", "'North' AS DistrictName")
    kept = {r["StudentID"]: r for r in records(extract.dedup_cohort(extract.cohort_columns(rows)))}
    assert kept[1]["LastName"] == "Abe" and kept[1]["Gender"] == "F"
    assert kept[None]["LastName"] == "A" and len(kept) == 2


def test_maximum_equals_the_latest_whole_row(spark):
    isir = applied(
        spark, {"ISIRID": 1, "ApplicationReceiptDate": dt.date(2020, 1, 1)},
        {"ISIRID": 2, "ApplicationReceiptDate": dt.date(2020, 3, 1)}, {"ISIRID": 3},
        {"ISIRID": 4, "StudentFirstName": None}, {"ISIRID": 5, "StudentFirstName": "Bo"},
        {"ISIRID": 6, "ApplicationReceiptDate": dt.date(2020, 3, 1), "TransactionReceiptDate": BORN},
    )
    whole = extract.latest_application_rows(isir)
    dates = extract.latest_application(isir)
    assert sorted(map(str, whole.select(dates.columns).collect())) == sorted(map(str, dates.collect()))
    assert {r["ISIRID"] for r in records(whole)} == {4, 5, 6}


def test_match_needs_the_whole_person_key(spark):
    students = enrolled(
        spark, {"StudentID": 1}, {"StudentID": 2, "LastName": None}, {"StudentID": 3, "FirstName": "Bo"},
        {"StudentID": 4, "SchoolCode": "S2"},
    )
    isir = applied(
        spark, {"ApplicationReceiptDate": dt.date(2020, 3, 1)},
        {"StudentLastName": None, "ApplicationReceiptDate": dt.date(2020, 4, 1)},
    )
    matched = extract.match_applications(students, isir, CFG)
    assert matched.columns == [*students.columns, "ApplicationReceiptDate"]
    got = {r["StudentID"]: r["ApplicationReceiptDate"] for r in records(matched)}
    assert got == {1: dt.date(2020, 3, 1), 2: None, 3: None, 4: dt.date(2020, 3, 1)}


def test_name_collation_is_optional(spark):
    students = enrolled(spark, {"LastName": "LI "})
    isir = applied(spark, {"ApplicationReceiptDate": dt.date(2020, 3, 1)},
                   {"StudentLastName": "li", "ApplicationReceiptDate": dt.date(2020, 4, 1)})
    loose = CohortConfig(name_collation="UTF8_LCASE_RTRIM")
    exact = records(extract.match_applications(students, isir, CFG))
    assert [r["ApplicationReceiptDate"] for r in exact] == [None]
    folded = records(extract.match_applications(students, isir, loose))
    assert [r["ApplicationReceiptDate"] for r in folded] == [dt.date(2020, 4, 1)]
    assert folded[0]["LastName"] == "LI "


def test_extract_lookups_flag_and_columns(spark):
    rows = enrolled(
        spark,
        {"StudentID": 1, "RaceEDEN": "1", "SPEDCode": "2"},
        {"StudentID": 2, "FirstName": "Bo", "RaceEDEN": "9", "SPEDCode": "9"},
        {"StudentID": 3, "FirstName": "Cy"},
        {"StudentID": 4, "SchoolCode": "S9"},  # no such school
        {"StudentID": 5, "FirstName": "Di", "DistrictCode": "D2", "SchoolCode": "S2"},
        {"StudentID": 5, "FirstName": "Di"},
    )
    isir = applied(
        spark, {"ApplicationReceiptDate": dt.date(2020, 3, 1)}, {"StudentFirstName": "Bo"},
        {"StudentFirstName": "Di", "ApplicationReceiptDate": dt.date(2020, 5, 1)},
    )
    result = extract.build_extract(sources(spark, rows, isir), CFG, as_of=dt.date(2021, 1, 1))
    assert result.columns == list(EXTRACT_SCHEMA)
    got = records(result)
    by_id = {(r["StudentID"], r["DistrictName"]): r for r in got}
    assert set(by_id) == {(1, "North"), (2, "North"), (3, "North"), (5, "North"), (5, "South")}
    assert by_id[1, "North"]["RaceReportTitle"] == "African American"
    assert by_id[1, "North"]["SpEdDefinition"] == "Learning"
    assert by_id[2, "North"]["RaceReportTitle"] == "9" and by_id[2, "North"]["SpEdDefinition"] is None
    assert by_id[3, "North"]["RaceReportTitle"] is None
    # an application without receipt date is not a completion
    assert [by_id[i, "North"]["CompletedFAFSA"] for i in (1, 2, 3, 5)] == ["Y", "N", "N", "Y"]
    assert {r["asOf"] for r in got} == {dt.date(2021, 1, 1)}


def test_extract_parameters(spark):
    rows = enrolled(spark, {}, {"StudentID": 2, "SchoolCode": "S2"},
                    {"SchoolYear": 2019, "AsOf": dt.date(2019, 6, 1)})
    tables = sources(spark, rows, applied(spark, {}), school=[(2019, "S1", "Old"), (2020, "S1", "One"), (2020, "S2", "Two")],
                     district=[(2019, "D1", "North"), (2020, "D1", "North")])
    assert extract.build_extract(tables, CFG).count() == 3
    assert [r["SchoolName"] for r in records(extract.build_extract(tables, CFG, school_year=2019))] == ["Old"]
    assert [r["StudentID"] for r in records(extract.build_extract(tables, CFG, school_name="Two"))] == [2]


def test_repeated_lookup_codes_multiply_rows_and_are_reported(spark):
    from cohortspan.operators.quality import repeated_lookup_codes

    rows = enrolled(spark, {"RaceEDEN": "1"}).withColumnRenamed("RaceEDEN", "RaceReportCode")
    lookup = spark.createDataFrame([("1", "a"), ("1", "b")], TYPES["race_code"])
    assert extract.add_race_title(rows, lookup).count() == 2
    assert [r["n"] for r in records(repeated_lookup_codes(lookup, ["RaceReportCode"]))] == [2]


@pytest.fixture
def shuffled_joins(settings):
    """Joins as on data too large to broadcast, with small skew thresholds."""
    settings(**{
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
    })


def _many_students(spark, last_name, count=30000):
    """A third of the students share one last name, or all lack it."""
    names = f"CASE WHEN id % 3 = 0 THEN {last_name} ELSE concat('n', id) END"
    columns = {name: f"CAST(NULL AS {kind})" for name, kind in SOURCE_SCHEMAS["enrollment"].items()} | {
        "SchoolYear": "2020", "StudentID": "id", "LastName": names, "FirstName": "'Ana'",
        "BirthDate": "DATE'2000-05-01'", "SchoolCode": "'S1'",
    }
    frame = spark.range(0, count, 1, 8)
    return frame.selectExpr(*[f"{expression} AS {name}" for name, expression in columns.items()])


def test_shared_person_key_is_split(spark, shuffled_joins):
    students = _many_students(spark, "'Li'")
    isir = applied(spark, {"ApplicationReceiptDate": dt.date(2020, 3, 1)})
    matched = extract.match_applications(students, isir, CFG)
    assert "skew=true" in final_plan(matched)
    assert matched.filter("ApplicationReceiptDate IS NOT NULL").count() == 10000
    assert matched.count() == 30000


def test_incomplete_person_keys_are_spread(spark, shuffled_joins):
    students = _many_students(spark, "CAST(NULL AS STRING)")
    isir = applied(spark, {"ApplicationReceiptDate": dt.date(2020, 3, 1)})
    matched = extract.match_applications(students, isir, CFG)
    assert matched.count() == 30000
    assert "skew=true" not in final_plan(matched)


def test_plans_prune_early(spark):
    from fixtures import queries

    plan = final_plan(queries.dedup_cohort(spark, SF_DIR))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    receipts = final_plan(queries.latest_application(spark, SF_DIR))
    assert "Window" not in receipts and "HashAggregate" in receipts


def test_latest_snapshots_prune_partitions(spark, tmp_path):
    rows = enrolled(spark, *[{"AsOf": dt.date(2020, m, 1), "StudentID": m} for m in range(1, 7)])
    path = str(tmp_path / "enrollment")
    rows.write.partitionBy("SchoolYear", "AsOf").parquet(path)
    table = spark.read.parquet(path)

    kept = extract.snapshot_rows(table, stage(extract.latest_snapshot(table), "latest"))
    plan = final_plan(kept)
    assert "dynamicpruning" in plan and "BroadcastHashJoin" in plan
    assert [r["StudentID"] for r in records(kept)] == [6]


def test_codes_compare_as_the_definition_compares_them(spark):
    """Excluded schools by number, joins without trailing blanks, codes put out as they came, titles by the whole code."""
    rows = enrolled(spark, {"StudentID": 1, "SchoolCode": "0516"}, {"StudentID": 2, "SchoolCode": "516 "},
                    {"StudentID": 3, "SchoolCode": "5160"}, {"StudentID": 4, "SchoolCode": "S1 ", "DistrictCode": "D1 "})
    assert [r["StudentID"] for r in records(extract.cohort_filter(rows, CFG))] == [3, 4]
    long_code = "x" * 50
    rows = enrolled(spark, {"SchoolCode": "S1 ", "DistrictCode": "D1 ", "RaceEDEN": long_code + "c", "SPEDCode": "2 "})
    tables = sources(spark, rows, applied(spark, {}), race_code=[(long_code + "a", "A"), (long_code + "b", "B")])
    (got,) = records(extract.build_extract(tables, CFG))
    assert (got["SchoolCode"], got["SchoolName"], got["DistrictName"]) == ("S1 ", "One", "North")
    assert got["RaceReportTitle"] == long_code + "c" and got["SpEdDefinition"] == "Learning"


def test_types_of_the_source_are_filtered_on(spark, tmp_path):
    """Two snapshots of one day are two; integer codes and snapshot times still prune and push down."""
    from cohortspan.sources import load_sources

    times = [dt.datetime(2020, 6, 1, h) for h in (8, 12)]
    rows = enrolled(spark, {"StudentID": 1, "SchoolCode": "7"}).drop("AsOf", "SchoolCode", "Grade")
    frames = [rows.selectExpr("*", f"TIMESTAMP '{t}' AS AsOf", f"{code} AS SchoolCode", "12 AS Grade")
              for t, code in ((times[0], 7), (times[1], 8), (times[1], 516))]
    path = str(tmp_path / "enrollment")
    frames[0].unionByName(frames[1]).unionByName(frames[2]).write.partitionBy("SchoolYear", "AsOf").parquet(path)
    tables = sources(spark, None, applied(spark, {}), school=[(2020, "7", "Seven"), (2020, "8", "Eight")])
    loaded = load_sources(spark, {**tables, "enrollment": {"format": "parquet", "path": path}})
    assert [r["SchoolCode"] for r in records(extract.build_extract(loaded, CFG))] == ["8"]
    cohort = extract.cohort_filter(loaded["enrollment"], CFG)
    plan = final_plan(extract.snapshot_rows(cohort, stage(extract.latest_snapshot(loaded["enrollment"]), "latest")))
    assert "dynamicpruning" in plan and "EqualTo(Grade,12)" in plan and "SchoolCode" in plan.split("PushedFilters")[1]


def test_code_tables_of_unknown_size_are_broadcast(spark):
    """Frames without statistics count as huge; staged they do not have students shuffled on their codes."""
    unknown = lambda df: df.sparkSession.createDataFrame(df.rdd, df.schema)
    tables = sources(spark, enrolled(spark, {"RaceEDEN": "1", "SPEDCode": "2"}), applied(spark, {}))
    tables = {role: unknown(frame) for role, frame in tables.items()}
    plan = final_plan(extract.build_extract(tables, CFG))
    assert plan.count("BroadcastHashJoin") >= 4
    for code in ("RaceReportCode", "SPEDCode", "SchoolCode", "DistrictCode"):
        assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and code in x and "StudentID" not in x]


def test_lookup_report_counts_repeated_codes(spark):
    from cohortspan.operators.quality import lookup_reports

    tables = sources(spark, None, None, race_code=[("1", "a"), ("1 ", "b"), ("2", "c")])
    got = {r["code_table"]: (r["codes"], r["repeated"]) for r in records(lookup_reports(tables))}
    assert got == {"school": (2, 0), "district": (2, 0), "race_code": (2, 1), "sped_code": (1, 0)}


def many_students(spark, hot_rows):
    """Students of whom very many share one person key, some lack part of theirs, and their applications."""
    students = enrolled(spark, {}).drop("StudentID", "LastName", "FirstName", "BirthDate").crossJoin(spark.sql(f"""
        SELECT id AS StudentID,
            CASE WHEN id < {hot_rows} THEN 'Unknown' WHEN id % 10 = 0 THEN NULL ELSE 'L' || id % 400 END AS LastName,
            CASE WHEN id < {hot_rows} THEN 'Unknown' WHEN id % 10 = 1 THEN NULL ELSE 'F' END AS FirstName,
            CASE WHEN id % 10 = 2 AND id >= {hot_rows} THEN NULL ELSE DATE '2000-01-01' END AS BirthDate
        FROM range(6000)"""))
    columns = enrolled(spark, {}).columns
    receipts = applied(spark, {}).drop("StudentLastName", "StudentFirstName", "ApplicationReceiptDate", "StudentDateOfBirth")
    receipts = receipts.crossJoin(spark.sql("""
        SELECT 'L' || id % 300 AS StudentLastName, 'F' AS StudentFirstName, DATE '2000-01-01' AS StudentDateOfBirth,
            date_add(DATE '2020-01-01', CAST(id % 90 AS INT)) AS ApplicationReceiptDate FROM range(2000)
        UNION ALL SELECT 'Unknown', 'Unknown', DATE '2000-01-01', DATE '2020-06-01'
        UNION ALL SELECT '17', NULL, DATE '2000-01-01', DATE '2020-06-01'
        UNION ALL SELECT NULL, 'F', NULL, DATE '2020-06-01'"""))
    return students.select(*columns), receipts.select(*applied(spark, {}).columns)


def test_hot_people_are_matched_by_broadcast(spark, settings):
    students, isir = (stage(df, "side") for df in many_students(spark, 2000))
    listed = stage(extract.latest_snapshot_with_people(students.withColumn("Grade", F.lit("12")), CFG), "listed")
    hot = extract.frequent_people(listed, 1000)
    assert len(hot) == 1
    want = sorted(map(str, extract.match_applications(students, isir, CFG).collect()))
    for threshold in ("10MB", "2KB"):
        settings(**{"spark.sql.autoBroadcastJoinThreshold": threshold})
        for keys in (hot, []):
            matched = extract.match_applications(students, isir, CFG, keys)
            assert matched.columns == [*students.columns, "ApplicationReceiptDate"]
            assert sorted(map(str, matched.collect())) == want


def test_applications_are_shuffled_once_and_hot_students_spread(spark, settings):
    settings(**{
        "spark.sql.autoBroadcastJoinThreshold": "4KB", "spark.sql.adaptive.autoBroadcastJoinThreshold": "4KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    })
    students, isir = (stage(df, "side") for df in many_students(spark, 2000))
    hot = extract.frequent_people(stage(extract.latest_snapshot_with_people(students.withColumn("Grade", F.lit("12")), CFG), "listed"), 1000)

    def exchanges(df):
        return final_plan(df).count("Exchange hashpartitioning")

    known, unknown = (extract.match_applications(students, isir, CFG, keys) for keys in (hot, None))
    assert exchanges(known) == exchanges(extract.match_applications(students, isir, CFG, [])) == exchanges(unknown) - 1
    assert "BroadcastHashJoin" in final_plan(known)
    loads = [r["n"] for r in known.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(loads) < 2 * 6000 / len(loads)


def test_people_are_counted_in_the_latest_snapshot_of_the_cohort(spark):
    rows = []
    for k in range(4):
        rows += [
            {"StudentID": k, "LastName": "Now"}, {"StudentID": k, "LastName": None},
            {"StudentID": k, "LastName": "Then", "AsOf": dt.date(2010, 1, 1)}, {"StudentID": k, "LastName": "Young", "Grade": "11"},
        ]
    listed = extract.latest_snapshot_with_people(enrolled(spark, *rows, {"LastName": "Rare"}), CFG)
    now = enrolled(spark, {"LastName": "Now"}).select(extract.person_key("SchoolYear", *extract.PERSON)).first()[0]
    assert extract.frequent_people(listed, 3) == [now]
    assert records(listed.drop("people")) == records(extract.latest_snapshot(enrolled(spark, *rows)))
    assert extract.frequent_people(listed.limit(0), 3) == []
