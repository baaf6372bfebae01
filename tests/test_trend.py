from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cohortspan.config import CohortConfig, Selection
from cohortspan.functions import columns as col
from cohortspan.operators import detail, trend
from cohortspan.plans import selection_outputs
from tests.conftest import final_plan, records

CFG = CohortConfig()
NOSUB = replace(CFG, subgroups=())
SCHEMA = (
    "level string, SchoolYear int, DistrictCode string, DistrictName string, SchoolCode string, "
    "SchoolName string, Grade string, gender string, race string, ApplicationReceiptMonth string, "
    "completedFAFSA string, n bigint, seniors bigint, month_idx int, level_idx int"
)
SCOPES = {
    "school": ("D1", "North", "S1", "One"), "lea": ("D1", "North", "All Schools", "All Schools"),
    "state": ("All LEAs", "All LEAs", "All Schools", "All Schools"),
}


def cell(level, month_idx, n, seniors, status="Complete", year=2020, gender="Female", race="White", scope=None):
    names = ["October", "November", "December", "January", "February", "March", "April", "May", "June",
             "July", "August", "September", "No Receipt"]
    return (level, year, *(scope or SCOPES[level]), "12", gender, race, names[month_idx - 1], status,
            n, seniors, month_idx, ["school", "lea", "state"].index(level) + 1)


def app_rows(spark, *cells):
    return spark.createDataFrame(list(cells), SCHEMA)


@pytest.fixture
def app(spark):
    return app_rows(
        spark,
        cell("school", 2, 3, 10), cell("school", 4, 2, 10), cell("school", 11, 5, 10),
        cell("school", 13, 1, 10, status="Incomplete"),
        cell("school", 2, 1, 4, year=2021), cell("school", 1, 9, 9, race=None), cell("school", 1, 9, 9, race="NA"),
        cell("lea", 1, 5, 20), cell("lea", 9, 5, 20),
        cell("state", 13, 7, 7, status="Incomplete"),
    )


def test_cumulative_trend(spark, app):
    rows = [r for r in records(trend.cumulative_trend(app, CFG)) if r["level"] == "school"]
    rows.sort(key=lambda r: r["month_idx"])
    assert [r["completed"] for r in rows] == [0, 4, 0, 2, 0, 0, 0, 0, 0]
    assert [r["cum_completed"] for r in rows] == [0, 4, 4, 6, 6, 6, 6, 6, 6]
    assert {r["seniors"] for r in rows} == {14}  # 10 in 2020 and 4 in 2021, each once
    assert rows[1]["completion_rate"] == 4 / 14
    assert rows[0]["ApplicationReceiptMonth"] == "October" and rows[8]["ApplicationReceiptMonth"] == "June"


def test_lines_without_a_completion_are_left_out(spark, app):
    lines = {(r["group"], r["group_idx"]) for r in records(trend.cumulative_trend(app, CFG))}
    assert lines == {("One", 1), ("North", 2)}


def test_wide_job_equals_the_steps(spark, app):
    monthly = trend.monthly_completed(app, CFG)
    steps = trend.fill_denominators(trend.complete_months(monthly, CFG), CFG)
    columns = ["group", "level", "gender", "race", "month_idx", "ApplicationReceiptMonth", "completed", "seniors"]
    one_go = trend.cumulative_trend(app, CFG)
    assert sorted(map(str, steps.select(columns).collect())) == sorted(map(str, one_go.select(columns).collect()))


def test_equal_school_and_district_names_stay_apart(spark):
    scope = ("D1", "North", "S1", "North")
    app = app_rows(spark, cell("school", 1, 1, 2, scope=scope), cell("lea", 1, 3, 6))
    rows = [r for r in records(trend.cumulative_trend(app, CFG)) if r["month_idx"] == 9]
    assert sorted((r["group"], r["level"], r["cum_completed"], r["seniors"]) for r in rows) == [
        ("North", "lea", 3, 6), ("North", "school", 1, 2),
    ]


def test_no_denominator_gives_no_rate(spark):
    rows = records(trend.cumulative_trend(app_rows(spark, cell("state", 1, 1, None)), CFG))
    assert len(rows) == 9
    assert {r["seniors"] for r in rows} == {0} and {r["completion_rate"] for r in rows} == {None}


def test_monthly_trend_keeps_scopes_without_completions(spark, app):
    rows = records(trend.monthly_trend(app.filter("SchoolYear = 2020 AND race = 'White'"), NOSUB))
    by_level = {level: sorted((r for r in rows if r["level"] == level), key=lambda r: r["month_idx"])
                for level in SCOPES}
    assert [len(v) for v in by_level.values()] == [9, 9, 9]
    assert [r["completed"] for r in by_level["school"]] == [0, 3, 0, 2, 0, 0, 0, 0, 0]
    assert by_level["school"][1]["completion_rate"] == 0.3
    assert {r["completed"] for r in by_level["state"]} == {0} and by_level["state"][0]["seniors"] == 7
    empty = records(trend.monthly_trend_empty(app.filter("SchoolYear = 2020 AND race = 'White'"), NOSUB))
    assert len(empty) == 9 and {r["group"] for r in empty} == {"State"}


def test_all_scopes_equal_one_selection_at_a_time(spark):
    other = ("D1", "North", "S2", "Two")
    far = ("D2", "South", "S3", "Three")
    app = app_rows(
        spark, cell("school", 1, 1, 5), cell("school", 2, 1, 4, gender="Male", race="Latine"),
        cell("school", 3, 2, 6, scope=other), cell("school", 12, 2, 6, scope=far, race="Latine"),
        cell("school", 1, 2, 6, scope=far, gender=None),
        cell("lea", 1, 3, 11), cell("lea", 2, 1, 4, gender="Male", race="Latine"),
        cell("lea", 5, 1, 8, scope=("D2", "South", "All Schools", "All Schools"), race="Latine"),
        cell("state", 1, 3, 30), cell("state", 2, 2, 9, gender="Male", race="Latine"),
        cell("state", 2, 2, 9, gender="Female", race="Latine"), cell("state", 2, 2, 9, race="Other"),
    )
    shared = ["group", "group_idx", "level", "gender", "race", "seniors", "month_idx", "completed",
              "cum_completed", "completion_rate"]
    every = trend.trend_all_scopes(app, CFG)
    for district, school in (("North", "One"), ("North", "Two"), ("South", "Three")):
        own = app.filter((F.col("level") == "school") & (F.col("SchoolName") == school))
        values = lambda name: tuple(r[0] for r in own.select(name).distinct().collect() if r[0])
        selection = Selection((2020,), district, school, values("gender"), values("race"))
        alone = trend.cumulative_trend(detail.scope_filter(app, selection), CFG)
        mine = every.filter((F.col("scope_district") == district) & (F.col("scope_school") == school))
        assert alone.count() > 0
        assert sorted(map(str, mine.select(shared).collect())) == sorted(map(str, alone.select(shared).collect()))


def test_the_state_line_in_demand_is_split(spark, settings):
    """Without broadcasting, the requests for one state line are spread."""
    settings(**{
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    })
    count = 20000
    schools = app_rows(spark, cell("school", 1, 1, 5)).drop("SchoolCode", "SchoolName").crossJoin(
        spark.range(count).selectExpr("concat('S', id) AS SchoolCode", "concat('School ', id) AS SchoolName")
    )
    rest = app_rows(spark, cell("lea", 1, 3, 11), cell("state", 1, 3, 30))
    every = trend.trend_all_scopes(schools.unionByName(rest), NOSUB)
    assert "skew=true" in final_plan(every)
    counts = {r["level"]: r["count"] for r in every.groupBy("level").count().collect()}
    assert counts == {level: count * 9 for level in SCOPES}


def test_labels(spark):
    frame = spark.createDataFrame([(0.125,), (0.0635,), (1.0,), (None,)], "r double")
    texts = frame.select(col.percent_text(F.col("r"), 0), col.percent_text(F.col("r"), 1)).collect()
    assert [tuple(t) for t in texts] == [("12%", "12.5%"), ("6%", "6.4%"), ("100%", "100.0%"), (None, None)]
    labelled = records(trend.trend_labels(trend.cumulative_trend(app_rows(spark, cell("state", 1, 1, 2)), CFG)))
    assert {(r["month_label"], r["rate_label"]) for r in labelled} >= {("Oct", "50%"), ("Jun", "50%")}


def test_scope_filter_and_detail(spark, app):
    selection = Selection((2021, 2020), "North", "One", genders=("Female",), races=("White",))
    rows = detail.scope_filter(app, selection)
    assert rows.count() == 8
    table = detail.detail_table(rows.filter("level = 'school' AND month_idx = 2 AND SchoolYear = 2020"))
    assert table.columns == ["School Year", "District Name", "School Name", "Grade", "Gender", "Race",
                             "Application Receipt Month", "Status", "Count", "Seniors", "Percent"]
    assert records(table)[0]["Percent"] == 30.0
    assert "Gender" not in detail.detail_table(rows, ()).columns
    ties = app_rows(spark, cell("state", 1, 1, 16), cell("state", 2, 3, 16), cell("state", 3, 1, 0))
    assert [r["Percent"] for r in records(detail.detail_table(ties))] == [6.2, 18.8, None]


def test_notes(spark, app):
    one = records(detail.scope_note(app.filter("SchoolYear = 2020")))[0]["note"]
    assert one == ("Showing One compared with North and the state for school year 2020. Rates are "
                   "subgroup-specific within the selected gender and race filters.")
    assert " 2020–2021." in records(detail.scope_note(app))[0]["note"]
    year = records(detail.scope_note_year(app.filter("SchoolYear = 2020")))[0]["note"]
    assert year == ("Showing monthly FAFSA completion percentages for One, compared with North and the "
                    "state for school year 2019–20.")
    assert records(detail.scope_note(app.filter("level = 'state'"))) == []
    assert [tuple(r) for r in detail.scope_meta(app).collect()] == [("One", "North")]


def test_selection_outputs_share_one_filtered_set(spark, app):
    selection = Selection((2020,), "North", "One", genders=("Female",), races=("White",))
    outputs = selection_outputs(app, selection, CFG)
    assert outputs["rows"].is_cached
    assert outputs["table"].count() == outputs["rows"].count() == 7
    assert outputs["trend"].count() == 18 and outputs["note"].count() == 1
    outputs["rows"].unpersist()
    monthly = selection_outputs(app, Selection((2020,), "North", "One"), CFG)
    assert "rate_label" in monthly["trend"].columns and "Gender" not in monthly["table"].columns
    monthly["rows"].unpersist()


@pytest.mark.parametrize("missing", [
    {"years": ()}, {"district": ""}, {"school": ""}, {"genders": ()}, {"races": ()},
])
def test_selection_needs_every_input(missing):
    given = {"years": (2020,), "district": "North", "school": "One", "genders": ("Female",), "races": ("White",)}
    with pytest.raises(ValueError):
        Selection(**(given | missing))


def test_selection_without_subgroups_is_one_year(spark, app):
    with pytest.raises(ValueError):
        selection_outputs(app, Selection((2020, 2021), "North", "One"), CFG)
