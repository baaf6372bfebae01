"""Snapshot lists from footers, published tables, refreshes year by year, the choice index."""

import datetime as dt
import os
import uuid
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cohortspan.config import CohortConfig
from cohortspan.operators import choice_index, choices, extract
from cohortspan.plans import build_app_data, drop_app_data, refresh_app_data
from cohortspan.sources import latest_snapshots, load_sources, served, snapshots
from cohortspan.staging import stage, stage_path
from fixtures import views
from fixtures.queries import CONFIG, QUERIES, earlier_sources
from tests.conftest import SF_DIR, final_plan


def bag(df):
    columns = sorted(df.columns)
    return sorted(map(str, df.select(*columns).collect()))


# -- latest snapshots ------------------------------------------------------------

@pytest.fixture
def snapshot_rows(spark):
    return spark.sql("""
        SELECT CAST(2000 + id % 4 AS INT) AS SchoolYear, date_add(DATE '2020-01-01', CAST(id % 4 * 7 + id % 5 AS INT)) AS AsOf,
               id AS StudentID FROM range(400)""")


def written(spark, rows, *partitions):
    path = stage_path(spark, "enrollment")
    rows.write.partitionBy(*partitions).parquet(path)
    return {"format": "parquet", "path": path}


@pytest.mark.parametrize("partitions", [("SchoolYear", "AsOf"), ("AsOf", "SchoolYear"), ("SchoolYear",)])
def test_footers_tell_the_latest_snapshots(spark, snapshot_rows, partitions):
    spec = written(spark, snapshot_rows, *partitions)
    (form,) = snapshots.footer_maxima(spark, spec)
    plan = final_plan(form)
    assert "PushedGroupBy: [SchoolYear" in plan and "StudentID" not in plan
    assert bag(latest_snapshots(spark, spec)) == bag(extract.latest_snapshot(snapshot_rows))


@pytest.mark.parametrize("partitions", [(), ("AsOf",), ("StudentID",)])
def test_other_layouts_are_scanned(spark, snapshot_rows, partitions):
    spec = written(spark, snapshot_rows.where("StudentID < 40"), *partitions)
    assert snapshots.footer_maxima(spark, spec) == []
    assert bag(latest_snapshots(spark, spec)) == bag(extract.latest_snapshot(snapshot_rows.where("StudentID < 40")))


def test_footers_do_not_count_files_without_rows(spark, snapshot_rows):
    for partitions in (("SchoolYear", "AsOf"), ("SchoolYear",)):
        spec = written(spark, snapshot_rows, *partitions)
        empty = snapshot_rows.limit(0).drop("SchoolYear", *partitions)
        empty.write.parquet("/".join([spec["path"], "SchoolYear=2003", "AsOf=2031-01-01"][: 1 + len(partitions)]), mode="append")
        empty.write.parquet("/".join([spec["path"], "SchoolYear=2050", "AsOf=2031-01-01"][: 1 + len(partitions)]))
        assert bag(latest_snapshots(spark, spec)) == bag(extract.latest_snapshot(snapshot_rows))


def test_missing_dates_and_years_are_as_in_a_scan(spark):
    rows = spark.createDataFrame(
        [(2001, None, 1), (2002, dt.date(2020, 1, 1), 2), (2002, None, 3), (None, dt.date(2020, 1, 1), 4)],
        "SchoolYear int, AsOf date, StudentID long",
    )
    for partitions in (("SchoolYear", "AsOf"), ("SchoolYear",), ()):
        assert bag(latest_snapshots(spark, written(spark, rows, *partitions))) == bag(extract.latest_snapshot(rows))


def test_reading_footers_leaves_the_session_as_it_was(spark, snapshot_rows):
    spec = written(spark, snapshot_rows, "SchoolYear")
    before = {k: spark.conf.get(k) for k in ("spark.sql.sources.useV1SourceList", "spark.sql.caseSensitive")}
    latest_snapshots(spark, spec)
    assert before == {k: spark.conf.get(k) for k in before}
    assert "FileScan" in final_plan(spark.read.parquet(spec["path"]))
    assert bag(latest_snapshots(spark, {**spec, "options": {"pathGlobFilter": "*.parquet"}})) == bag(extract.latest_snapshot(snapshot_rows))


def test_listed_snapshots_prune_the_enrolment_scan(spark):
    sources = views.sources(spark, SF_DIR)
    path = stage_path(spark, "enrollment")
    sources["enrollment"].write.partitionBy("SchoolYear", "AsOf").parquet(path)
    spec = {"format": "parquet", "path": path}
    listed = latest_snapshots(spark, spec)
    rows = extract.snapshot_rows(load_sources(spark, {**sources, "enrollment": spec})["enrollment"], listed)
    assert "dynamicpruning" in final_plan(rows)
    assert rows.count() == extract.snapshot_rows(sources["enrollment"], listed).count()


# -- published trends ------------------------------------------------------------

@pytest.fixture
def trends(spark):
    name = f"trends_{uuid.uuid4().hex}"
    yield name, spark.sql("SELECT 's' || id % 300 AS scope_school, 'd' || id % 10 AS scope_district, id FROM range(3000)")
    served.withdraw_trends(spark, name)


def test_one_school_is_one_bucket(spark, settings, trends):
    name, rows = trends
    served.publish_trends(rows, name, 8)
    one = served.school_trend(spark, name, "s77")
    assert bag(one) == bag(rows.where("scope_school = 's77'"))
    assert len(one.select(F.input_file_name()).distinct().collect()) == 1
    assert len(spark.table(name).select(F.input_file_name()).distinct().collect()) == 8
    settings(**{"spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"})
    assert "SelectedBucketsCount: 1 out of 8" in final_plan(served.school_trend(spark, name, "s77"))
    assert served.school_trend(spark, name, "s77", "d3").count() == 0
    assert served.school_trend(spark, name, "s77", "d7").count() == 10
    assert served.school_trend(spark, name, "nowhere").count() == 0


def test_a_new_version_leaves_readers_of_the_old_one_alone(spark, trends):
    name, rows = trends
    tables = [served.publish_trends(rows, name, 2)]
    reader = spark.table(name)
    tables.append(served.publish_trends(rows.where("id < 10"), name, 2))
    assert reader.count() == 3000 and spark.table(name).count() == 10
    tables.append(served.publish_trends(rows.where("id < 20"), name, 2))
    assert [spark.catalog.tableExists(t) for t in tables] == [False, True, True]
    assert served.published_table(spark, name).endswith(tables[-1])
    served.withdraw_trends(spark, name)
    assert not spark.catalog.tableExists(name) and not spark.catalog.tableExists(tables[-1])


def test_buckets_follow_the_number_of_schools(spark):
    app = spark.sql("SELECT 'school' AS level, 's' || id AS SchoolName FROM range(100) UNION ALL SELECT 'lea', 'All'")
    assert served.bucket_count(app, 30) == 4
    assert served.bucket_count(app.limit(0)) == 1


# -- refresh by year ---------------------------------------------------------------

@pytest.fixture
def published(spark):
    name, path = f"app_{uuid.uuid4().hex}", stage_path(spark, "app")
    yield name, path
    drop_app_data(spark, name, path)


def files_by_year(spark, name):
    rows = spark.table(name).select("SchoolYear", F.input_file_name().alias("f")).distinct().collect()
    out = {}
    for r in rows:
        path = r["f"].replace("file://", "")
        out.setdefault(r["SchoolYear"], set()).add((path, os.stat(path).st_mtime_ns))
    return out


def test_refresh_equals_a_full_rebuild_and_touches_changed_years_only(spark, published):
    name, path = published
    sources = views.sources(spark, SF_DIR)
    first = refresh_app_data(sources, CONFIG, name, path)
    assert first.kept == () and len(first.rebuilt) >= 5
    assert bag(spark.table(name)) == bag(build_app_data(sources, CONFIG))
    before, was = files_by_year(spark, name), bag(spark.table(name))

    assert refresh_app_data(sources, CONFIG, name, path).rebuilt == ()
    assert files_by_year(spark, name) == before

    fewer = {**sources, "isir": sources["isir"].where("ISIRYear <> 1998 OR ISIRID % 2 = 0")}
    done = refresh_app_data(fewer, CONFIG, name, path)
    assert done.rebuilt == (1998,)
    after = files_by_year(spark, name)
    assert {y for y in before if after[y] != before[y]} == {1998}
    assert bag(spark.table(name)) == bag(build_app_data(fewer, CONFIG)) != was
    replaced = {path for path, _ in before[1998]}
    assert all(map(os.path.exists, replaced))  # whoever is reading them can go on
    refresh_app_data(sources, CONFIG, name, path)
    assert bag(spark.table(name)) == was
    refresh_app_data(fewer, CONFIG, name, path)
    assert all(map(os.path.exists, replaced))  # other years still lie in that folder
    assert len([run for run in os.listdir(path.removeprefix("file://")) if run.startswith("run-")]) == 3


def test_refresh_follows_new_snapshots_years_and_names(spark, published):
    name, path = published
    sources = views.sources(spark, SF_DIR)
    newest = sources["enrollment"].agg(F.max("SchoolYear")).first()[0]
    states = [
        {**sources, "enrollment": sources["enrollment"].where(F.col("SchoolYear") < newest)},  # before the last year
        sources,  # the last year comes, and with it another roster
        earlier_sources(sources),  # snapshots and applications change, a school's name too
        {**sources, "enrollment": sources["enrollment"].where(F.col("SchoolYear") < newest)},  # the last year goes again
    ]
    seen = []
    for state in states:
        seen.append(refresh_app_data(state, CONFIG, name, path))
        assert bag(spark.table(name)) == bag(build_app_data(state, CONFIG))
    assert newest in seen[1].rebuilt and seen[3].dropped == (newest,)


def test_a_changed_name_rebuilds_the_years_that_have_the_school(spark, published):
    name, path = published
    sources = views.sources(spark, SF_DIR)
    newest = sources["enrollment"].agg(F.max("SchoolYear")).first()[0]
    cohort = build_app_data(sources, CONFIG).where("level = 'school'").select("SchoolYear", "SchoolCode").distinct().collect()
    per_school = {}
    for r in cohort:
        per_school.setdefault(r["SchoolCode"], set()).add(r["SchoolYear"])
    code = min((c for c, years in per_school.items() if newest in years), key=lambda c: len(per_school[c]))
    refresh_app_data(sources, CONFIG, name, path)
    renamed = F.when((F.col("SchoolCode") == code) & (F.col("SchoolYear") == newest), F.lit("New name")).otherwise(F.col("SchoolName"))
    changed = {**sources, "school": sources["school"].withColumn("SchoolName", renamed)}
    done = refresh_app_data(changed, CONFIG, name, path)
    assert set(done.rebuilt) >= per_school[code]
    assert bag(spark.table(name)) == bag(build_app_data(changed, CONFIG))


def test_settings_and_lost_state_rebuild_all_years(spark, published):
    name, path = published
    sources = views.sources(spark, SF_DIR)
    years = refresh_app_data(sources, CONFIG, name, path).rebuilt
    other = replace(CONFIG, excluded_schools=CONFIG.excluded_schools[:1])
    assert refresh_app_data(sources, other, name, path).rebuilt == years
    assert bag(spark.table(name)) == bag(build_app_data(sources, other))
    spark.sql(f"DROP TABLE {name}_roster")
    assert refresh_app_data(sources, other, name, path).rebuilt == years
    spark.sql(f"DROP TABLE {name}_state")
    assert refresh_app_data(sources, other, name, path).rebuilt == years
    assert bag(spark.table(name)) == bag(build_app_data(sources, other))


# -- choice index ------------------------------------------------------------------

def small_app(spark):
    rows = []
    for year in (1999, 2000, 2001, 2063, 2064, 2130):
        for d, s, g, r in (("N", "One", "F", "a"), ("N", "Two", None, "b"), ("S", "One", "M", None), (None, "X", "F", "NA"), ("S", None, "M", "c")):
            if (year + len(s or "")) % 3 or year > 2060:
                rows += [(year, "school", d, s, g, r), (year, "lea", d, "All Schools", g, r)]
        rows.append((year, "state", "All LEAs", "All Schools", "F", "a"))
    rows.append((None, "school", "N", "Never", "F", "a"))
    return spark.createDataFrame(rows, "SchoolYear int, level string, DistrictName string, SchoolName string, gender string, race string")


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("years", [(1999,), (1999, 2001), (2000, 2064), (2063, 2063), (2001, 2130), (1950, 1960)])
def test_index_answers_as_the_summary_does(spark, years, whole):
    app = small_app(spark)
    index = stage(choice_index.build_choice_index(app), "index")
    pairs = [
        (choices.district_choices(app, years, whole), choice_index.indexed_districts(index, years, whole)),
        (choices.resolve_selection(app, years, whole), choice_index.indexed_selection(index, years, whole)),
        (choices.resolve_selection(app, years, whole, subgroups=False), choice_index.indexed_selection(index, years, whole, ())),
    ]
    for district in ("N", "S", "none"):
        pairs.append((choices.school_choices(app, years, district, whole), choice_index.indexed_schools(index, years, district, whole)))
        for school in ("One", ["One", "Two"]):
            pairs.append((
                choices.subgroup_choices(app, years, district, school, whole),
                choice_index.indexed_subgroups(index, years, district, school, whole),
            ))
    for want, got in pairs:
        assert want.columns == got.columns and want.collect() == got.collect()


def test_index_reads_one_kind_and_not_the_summary(spark):
    app, path = stage(small_app(spark), "app"), stage_path(spark, "index")
    choice_index.write_choice_index(choice_index.build_choice_index(app), path)
    index = choice_index.load_choice_index(spark, path)
    plan = final_plan(choice_index.indexed_schools(index, (1999, 2001), "N"))
    assert "/app-" not in plan and "PushedFilters: [" in plan
    assert "(kind" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(DistrictName" in plan


def test_index_checks_its_arguments(spark):
    index = choice_index.build_choice_index(small_app(spark))
    with pytest.raises(ValueError):
        choice_index.in_years(())
    with pytest.raises(ValueError):
        choice_index.indexed_schools(index, (1999,), "")
    with pytest.raises(ValueError):
        choice_index.build_choice_index(small_app(spark), ("school",))
