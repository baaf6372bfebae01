"""Preparation and summaries on hand-made rows, checked against plain Python."""

import datetime as dt
import itertools
import random
from collections import defaultdict
from dataclasses import replace

import pytest

from cohortspan.config import MONTHS, CohortConfig
from cohortspan.operators import prep, quality, summary
from cohortspan.sources.schemas import EXTRACT_SCHEMA
from tests.conftest import SF_DIR, final_plan, records

CFG = CohortConfig()
NOSUB = replace(CFG, subgroups=())
SCHEMA = ", ".join(f"{k} {v}" for k, v in EXTRACT_SCHEMA.items())


def extract_rows(spark, *rows):
    default = {name: None for name in EXTRACT_SCHEMA} | {
        "SchoolYear": 2020, "StudentID": 1, "SchoolName": "One", "SchoolCode": "S1",
        "DistrictName": "North", "DistrictCode": "D1", "Gender": "F", "RaceReportTitle": "White",
        "Grade": "12", "CompletedFAFSA": "N",
    }
    return spark.createDataFrame([tuple((default | r).values()) for r in rows], SCHEMA)


def received(month, year=2020):
    return {"ApplicationReceiptDate": dt.date(year, month, 3), "CompletedFAFSA": "Y"}


def test_history_is_kept_under_current_names_only(spark):
    rows = extract_rows(
        spark, {}, {"SchoolYear": 2019, "StudentID": 2, "SchoolName": "Former name"},
        {"SchoolYear": 2019, "StudentID": 3, "SchoolCode": "S9"},  # closed
        {"SchoolYear": 2019, "StudentID": 4, "DistrictCode": "D9"},  # moved district since
        {"SchoolYear": 2014, "StudentID": 5}, {"SchoolYear": None, "StudentID": 6},
        {"StudentID": 7, "SchoolCode": None, "SchoolName": "No code"},
    )
    kept = prep.restrict_relabel(rows, prep.school_roster(rows))
    assert sorted((r["StudentID"], r["SchoolName"]) for r in records(kept)) == [
        (1, "One"), (2, "One"), (5, "One"), (6, "One"), (7, "No code"),
    ]
    assert sorted(r["StudentID"] for r in records(prep.prepare(rows, CFG))) == [1, 2, 7]


def test_recodes_and_receipt_months(spark):
    rows = extract_rows(
        spark,
        *[{"StudentID": m, **received(m)} for m in range(1, 13)],
        {"StudentID": 13, "Gender": "X", "RaceReportTitle": "Hawaiian", "CompletedFAFSA": None},
        {"StudentID": 14, "Gender": None, "RaceReportTitle": None},
    )
    got = {r["StudentID"]: r for r in records(prep.prepare(rows, CFG))}
    for month in range(1, 13):
        row = got[month]
        assert row["ApplicationReceiptMonth"] == dt.date(2020, month, 1).strftime("%B")
        assert row["month_idx"] == MONTHS.index(row["ApplicationReceiptMonth"]) + 1
        assert (row["gender"], row["race"], row["completedFAFSA"]) == ("Female", "White", "Complete")
    assert (got[13]["gender"], got[13]["race"], got[13]["completedFAFSA"]) == (None, "NH & PI", None)
    assert (got[14]["gender"], got[14]["race"]) == (None, None)
    assert got[13]["ApplicationReceiptMonth"] == "No Receipt" and got[13]["month_idx"] == 13


def random_rows(spark, count=600):
    rng = random.Random(7)
    pick = lambda *values: rng.choice(values)
    rows = []
    for _ in range(count):
        school, district = pick(("S1", "D1"), ("S2", "D1"), ("S3", "D2"), ("S3", "D1"))
        rows.append({
            "SchoolYear": pick(2018, 2019, 2020), "StudentID": pick(None, None, *range(60)),
            "SchoolCode": school, "SchoolName": f"School {school}", "DistrictCode": district,
            "DistrictName": f"District {district}", "Gender": pick("F", "M", None),
            "RaceReportTitle": pick("White", "Hawaiian", None),
            "Grade": pick("12", "12", "11"),
            **pick({}, {"CompletedFAFSA": None}, received(10), received(3), received(8)),
        })
    return extract_rows(spark, *rows)


def brute_force(prepared, cfg):
    """Distinct students per cell and family, a missing student counting as one."""
    scope = {"school": ["DistrictCode", "DistrictName", "SchoolCode", "SchoolName"],
             "lea": ["DistrictCode", "DistrictName"], "state": []}
    expected = {}
    for level, columns in scope.items():
        cells, families = defaultdict(set), defaultdict(set)
        for row in prepared:
            family = (row["SchoolYear"], *[row[c] for c in columns], row["Grade"],
                      *[row[c] for c in cfg.subgroups])
            families[family].add(row["StudentID"])
            cells[family, row["ApplicationReceiptMonth"], row["completedFAFSA"]].add(row["StudentID"])
        for (family, month, status), students in cells.items():
            expected[level, *family, month, status] = (len(students), len(families[family]))
    return expected


@pytest.mark.parametrize("cfg", [CFG, NOSUB], ids=["subgroups", "no-subgroups"])
def test_summary_equals_brute_force(spark, cfg):
    prepared = prep.prepare(random_rows(spark), cfg)
    app = records(summary.summarise_levels(prepared, cfg))
    got = {}
    for row in app:
        scope = [row[c] for c in summary.SCOPE[row["level"]]]
        key = (row["level"], row["SchoolYear"], *scope, row["Grade"],
               *[row[c] for c in cfg.subgroups], row["ApplicationReceiptMonth"], row["completedFAFSA"])
        got[key] = (row["n"], row["seniors"])
        unused = [row[c] for c in summary.ALL_SCOPE_COLUMNS if c not in summary.SCOPE[row["level"]]]
        assert set(unused) <= {"All LEAs", "All Schools"}
    assert len(got) == len(app)
    assert got == brute_force(records(prepared), cfg)
    for level in summary.SCOPE:
        one = records(summary.summarise(prepared, level, cfg))
        assert sorted(map(str, one)) == sorted(str(r) for r in app if r["level"] == level)
        families = {tuple(r[k] for k in summary.family_keys(level, cfg)): r["seniors"] for r in one}
        denominators = records(summary.denominators(prepared, level, cfg))
        assert families == {
            tuple(r[k] for k in summary.family_keys(level, cfg)): r["seniors"] for r in denominators
        }


def test_levels_are_counted_anew(spark):
    """One student at two schools counts once in the district."""
    rows = extract_rows(spark, received(10), {"SchoolCode": "S2", "SchoolName": "Two", **received(10)})
    app = records(summary.summarise_levels(prep.prepare(rows, CFG), CFG))
    assert sorted((r["level"], r["n"]) for r in app) == [("lea", 1), ("school", 1), ("school", 1), ("state", 1)]


def test_coverage_reports_students_in_several_cells(spark):
    rows = extract_rows(spark, received(10), {"SchoolCode": "S2", "SchoolName": "Two", **received(3)})
    report = records(quality.coverage(summary.summarise_levels(prep.prepare(rows, CFG), CFG), CFG))
    assert {(r["level"], r["total_n"], r["seniors"], r["diff"]) for r in report} == {
        ("school", 1, 1, 0), ("lea", 2, 1, 1), ("state", 2, 1, 1),
    }


def test_quality_reports(spark):
    rows = extract_rows(
        spark, {}, {}, {"StudentID": None}, {"StudentID": None},
        {"StudentID": 2}, {"StudentID": 2, "SchoolCode": "S2"}, {"StudentID": 2, "DistrictCode": "D2"},
    )
    assert {r["StudentID"]: r["n"] for r in records(quality.duplicate_keys(rows))} == {1: 2, None: 2}
    assert {r["StudentID"]: r["n"] for r in records(quality.multi_enrolled(rows))} == {2: 3}


def test_sort_orders(spark):
    app = summary.summarise_levels(prep.prepare(random_rows(spark, 100), CFG), CFG)
    levels = lambda df: [k for k, _ in itertools.groupby(r["level"] for r in df.collect())]
    assert levels(summary.sort_app_data(app, CFG)) == ["lea", "school", "state"]
    assert levels(summary.sort_app_data(app, CFG, ("school", "lea", "state"))) == ["school", "lea", "state"]
    genders = [r["gender"] for r in summary.sort_app_data(app.filter("level = 'state' AND SchoolYear = 2020"), CFG).collect()]
    assert genders == sorted(genders, key=lambda g: (g is None, g))


def test_any_number_of_statuses(spark):
    wide = CohortConfig(status_labels={"Y": "a", "N": "b", "P": "c", "Q": "d", "R": "e"})
    rows = extract_rows(spark, *[{"StudentID": k, "CompletedFAFSA": s} for k, s in enumerate(["Y", "N", "P", "Q", "R", "?"])])
    app = records(summary.summarise(prep.prepare(rows, wide), "state", wide))
    assert {r["completedFAFSA"]: (r["n"], r["seniors"]) for r in app} == {
        s: (1, 6) for s in ("a", "b", "c", "d", "e", None)
    }


def test_students_are_shuffled_twice_and_families_once(spark):
    """By student and school family, then by student; after that counts move, once, unsorted by any window."""
    from fixtures import queries

    plan = final_plan(queries.app_data(spark, SF_DIR))
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "Reused" not in line]
    of_students = [line for line in exchanges if "StudentID" in line]
    assert len([e for e in of_students if "REPARTITION_BY_COL" in e]) == len({e.split("plan_id=")[1] for e in of_students if "REPARTITION_BY_COL" in e}) >= 1
    assert len({e.split("hashpartitioning(")[1].split(", ENSURE")[0] for e in of_students if "ENSURE" in e}) <= 1
    assert len([line for line in exchanges if "StudentID" not in line and "level#" in line]) == 1
    assert "Window" not in plan and "Generate explode" not in plan
