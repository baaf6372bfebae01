import pytest

from cohortspan.operators import choices
from tests.conftest import records
from tests.test_trend import app_rows, cell


@pytest.fixture
def app(spark):
    zed, abe = ("D2", "Abe District", "S2", "Zed"), ("D1", "North", "S1", "Abe")
    lea = lambda name: ("D", name, "All Schools", "All Schools")
    return app_rows(
        spark,
        cell("school", 1, 1, 1, scope=zed, gender=None, race="NA"), cell("school", 1, 1, 1, scope=zed, race="White"),
        cell("school", 1, 1, 1, scope=abe, gender="Female", race="Black", year=2022),
        cell("school", 1, 1, 1, scope=abe, gender="Male", race=None, year=2021),
        cell("lea", 1, 1, 1, scope=lea("Abe District")), cell("lea", 1, 1, 1, scope=lea("North"), year=2022),
        cell("lea", 1, 1, 1, scope=lea("North"), year=2021), cell("state", 1, 1, 1),
    )


def values(df):
    return [r[0] for r in df.collect()]


def test_lists(app):
    assert values(choices.year_choices(app)) == [2020, 2021, 2022]
    assert values(choices.all_districts(app)) == ["Abe District", "North"]
    assert values(choices.all_schools(app)) == ["Abe", "Zed"]
    assert values(choices.gender_choices(app)) == ["Female", "Male"]
    assert values(choices.race_choices(app)) == ["Black", "White"]


def test_default_lists_are_independent(app):
    assert records(choices.default_selection(app)) == [
        {"year": 2022, "district": "Abe District", "school": "Abe", "gender": "Female", "race": "Black"}
    ]
    assert list(records(choices.default_selection(app, subgroups=False))[0]) == ["year", "district", "school"]


def test_year_end_points_or_whole_range(app):
    assert values(choices.district_choices(app, (2020, 2020))) == ["Abe District"]
    assert values(choices.school_choices(app, (2020, 2022), "North")) == ["Abe"]
    middle = app.filter("SchoolYear = 2021")
    assert values(choices.district_choices(middle, (2020, 2022))) == []
    assert values(choices.district_choices(middle, (2020, 2022), whole_range=True)) == ["North"]


def test_subgroups_of_a_school(app):
    got = [tuple(r) for r in choices.subgroup_choices(app, (2021, 2022), "North", "Abe").collect()]
    assert got == [("gender", "Female"), ("gender", "Male"), ("race", "Black")]


def test_resolved_selection_is_consistent(app):
    assert records(choices.resolve_selection(app, (2020, 2022))) == [{
        "first_year": 2020, "last_year": 2022, "district": "Abe District", "school": "Zed",
        "gender": "Female", "race": "NA",
    }]
    assert records(choices.resolve_selection(app, (1990,))) == []
    assert "race" not in records(choices.resolve_selection(app, (2020,), subgroups=False))[0]


def test_inputs_are_required(app):
    with pytest.raises(ValueError):
        choices.district_choices(app, ())
    with pytest.raises(ValueError):
        choices.school_choices(app, (2020,), "")
    with pytest.raises(ValueError):
        choices.subgroup_choices(app, (2020,), "North", "")
