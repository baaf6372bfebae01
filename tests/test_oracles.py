"""Every registered query against DuckDB, and what its plan must not contain."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracles import compare, connect
from fixtures.oracle import ORACLES as SQL
from fixtures.queries import QUERIES
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql_and_is_registered():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(queries())
    assert set(SQL) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    assert compare(df, duck, SQL[name], ordered=name.endswith("_sorted")) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInPandas"):
        assert unwanted not in plan


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "qa_duplicate_keys"])
def test_oracle_result_is_not_empty(duck, name):
    """A comparison of nothing with nothing proves nothing; duplicate keys must not exist."""
    assert duck.execute(f"SELECT count(*) FROM ({SQL[name]})").fetchone()[0] > 0


def test_selections_tell_things_apart(duck):
    rows = lambda name: duck.execute(SQL[name]).fetchall()
    assert rows("school_choices") != rows("school_choices_range")
    assert {r[0] for r in rows("subgroup_choices")} == {"gender", "race"}
    assert len(rows("monthly_trend")) == 27 and len(rows("scope_note_year")) == 1


def test_entry_returns_lines(spark):
    assert entry(spark).count() > 0
