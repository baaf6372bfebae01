import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cohortspan.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", app_name="tests")
    yield session
    session.stop()


@pytest.fixture
def settings(spark):
    """Change session settings for one test: ``settings(**{"spark.sql...": value})``."""
    saved = {}

    def change(**values):
        for key, value in values.items():
            saved.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield change
    for key, value in saved.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df) -> str:
    """Physical plan after execution, i.e. with adaptive changes applied."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]


def records(df) -> list[dict]:
    return [row.asDict() for row in df.collect()]
