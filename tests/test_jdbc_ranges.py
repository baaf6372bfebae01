"""Ranges of a key: every row in exactly one, about equal numbers of rows in each.

No database is started: Spark's own SQL answers the questions and evaluates the predicates.
"""

import datetime as dt
import random
from decimal import Decimal

import pytest

from cohortspan.sources import jdbc, tables


def rows_by_predicate(spark, frame, predicates):
    frame.createOrReplaceTempView("keys")
    hits = " + ".join(f"CAST(coalesce({p}, false) AS INT)" for p in predicates)
    assert spark.sql(f"SELECT min({hits}), max({hits}) FROM keys").first() == (1, 1)  # none lost, none doubled
    return [spark.sql(f"SELECT count(*) FROM keys WHERE {p}").first()[0] for p in predicates]


def probe(spark, frame, parts):
    frame.createOrReplaceTempView("keys")
    return jdbc.probe_cuts(lambda sql: [tuple(r) for r in spark.sql(sql).collect()], "keys", "k", parts)


@pytest.mark.parametrize("kind", ["long", "date", "double", "timestamp", "decimal(12,2)"])
def test_every_row_is_in_one_range(spark, kind):
    pick = random.Random(3)
    numbers = [pick.randrange(-400, 400) for _ in range(900)] + [None] * 60
    make = {
        "long": lambda n: n, "double": lambda n: n / 3, "date": lambda n: dt.date(2001, 1, 1) + dt.timedelta(n),
        "timestamp": lambda n: dt.datetime(2001, 1, 1) + dt.timedelta(minutes=n), "decimal(12,2)": lambda n: Decimal(n) / 4,
    }[kind]
    frame = spark.createDataFrame([(None if n is None else make(n),) for n in numbers], f"k {kind}")
    cuts = probe(spark, frame, 6) if kind in ("long", "date", "double") else sorted({make(n) for n in numbers[:5]})
    counts = rows_by_predicate(spark, frame, jdbc.range_predicates("k", cuts))
    assert sum(counts) == len(numbers) and len(counts) >= 4


def test_ranges_hold_even_shares_of_uneven_keys(spark):
    frame = spark.sql("""
        SELECT id AS k FROM range(1000) UNION ALL SELECT 5000 + id % 40 FROM range(6000)
        UNION ALL SELECT 1000000 + id FROM range(100) UNION ALL SELECT CAST(NULL AS BIGINT) FROM range(50)""")
    counts = rows_by_predicate(spark, frame, jdbc.range_predicates("k", probe(spark, frame, 4)))
    assert sum(counts) == 7150
    even = spark.sql("SELECT id * id AS k FROM range(10000)")
    counts = rows_by_predicate(spark, even, jdbc.range_predicates("k", probe(spark, even, 8)))
    assert len(counts) >= 6 and max(counts) <= 2 * 10000 / 8


def test_rows_outside_the_probed_bounds_are_read_too(spark):
    then = spark.sql("SELECT id AS k FROM range(100, 200)")
    predicates = jdbc.range_predicates("k", probe(spark, then, 5))
    now = spark.sql("SELECT id AS k FROM range(-50, 400) UNION ALL SELECT NULL")
    assert sum(rows_by_predicate(spark, now, predicates)) == 451


@pytest.mark.parametrize("query", [
    "SELECT CAST(NULL AS BIGINT) AS k FROM range(9)", "SELECT id AS k FROM range(0)", "SELECT 7 AS k FROM range(9)",
])
def test_nothing_to_cut(spark, query):
    frame = spark.sql(query)
    assert probe(spark, frame, 4) == [] and jdbc.range_predicates("k", []) == ["1 = 1"]


def test_partitions_follow_the_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(jdbc, "ROWS_PER_PARTITION", 100)
    assert len(probe(spark, spark.sql("SELECT id AS k FROM range(1000)"), None)) + 1 == 10
    monkeypatch.setattr(jdbc, "MOST_PARTITIONS", 3)
    assert len(probe(spark, spark.sql("SELECT id AS k FROM range(1000)"), None)) + 1 == 3


def test_keys_that_cannot_be_cut_are_refused():
    for value in ("text", True, b"x"):
        with pytest.raises(ValueError):
            jdbc.literal(value)


def test_a_key_makes_a_jdbc_source_parallel(spark, monkeypatch):
    asked = []

    class Reader:
        def jdbc(self, url, table, predicates, properties):
            return url, table, predicates, properties

        def format(self, name):
            assert name == "jdbc"
            return self

        def options(self, **options):
            asked.append(options["query"])
            assert options["user"] == "me" and "dbtable" not in options
            return self

        def load(self):
            return spark.sql(asked[-1].replace("enrolment t", "keys t"))

    class Session:
        read = Reader()

    spark.sql("SELECT id AS k FROM range(1000)").createOrReplaceTempView("keys")
    spec = {"format": "jdbc", "key": "k", "partitions": 4, "options": {"url": "jdbc:x", "dbtable": "enrolment", "user": "me"}}
    url, table, predicates, properties = tables.read_source(Session(), spec)
    assert (url, table, properties) == ("jdbc:x", "enrolment", {"user": "me"})
    assert len(predicates) == 4 and len(asked) == 2
