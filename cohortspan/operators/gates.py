"""Quality measures taken while a job runs, and limits that stop its result from being published.

The measures ride along with the summary job as observed metrics: the rows that are counted anyway pass by
them, so nothing is scanned, shuffled or counted a second time. A task that runs twice because an executor was
lost may add its part twice; measures can only come out too high by that, and 0 is 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

STUDENT = ("SchoolYear", "StudentID")
PLACE = ("DistrictCode", "SchoolCode")
MEASURES = ("duplicate_keys", "multi_enrolled", "students", "families", "families_over", "families_short", "largest_excess")
LIMITED = ("duplicate_keys", "multi_enrolled", "families_over", "families_short")


class QualityBreach(Exception):
    """A measure is above its limit; ``report`` has all of them."""

    def __init__(self, breaches: dict[str, str], report: dict[str, int]) -> None:
        super().__init__("; ".join(breaches.values()))
        self.report = report


@dataclass
class Gates:
    """Limits for one run, None for no limit. The measures are there once the summary has been written.

    duplicate_keys: keys of year, district, school and student that several rows of the extract share.
    multi_enrolled: students in more than one district or school within a year.
    families_over: cell families whose cells add up to more than their students, as a student is in several.
    families_short: cell families whose cells add up to less, which no data can bring about.
    """

    duplicate_keys: int | None = 0
    multi_enrolled: int | None = None
    families_over: int | None = None
    families_short: int | None = 0
    _students: Observation = field(default_factory=Observation, repr=False)
    _families: Observation = field(default_factory=Observation, repr=False)

    def watch_students(self, rows: DataFrame, repeated: Column) -> DataFrame:
        """Measure ``rows``, which lie together by year and student.

        ``repeated`` says that several rows of the extract are behind one of them. Windows over what
        lies together need no shuffle.
        """
        student, place = Window.partitionBy(*STUDENT), Window.partitionBy(*STUDENT, *PLACE)
        several = (F.count(F.lit(1)).over(place) > 1) | F.max(repeated).over(place)
        first = F.row_number().over(place.orderBy(F.lit(1))) == 1
        placed = rows.withColumn("__same", several).withColumn("__place", first.cast("int"))
        counted = placed.withColumn("__places", F.sum("__place").over(student))
        marked = counted.withColumn("__student", F.row_number().over(student.orderBy(F.desc("__place"))) == 1)
        measured = marked.observe(
            self._students,
            _times((F.col("__place") == 1) & F.col("__same")).alias("duplicate_keys"),
            _times(F.col("__student") & (F.col("__places") > 1)).alias("multi_enrolled"),
            _times(F.col("__student")).alias("students"),
        )
        return measured.drop("__same", "__place", "__places", "__student")

    def watch_families(self, families: DataFrame, total: Column) -> DataFrame:
        """Measure ``families``, one row each with its ``seniors``; ``total`` adds up its cells."""
        excess = total - F.col("seniors")
        return families.observe(
            self._families,
            F.count(F.lit(1)).alias("families"),
            _times(excess > 0).alias("families_over"),
            _times(excess < 0).alias("families_short"),
            F.coalesce(F.max(excess), F.lit(0)).alias("largest_excess"),
        )

    def report(self) -> dict[str, int]:
        """All measures; waits for the job that takes them."""
        taken = {**_taken(self._students), **_taken(self._families)}
        return {name: taken.get(name, 0) for name in MEASURES}

    def check(self) -> dict[str, int]:
        """The report, if no measure is above its limit."""
        report = self.report()
        limits = {name: getattr(self, name) for name in LIMITED}
        breaches = {
            name: f"{name}: {report[name]}, at most {limit} allowed"
            for name, limit in limits.items() if limit is not None and report[name] > limit
        }
        if breaches:
            raise QualityBreach(breaches, report)
        return report


def _taken(observation: Observation) -> dict[str, int]:
    """The metrics of a job that has run; none if it had no rows, as Spark then drops what would observe them."""
    try:
        return dict(observation.get)
    except Py4JJavaError as error:
        if "assertion failed" not in str(error):
            raise
        return {}


def _times(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0))
