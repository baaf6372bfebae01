"""Bringing the published summary table up to date, year by year.

The summary table is a table of the catalog, partitioned by level and school year. A
refresh finds the years whose sources have changed, rebuilds these alone into a folder
of its own, and then points their partitions at it. Files of other years are neither read nor
written. Overwriting partitions in place would delete files before the new ones are there;
moving a partition's location does not, so a reader finds either the old or the new
files of a partition, and both lie there until the refresh after the next.

What a year's summary depends on is kept beside the table as ``<name>_state``: the latest
snapshot's date, checksums of the year's applications and codes, of the codes that have no
year, and of the settings. A snapshot is taken as final: rows changed under an old date are not noticed. The
roster of current schools (``<name>_roster``) works on all years, so years that hold a school
whose entry has changed are rebuilt as well.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.config import CohortConfig
from cohortspan.operators.extract import APPLICANT, build_extract, cohort_filter, latest_snapshot, snapshot_rows
from cohortspan.operators.gates import Gates, QualityBreach
from cohortspan.operators.prep import ROSTER, prepare, school_roster, summary_columns
from cohortspan.operators.summary import summarise_levels
from cohortspan.sources.app_data import PARTITIONS
from cohortspan.staging import remove, stage, staged_tables

YEAR_COLUMNS = {"enrollment": "SchoolYear", "school": "SchoolYear", "district": "SchoolYear", "isir": "ISIRYear"}


@dataclass(frozen=True)
class Refresh:
    """Which school years a refresh rebuilt, left alone and dropped."""

    rebuilt: tuple[int, ...]
    kept: tuple[int, ...]
    dropped: tuple[int, ...]


def _checksum(columns: Iterable[str]) -> Column:
    """Number of rows and sum of their hashes: changes with any row, not with their order."""
    names = list(columns)
    rows = F.xxhash64(*names, *[F.col(name).isNull() for name in names]).cast("decimal(20,0)")
    return F.concat_ws("/", F.count(F.lit(1)), F.sum(rows))


def year_states(sources: Mapping[str, DataFrame], cfg: CohortConfig, snapshots: DataFrame) -> DataFrame:
    """``SchoolYear, state``: what each year's summary follows from, a row per year that has a snapshot.

    Enrolment is not read. Applications are read once, in five columns, and combined before the shuffle.
    """
    settings = hashlib.sha256(repr(cfg).encode()).hexdigest()
    everywhere = [sources[name].agg(_checksum(sources[name].columns)).first()[0] for name in ("race_code", "sped_code")]
    received = sources["isir"].filter(F.col("ApplicationReceiptDate").isNotNull()).withColumn("SchoolYear", F.col("ISIRYear").cast("int"))
    yearly = {
        "applications": received.groupBy("SchoolYear").agg(_checksum((*APPLICANT, "ApplicationReceiptDate")).alias("applications")),
        "schools": sources["school"].groupBy("SchoolYear").agg(_checksum(("SchoolCode", "SchoolName")).alias("schools")),
        "districts": sources["district"].groupBy("SchoolYear").agg(_checksum(("DistrictCode", "DistrictName")).alias("districts")),
    }
    states = snapshots.filter(F.col("SchoolYear").isNotNull()).withColumn("SchoolYear", F.col("SchoolYear").cast("int"))
    for frame in yearly.values():
        states = states.join(frame, "SchoolYear", "left")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("maxasof", *yearly)]
    return states.select("SchoolYear", F.concat_ws("|", *parts, *map(F.lit, (*everywhere, settings))).alias("state"))


def refresh_app_data(
    sources: Mapping[str, DataFrame], cfg: CohortConfig, name: str, path: str,
    as_of: dt.date | None = None, snapshots: DataFrame | None = None, gates: Gates | None = None,
) -> Refresh:
    """Bring the summary table ``name``, whose files lie below ``path``, up to date with ``sources``.

    The table is created if it does not exist. Its rows equal those of ``build_app_data``. What comes to the driver is
    a row per school year. A refresh that ends early leaves a table of old and new years that are
    each whole, and is made good by the next one. ``gates`` measures the years that are rebuilt; if a measure is
    above its limit, ``QualityBreach`` is raised and the table stays as it was.
    """
    spark = sources["enrollment"].sparkSession
    path = path.rstrip("/")
    with staged_tables(spark):
        if snapshots is None:
            snapshots = stage(latest_snapshot(sources["enrollment"]), "latest_snapshot")
        now = {r["SchoolYear"]: r["state"] for r in year_states(sources, cfg, snapshots).collect()}
        before = _known(spark, name)
        old = {year: state for year, (state, _) in before.items()}
        has_roster = spark.catalog.tableExists(f"{name}_roster")
        changed = {year for year in now if now[year] != old.get(year) or not has_roster}
        newest = max(now, default=None)

        def extract(years: set[int]) -> DataFrame:
            rows = build_extract(_of_years(sources, years), cfg, as_of=as_of, snapshots=_in(snapshots, "SchoolYear", years))
            return stage(rows.select(*summary_columns(cfg)), "extract")

        roster, latest = None, None
        if newest not in changed and has_roster:
            roster = spark.table(f"{name}_roster")
        elif newest is not None:
            latest = extract({newest})
            if latest.isEmpty():  # an older year is the latest one with students
                changed, latest = set(now), None
            else:
                roster = stage(school_roster(latest), "roster")
                changed |= {newest} | _years_under(sources, cfg, snapshots, _roster_changes(spark, name, roster))
        rebuilt, dropped = sorted(changed), sorted(set(old) - set(now))

        run = f"{path}/run-{uuid.uuid4().hex}"
        if rebuilt:
            others = changed - {newest} if latest is not None else changed
            rows = [latest] * (latest is not None) + [extract(others)] * bool(others)
            rows = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
            if roster is None:
                roster = stage(school_roster(rows), "roster")
            summary = summarise_levels(prepare(rows, cfg, roster), cfg, gates)
            summary.hint("rebalance", *PARTITIONS).write.partitionBy(*PARTITIONS).parquet(run)
            if gates is not None:
                _pass_or_remove(spark, gates, run)
            _point_partitions(spark, name, path, run, {*rebuilt, *dropped}, summary)
            if latest is not None or not has_roster:
                roster.write.mode("overwrite").saveAsTable(f"{name}_roster")
        elif dropped:
            _drop_partitions(spark, name, _partitions(spark, name, set(dropped)))
        if rebuilt or dropped or not before:
            after = {year: (now[year], run if year in changed else before[year][1]) for year in now}
            rows = spark.createDataFrame([(y, *v) for y, v in after.items()], "SchoolYear int, state string, run string")
            rows.write.mode("overwrite").saveAsTable(f"{name}_state")
            _remove_runs(spark, path, {r for _, r in (*before.values(), *after.values())})
    return Refresh(tuple(rebuilt), tuple(sorted(set(now) - changed)), tuple(dropped))


def drop_app_data(spark: SparkSession, name: str, path: str) -> None:
    """Remove the table, what is known of it, and its files."""
    for table in (name, f"{name}_state", f"{name}_roster"):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    remove(spark, [path])


def _in(df: DataFrame, column: str, years: set[int]) -> DataFrame:
    return df.filter(F.col(column).isin(*sorted(years)))


def _of_years(sources: Mapping[str, DataFrame], years: set[int]) -> dict[str, DataFrame]:
    """The sources of these years; enrolment and applications skip the partitions of others."""
    return {name: _in(df, YEAR_COLUMNS[name], years) if name in YEAR_COLUMNS else df for name, df in sources.items()}


def _known(spark: SparkSession, name: str) -> dict[int, tuple[str, str]]:
    """State and folder of each year as of the last refresh."""
    if not (spark.catalog.tableExists(name) and spark.catalog.tableExists(f"{name}_state")):
        return {}
    return {r["SchoolYear"]: (r["state"], r["run"]) for r in spark.table(f"{name}_state").collect()}


def _roster_changes(spark: SparkSession, name: str, roster: DataFrame) -> DataFrame | None:
    """Codes of schools whose entry on the roster has come, gone or changed its names."""
    if not spark.catalog.tableExists(f"{name}_roster"):
        return None
    old, new = spark.table(f"{name}_roster").select(*ROSTER), roster.select(*ROSTER)
    changes = new.exceptAll(old).unionByName(old.exceptAll(new))
    return stage(changes.select("DistrictCode", "SchoolCode").distinct(), "roster_changes")


def _years_under(
    sources: Mapping[str, DataFrame], cfg: CohortConfig, snapshots: DataFrame, schools: DataFrame | None
) -> set[int]:
    """Years whose latest snapshot holds one of these schools; reads columns of codes, and only if there are any."""
    if schools is None or schools.isEmpty():
        return set()
    rows = snapshot_rows(cohort_filter(sources["enrollment"], cfg), snapshots).select(
        F.col("SchoolYear").cast("int").alias("SchoolYear"),
        *[F.col(c).cast("string").alias(f"my_{c}") for c in ("DistrictCode", "SchoolCode")],
    )
    same = [F.col(f"my_{c}").eqNullSafe(F.col(c)) for c in ("DistrictCode", "SchoolCode")]
    return {r[0] for r in rows.join(schools, same, "left_semi").select("SchoolYear").distinct().collect()}


def _partitions(spark: SparkSession, name: str, years: set[int]) -> list[tuple[str, int]]:
    """Level and year of the table's partitions of these years."""
    found = [dict(p.split("=", 1) for p in r[0].split("/")) for r in spark.sql(f"SHOW PARTITIONS {name}").collect()]
    return [(p["level"], int(p["SchoolYear"])) for p in found if int(p["SchoolYear"]) in years]


def _drop_partitions(spark: SparkSession, name: str, partitions: Iterable[tuple[str, int]]) -> None:
    for level, year in partitions:
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (level = '{level}', SchoolYear = {year})")


def _point_partitions(spark: SparkSession, name: str, path: str, run: str, years: set[int], summary: DataFrame) -> None:
    """Let the table's partitions of ``years`` be those that lie in the folder ``run``."""
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in summary.schema)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY ({', '.join(PARTITIONS)}) LOCATION '{path}/table'")
    written = {
        (r["level"], r["SchoolYear"])
        for r in spark.read.schema(summary.schema).parquet(run).select(*PARTITIONS).distinct().collect()
    }
    there = set(_partitions(spark, name, years))
    for level, year in sorted(written):
        partition = f"PARTITION (level = '{level}', SchoolYear = {year})"
        folder = f"'{run}/level={level}/SchoolYear={year}'"
        if (level, year) in there:
            spark.sql(f"ALTER TABLE {name} {partition} SET LOCATION {folder}")
        else:
            spark.sql(f"ALTER TABLE {name} ADD {partition} LOCATION {folder}")
    _drop_partitions(spark, name, there - written)
    spark.catalog.refreshTable(name)


def _pass_or_remove(spark: SparkSession, gates: Gates, run: str) -> None:
    try:
        gates.check()
    except QualityBreach:
        remove(spark, [run])
        raise


def _remove_runs(spark: SparkSession, path: str, used: set[str]) -> None:
    """Delete folders of refreshes that neither this state of the table nor the one before refers to."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(folder):
        names = {run.rpartition("/")[2] for run in used}
        runs = [str(entry.getPath().getName()) for entry in files.listStatus(folder)]
        remove(spark, [f"{path}/{run}" for run in runs if run.startswith("run-") and run not in names])
