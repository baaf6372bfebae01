"""Staged tables: a frame written once to shared storage and read back.

A frame is staged for one of two reasons: several consumers read it, or it is
the small side of a join and its size has to be known before the join is
planned. A staged table is plain parquet, so Spark knows its exact size: at or
under ``spark.sql.autoBroadcastJoinThreshold`` the planner broadcasts it,
above it the join is shuffled. That is why no join in this package carries a
broadcast hint. Readers get column pruning and filter pushdown, and a lost
executor costs at most the re-run of a scan.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_open_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names.

    A local-mode session without the setting gets one for its lifetime; on a
    cluster a missing setting is an error, as a machine-local folder would be
    out of reach for the other machines.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="run-")
    return _local_dirs[context.applicationId]


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one staged table of this application."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    for paths in _open_scopes:
        paths.append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared storage and return the table read back."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_all(frames: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Stage several frames in jobs that run side by side; a frame of known small size is left as it is."""
    todo = {name: df for name, df in frames.items() if not known_small(df)}
    with ThreadPoolExecutor(max(1, len(todo))) as pool:
        done = {name: pool.submit(stage, df, name) for name, df in todo.items()}
        return {name: done[name].result() if name in done else df for name, df in frames.items()}


def known_small(df: DataFrame) -> bool:
    """Whether Spark will broadcast ``df`` in a join as it is, and is right to.

    That is so for literal rows, and for files of small size from which columns and rows are just picked. What
    multiplies or combines rows is of unknown size until it has been staged.
    """
    limit = _bytes(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    plan = df._jdf.queryExecution().optimizedPlan()
    nodes = {line.lstrip(" :+-").split(" ", 1)[0] for line in plan.toString().splitlines() if line.strip()}
    if not nodes <= {"Project", "Filter", "LocalRelation", "Relation"}:
        return False
    return int(str(plan.stats().sizeInBytes())) <= limit


def _bytes(setting: str) -> int:
    """A size as Spark's settings give it: ``10485760b``, ``10MB``, ``-1``."""
    digits = setting.strip().lower().rstrip("bkmgti")
    unit = setting.strip().lower()[len(digits):][:1]
    return int(digits) * {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}[unit]


@contextmanager
def staged_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Remove at the end what is staged inside.

    Results have to be written or collected before, or staged with the function
    that is given: its tables outlive this scope, though not one around it.
    """
    paths: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        table_path = stage_path(spark, name)
        paths.remove(table_path)
        df.write.parquet(table_path)
        return spark.read.schema(df.schema).parquet(table_path)

    _open_scopes.append(paths)
    try:
        yield kept
    finally:
        _open_scopes.remove(paths)
        remove(spark, paths)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables wherever the shared folder lies."""
    jvm = spark.sparkContext._jvm
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(hadoop).delete(folder, True)
