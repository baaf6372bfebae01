"""Export of the detail table."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.config import EXPORT_PREFIX
from cohortspan.staging import remove, stage_path

COPY_BYTES = 1 << 20


def export_csv(
    df: DataFrame, directory: str, run_date: dt.date | None = None, single_file: bool = False
) -> str:
    """Write ``df`` as CSV with a header, NULL as ``NA``, and return the path.

    The result is a folder of part files; with ``single_file`` it holds one, as ``export_file`` makes it.
    """
    path = _path(directory, run_date)
    if single_file:
        remove(df.sparkSession, [path])
        _write_joined(df, f"{path}/part-00000.csv")
    else:
        _csv(df, header=True).csv(path, mode="overwrite")
    return path


def export_file(df: DataFrame, directory: str, run_date: dt.date | None = None) -> str:
    """Write ``df`` as one CSV file with a header, NULL as ``NA``, and return its path.

    All tasks write their parts, which are then joined in the order of the rows, so no task sees more than its own
    part. The file takes its name only when it is whole; one of that name that was there before is replaced.
    """
    path = _path(directory, run_date)
    _write_joined(df, path)
    return path


def _path(directory: str, run_date: dt.date | None) -> str:
    return f"{directory.rstrip('/')}/{EXPORT_PREFIX}_{run_date or dt.date.today()}.csv"


def _write_joined(df: DataFrame, path: str) -> None:
    spark = df.sparkSession
    header, parts = stage_path(spark, "export_header"), stage_path(spark, "export_parts")
    names = spark.range(1, numPartitions=1).select(*[F.lit(c).alias(f"c{k}") for k, c in enumerate(df.columns)])
    try:
        _csv(names, header=False).csv(header)
        _csv(df, header=False).csv(parts)
        join_files(spark, [header, parts], path)
    finally:
        remove(spark, [header, parts])


def _csv(df: DataFrame, header: bool):
    return df.write.options(header=header, nullValue="NA", escape='"')


def join_files(spark: SparkSession, folders: list[str], path: str) -> None:
    """One file of the part files of ``folders``, in the order of their names.

    On HDFS the parts' blocks become the file's without being copied. Elsewhere they are copied a piece at a
    time through Hadoop's streams, which the driver holds open.
    """
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(hadoop)
    growing = jvm.org.apache.hadoop.fs.Path(f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}")
    parts = []
    for folder in folders:
        there = jvm.org.apache.hadoop.fs.Path(folder)
        entries = [e for e in there.getFileSystem(hadoop).listStatus(there) if e.getPath().getName().startswith("part-") and e.getLen() > 0]
        parts += sorted((e.getPath() for e in entries), key=lambda p: p.getName())
    try:
        if files.getScheme() == "hdfs" and all(p.getFileSystem(hadoop).getUri() == files.getUri() for p in parts):
            files.create(growing, True).close()
            sources = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(parts))
            for k, part in enumerate(parts):
                sources[k] = part
            files.concat(growing, sources)
        else:
            out = files.create(growing, True)
            try:
                for part in parts:
                    source = part.getFileSystem(hadoop).open(part)
                    try:
                        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, COPY_BYTES, False)
                    finally:
                        source.close()
            finally:
                out.close()
        files.delete(target, True)
        if not files.rename(growing, target):
            raise OSError(f"cannot name the export {path}")
    finally:
        files.delete(growing, False)
