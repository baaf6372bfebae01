"""The six source tables: enrolment, applications and four code tables."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType

from cohortspan.sources.jdbc import read_jdbc
from cohortspan.sources.schemas import SOURCE_SCHEMAS


# Read on in the source's own type: they are filtered first and cast with the
# cohort's other columns, so the source can skip partitions and row groups, and
# snapshots of one day but different times stay apart.
KEPT_TYPES = {"enrollment": ("SchoolYear", "AsOf", "SchoolCode", "Grade"), "isir": ("ISIRYear",)}


def conform(df: DataFrame, schema: Mapping[str, str], kept: Collection[str] = ()) -> DataFrame:
    """Pick the expected columns by name and cast them to the expected types.

    The ``kept`` ones stay as they are unless they are text.
    """
    as_is = {f.name.lower() for f in df.schema if not isinstance(f.dataType, StringType)} & {k.lower() for k in kept}
    missing = [name for name in schema if name.lower() not in {c.lower() for c in df.columns}]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.selectExpr(
        *[f"`{name}`" if name.lower() in as_is else f"CAST(`{name}` AS {kind}) AS `{name}`" for name, kind in schema.items()]
    )


def read_source(spark: SparkSession, spec: Mapping[str, object]) -> DataFrame:
    """One table from ``{"table": name}`` or ``{"format": f, "path": p, "options": {...}}``.

    Any Spark format works, so the enrolment warehouse and the application
    system may live in different places. For ``jdbc`` name a key besides,
    ``{"format": "jdbc", "key": column, "options": {...}}``: the table is then read in
    ranges of it, see ``read_jdbc``. Without one, and without Spark's own partitioning
    options, a single task reads the whole table.
    """
    if "table" in spec:
        return spark.table(str(spec["table"]))
    if spec["format"] == "jdbc" and "key" in spec:
        return read_jdbc(spark, dict(spec["options"]), str(spec["key"]), spec.get("partitions"))
    reader = spark.read.format(str(spec["format"])).options(**dict(spec.get("options", {})))
    return reader.load(str(spec["path"])) if "path" in spec else reader.load()


def load_sources(
    spark: SparkSession, specs: Mapping[str, Mapping[str, object] | DataFrame]
) -> dict[str, DataFrame]:
    """All source tables, by role, with the types the jobs expect or can filter on."""
    unknown = set(specs) - set(SOURCE_SCHEMAS)
    absent = set(SOURCE_SCHEMAS) - set(specs)
    if unknown or absent:
        raise ValueError(f"unknown roles {sorted(unknown)}, absent roles {sorted(absent)}")
    return {
        role: conform(
            spec if isinstance(spec, DataFrame) else read_source(spark, spec),
            SOURCE_SCHEMAS[role], KEPT_TYPES.get(role, ()),
        )
        for role, spec in specs.items()
    }
