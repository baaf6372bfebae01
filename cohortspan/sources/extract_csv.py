"""The extract as a CSV file set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cohortspan.config import NA_TOKENS
from cohortspan.sources.schemas import EXTRACT_SCHEMA
from cohortspan.sources.tables import conform


def read_extract(
    spark: SparkSession, path: str, na_tokens: tuple[str, ...] = NA_TOKENS, multiline: bool = False
) -> DataFrame:
    """Read the extract; every NA token is NULL, blanks around values are dropped.

    All columns are read as text and cast by name, so neither column order nor
    value-based type guessing matters. Files of one set must agree on their header,
    else the job fails instead of reading values into the wrong columns. ``multiline`` allows line breaks inside
    quoted values, at the price of files that cannot be split between tasks.
    """
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": multiline}
    names = spark.read.csv(path, **options).columns
    text = StructType([StructField(name, StringType()) for name in names])
    raw = spark.read.schema(text).csv(path, enforceSchema=False, **options)
    cleaned = raw.select(
        *[
            F.when(~F.trim(F.col(f"`{name}`")).isin(*na_tokens), F.trim(F.col(f"`{name}`"))).alias(name)
            for name in raw.columns
        ]
    )
    return conform(cleaned, EXTRACT_SCHEMA)
