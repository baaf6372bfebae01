"""Finding rows again by their content, so that decisions travel without the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW_KEY = ["__row_1", "__row_2"]


def _row_key(docs: DataFrame) -> dict[str, Column]:
    # a missing value leaves a hash as it was, so missing values are hashed as well
    whole = [*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"`{c}`").isNull() for c in docs.columns]]
    return {ROW_KEY[0]: F.xxhash64(*whole), ROW_KEY[1]: F.xxhash64(F.lit("second"), *whole)}


def with_row_key(docs: DataFrame) -> DataFrame:
    """Add 128 bits over all columns: equal for rows that are equal in every column."""
    return docs.withColumns(_row_key(docs))


def pick_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row of ``docs`` for each row key chosen: ``own``, a struct of its columns, beside the columns of ``chosen``.

    In a struct no name in ``docs`` can meet one of ``chosen``, which is a written table with a row per key and
    ``rows``, how many rows have it. The texts are shuffled once at every size; those of repeated rows are
    reduced to one before that.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    keyed = docs.select(own, *[key.alias(name) for name, key in _row_key(docs).items()])
    once = keyed.join(chosen.where("rows = 1").hint("shuffle_hash"), ROW_KEY)
    repeated = chosen.where("rows > 1")
    if repeated.isEmpty():
        return once
    return once.unionByName(keyed.dropDuplicates(ROW_KEY).join(repeated.hint("shuffle_hash"), ROW_KEY))


def every_row(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """All rows of ``docs`` whose row key is chosen, as they came; ``chosen`` is a written table with a row per key."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    keyed = docs.select(own, *[key.alias(name) for name, key in _row_key(docs).items()])
    return keyed.join(chosen.select(*ROW_KEY), ROW_KEY, "left_semi").select("own.*")
