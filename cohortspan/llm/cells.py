"""Comparing the rows that share a cell, with crowded cells split over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.texts import runs
from cohortspan.staging import stage

CELL_ROWS = 4096


def by_cell(rows: DataFrame, item: str, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Rows dealt out and sorted by ``cell``, ready for ``cell_groups``.

    A cell of more than ``cell_rows`` rows is split into blocks, and every pair
    of blocks becomes a group of its own (``low``, ``high``): its work spreads
    over as many tasks as there are pairs, and none holds more than two blocks.
    ``mine`` is the row's own block.
    """
    crowded = stage(
        rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows), "crowded"
    )
    blocks = F.coalesce(F.ceil(F.col("n") / cell_rows), F.lit(1)).cast("int")
    spread = (
        rows.join(crowded, "cell", "left")
        .withColumn("blocks", blocks)
        .withColumn("mine", F.pmod(F.xxhash64(item), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("mine", "other"))
        .withColumn("high", F.greatest("mine", "other"))
        .drop("n", "blocks", "other")
    )
    return spread.repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high")


def cell_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
    """The groups of at least two rows, as columns; a group may span batches.

    Yields ``{"columns": {...}, "low": int, "high": int}``. Fixed-width columns
    come as arrays, the others as lists.
    """
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        starts, stops = _bounds(table)
        if len(starts):
            yield from _groups(table, starts[:-1], stops[:-1])
            rest = table.slice(int(starts[-1]))
    if rest is not None:
        yield from _groups(rest, *_bounds(rest))


def _bounds(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    if not table.num_rows:
        return np.array([], int), np.array([], int)
    return runs(*[table[c].to_numpy() for c in ("cell", "low", "high")])


def _groups(table: pa.Table, starts: np.ndarray, stops: np.ndarray) -> Iterator[dict[str, object]]:
    wide = np.flatnonzero(stops - starts > 1)
    if not len(wide):
        return
    columns = {
        c: table[c].to_numpy() if pa.types.is_primitive(table.schema.field(c).type) else table[c].to_pylist()
        for c in table.column_names
    }
    for k in wide:
        at = slice(int(starts[k]), int(stops[k]))
        part = {name: values[at] for name, values in columns.items()}
        yield {"columns": part, "low": int(part["low"][0]), "high": int(part["high"][0])}


def pairs_of(
    group: dict[str, object], link: Callable[[np.ndarray, np.ndarray], np.ndarray], chunk: int = 512
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs ``i, j`` of a group's rows, a bounded number of rows at a time.

    ``link(i, j)`` gets two index arrays and says for each combination whether
    it is a link. Within a block every pair is looked at once, between two
    blocks only pairs across.
    """
    mine = np.asarray(group["columns"]["mine"])
    left = np.flatnonzero(mine == group["low"])
    right = np.flatnonzero(mine == group["high"])
    inside = group["low"] == group["high"]
    for start in range(0, len(left), chunk):
        i = left[start:start + chunk]
        j = right[start:] if inside else right
        x, y = np.nonzero(link(i, j))
        if inside:
            later = y > x
            x, y = x[later], y[later]
        yield i[x], j[y]
