"""Reading a database table in many tasks: ranges of a key, each with its own predicate.

The key's bounds and counts are asked of the database first, so neither has to be known. Ranges hold about the same
number of rows even where a few key values hold most of them. Together the predicates cover every row once
whatever the table holds by the time it is read: the outer ranges are open, and the first also takes rows without a
key.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_PARTITION = 1_000_000
MOST_PARTITIONS = 512
FINE = 4  # counted ranges per partition asked for
LEAST_FINE, MOST_FINE = 64, 1024


def literal(value: object) -> str:
    """A bound in the database's SQL."""
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, bool) or not isinstance(value, (int, float)) and not hasattr(value, "as_tuple"):
        raise ValueError(f"keys have to be numbers or dates, not {type(value).__name__}")
    return str(value)


def range_predicates(column: str, cuts: Sequence[object]) -> list[str]:
    """Predicates of the ranges between ``cuts``, each including its lower cut; every row meets exactly one."""
    cuts = sorted(set(cuts))
    if not cuts:
        return ["1 = 1"]
    first = f"({column} < {literal(cuts[0])} OR {column} IS NULL)"
    middle = [f"({column} >= {literal(a)} AND {column} < {literal(b)})" for a, b in zip(cuts, cuts[1:])]
    return [first, *middle, f"{column} >= {literal(cuts[-1])}"]


def even_cuts(first: object, last: object, parts: int) -> list[object]:
    """Up to ``parts - 1`` cuts that split the values from ``first`` to ``last`` into ranges of one width."""
    if isinstance(first, dt.date):
        days = (last - first).days
        steps = sorted({days * k // parts for k in range(1, parts)} - {0})
        return [first + dt.timedelta(days=d) for d in steps]
    if isinstance(first, int):
        return sorted({first + (last - first + 1) * k // parts for k in range(1, parts)} - {first})
    return sorted({first + (last - first) * k / parts for k in range(1, parts)} - {first})


def weighted_cuts(counts: Sequence[tuple[object, int]], parts: int) -> list[object]:
    """Cuts among counted ranges, given by lower bound and number of rows, that leave about equal numbers of rows."""
    counts = sorted(counts)
    rows, cuts, before, shares = sum(n for _, n in counts), [], 0, 0
    for bound, n in counts:
        if before * parts // rows > shares:
            shares = before * parts // rows
            cuts.append(bound)
        before += n
    return cuts


def probe_cuts(ask, table: str, column: str, parts: int | None = None) -> list[object]:
    """Where to cut ``column``; ``ask(sql)`` runs a query in the database and returns its few rows.

    Two questions: bounds and number of rows, then the rows of some ranges of equal width per partition, which are
    put together until each partition has its share.
    """
    ((first, last, rows),) = ask(f"SELECT min({column}) AS lo, max({column}) AS hi, count(*) AS n FROM {table} t")
    parts = parts or min(MOST_PARTITIONS, -(-rows // ROWS_PER_PARTITION))
    if first is None or first == last or parts <= 1:
        return []
    fine = even_cuts(first, last, min(MOST_FINE, max(LEAST_FINE, parts * FINE)))
    ranges = " ".join(f"WHEN {column} < {literal(cut)} THEN {k}" for k, cut in enumerate(fine))
    counted = ask(
        f"SELECT r, count(*) AS n FROM (SELECT CASE {ranges} ELSE {len(fine)} END AS r FROM {table} t WHERE {column} IS NOT NULL) s GROUP BY r"
    )
    return weighted_cuts([(([first, *fine])[int(r)], int(n)) for r, n in counted], parts)


def read_jdbc(
    spark: SparkSession, options: Mapping[str, object], column: str, parts: int | None = None
) -> DataFrame:
    """A database table, read in ranges of ``column``, a number or a date; NULL keys included.

    ``options`` are those of Spark's jdbc source with ``url`` and ``dbtable``; further ones, such as ``user`` or
    ``fetchsize``, go to the driver. Without ``parts`` there is one per ``ROWS_PER_PARTITION`` rows.
    """
    options = {key: str(value) for key, value in options.items()}
    table, url = options.pop("dbtable"), options.pop("url")

    def ask(sql: str) -> list[tuple]:
        return [tuple(r) for r in spark.read.format("jdbc").options(url=url, query=sql, **options).load().collect()]

    predicates = range_predicates(column, probe_cuts(ask, table, column, parts))
    return spark.read.jdbc(url, table, predicates=predicates, properties=options)
