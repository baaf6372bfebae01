"""Filter interaction audit: what each filter removes, alone, in any order, and on average.

Each document is measured once and gets a bit per filter that it fails. Counted by
part of the corpus and failure bits, that is a table of at most 2^k rows per part,
and all the rest follows from it: the removals of every coalition of filters, from
differences of coalitions the counts at each step of each order, and from the
kernel-weighted least squares over all coalitions, with the grand coalition's
removals as a constraint, the Shapley values. The equations are solved in
rationals, so nothing is rounded.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.texts import as_bytes, slices
from cohortspan.staging import stage

# The filters: a letter each, and when a document fails, in terms of the measurements.
FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 2 * n_chars",
    "D": "n_symbols > 0",
    "E": "is_copy",
}
MOST_FILTERS = 6
SYMBOLS = b"#$%&*|"
MEASURED = "n_words long, n_distinct long, n_chars long, n_capitals long, n_symbols long"
AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)

# What a byte adds to n_chars, n_capitals and n_symbols.
_BYTES = np.arange(256)
_KINDS = (
    (_BYTES & 0xC0) != 0x80,  # first byte of a code point
    (_BYTES >= ord("A")) & (_BYTES <= ord("Z")),
    np.isin(_BYTES, list(SYMBOLS)),
)


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id, part``, the measurements and ``text_1, text_2``, 128 bits of the text, per row of ``docs``.

    A NULL text is an empty one, a NULL source the part ``""``.
    """
    kinds, symbols = _KINDS, f"doc_id long, part string, {MEASURED}, text_1 long, text_2 long"

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = as_bytes(batch.column("text"))
            buffer = np.frombuffer(b"".join(texts), np.uint8)
            ends = np.cumsum([0, *map(len, texts)])
            counts = [np.diff(np.concatenate(([0], np.cumsum(kind[buffer])))[ends]) for kind in kinds]
            words = [text.split() for text in texts]
            sums = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text) for text in texts), "<i8").reshape(-1, 2)
            columns = [
                batch.column("doc_id"), batch.column("part"),
                pa.array([len(w) for w in words], pa.int64()), pa.array([len(set(w)) for w in words], pa.int64()),
                *[pa.array(c, pa.int64()) for c in counts],
                pa.array(sums[:, 0], pa.int64()), pa.array(sums[:, 1], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(
                columns, ["doc_id", "part", "n_words", "n_distinct", "n_chars", "n_capitals", "n_symbols", "text_1", "text_2"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    return rows.mapInArrow(measured, symbols)


def with_copies(rows: DataFrame) -> DataFrame:
    """Add ``is_copy``: a smaller id has the same text, anywhere in the table.

    ``rows`` is a written table. Only texts that occur more than once are joined
    back; the join's two sides are bare shuffles, so a text that a third of all rows share
    is split over tasks. Rows without an id are never copies and have none.
    """
    firsts = stage(
        rows.groupBy("text_1", "text_2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
        .where("n > 1").drop("n"),
        "first_copies",
    )
    return rows.join(firsts, ["text_1", "text_2"], "left").withColumn(
        "is_copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    )


def failure_counts(docs: DataFrame, labels: DataFrame, filters: Mapping[str, str] = FILTERS) -> DataFrame:
    """``part, fails, docs, good, toxic``: documents by part and failure bits, bit k for the k-th filter.

    ``good`` and ``toxic`` count documents that any row of ``labels`` calls quality 1 or toxic 1.
    """
    rows = with_copies(stage(measure(docs), "measured"))
    bits = sum(
        (F.coalesce(F.expr(rule), F.lit(False)).cast("int") * (1 << k) for k, rule in enumerate(filters.values())), F.lit(0)
    )
    marks = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    marked = rows.select("doc_id", "part", bits.alias("fails")).join(marks, "doc_id", "left")
    return marked.groupBy("part", "fails").agg(
        F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
        F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"),
    )


def removals(cells: list[dict[str, int]], counted: str, k: int) -> list[int]:
    """For every coalition of ``k`` filters, as bits: how many are removed if just these filters apply."""
    coalitions = np.arange(1 << k)
    fails = np.array([cell["fails"] for cell in cells], np.int64)
    counts = np.array([cell[counted] for cell in cells], np.int64)
    return ((coalitions[:, None] & fails[None, :] != 0) @ counts).tolist()


def solve(matrix: list[list[Fraction]], values: list[Fraction]) -> list[Fraction]:
    """The solution of regular linear equations, by elimination."""
    rows = [[*row, value] for row, value in zip(matrix, values)]
    for c in range(len(rows)):
        pivot = next(r for r in range(c, len(rows)) if rows[r][c])
        rows[c], rows[pivot] = rows[pivot], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(len(rows)):
            if r != c and rows[r][c]:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c])]
    return [row[-1] for row in rows]


def shapley_values(worth: list[int], k: int) -> list[Fraction]:
    """The additive worths nearest to ``worth`` over all coalitions.

    Squared distances are weighted by the Shapley kernel; the weights of the empty and of the
    grand coalition are unbounded, so these two are met exactly, the latter by a multiplier.
    """
    everyone = (1 << k) - 1
    matrix = [[Fraction(0)] * (k + 1) for _ in range(k + 1)]
    values = [Fraction(0)] * k + [Fraction(worth[everyone])]
    for coalition in range(1, everyone):
        members = [i for i in range(k) if coalition >> i & 1]
        weight = Fraction(k - 1, comb(k, len(members)) * len(members) * (k - len(members)))
        for i in members:
            values[i] += weight * worth[coalition]
            for j in members:
                matrix[i][j] += weight
    for i in range(k):
        matrix[i][k] = matrix[k][i] = Fraction(1)
    return solve(matrix, values)[:k]


def audit_part(cells: list[dict[str, int]], letters: list[str]) -> Iterator[tuple]:
    """The rows of one part, from ``filter_order`` on."""
    k = len(letters)
    docs, good, toxic = (removals(cells, counted, k) for counted in ("docs", "good", "toxic"))
    total, everyone = sum(cell["docs"] for cell in cells), (1 << k) - 1
    summed = [int(value * factorial(k)) for value in shapley_values(docs, k)]
    for order in permutations(range(k)):
        before, name = 0, "".join(letters[i] for i in order)
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = docs[after] - docs[before]
            yield (
                name, step, total - docs[after], removed, docs[1 << i] - removed,
                docs[everyone] - docs[everyone ^ 1 << i], good[after] - good[before], toxic[after] - toxic[before], summed[i],
            )
            before = after


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, str] = FILTERS) -> DataFrame:
    """How the filters interact: a row per part, order of the filters and step, zeros included.

    ``kept`` documents are left after the step, ``removed`` go in it, ``redundant`` fail its filter
    but went earlier, ``unique_fails`` fail no other filter; ``good_lost`` and
    ``toxic_lost`` are those among ``removed`` with such a label. ``shapley`` is what the filter
    removes summed over all orders. ``filters`` gives letters and SQL conditions over the
    measurements; a condition that is NULL counts as passed.

    NULL and empty texts are equal and have no words. Rows that repeat an id all count; a copy is
    only what has a smaller id before it, so rows of one id are no copies of each other, and rows without an
    id are no copies, have none and have no label. A source that is NULL and an empty one are one
    part. Repeated labels of an id count once. Other columns are not read. No documents give
    no rows. A task holds one text and its words at a time; parts and copies of any size are counted
    before they meet.
    """
    if not 0 < len(filters) <= MOST_FILTERS:
        raise ValueError(f"an audit takes 1 to {MOST_FILTERS} filters")
    letters = list(filters)
    fields = [field.strip().split(" ")[0] for field in AUDIT.split(",")]

    def audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
                rows = list(audit_part(cells, letters))
                columns = [pa.array([part] * len(rows), pa.string()), *map(pa.array, zip(*rows))]
                yield pa.RecordBatch.from_arrays([c.cast(pa.int32()) if f == "step" else c for f, c in zip(fields, columns)], fields)

    cells = F.collect_list(F.struct("fails", "docs", "good", "toxic"))  # 2^filters at most
    tables = failure_counts(docs, labels, filters).groupBy("part").agg(cells.alias("cells"))
    return tables.mapInArrow(audited, AUDIT)
