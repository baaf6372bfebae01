"""SimHash near-duplicates: fingerprints, a grid range-join of bit counts, exact check.

A fingerprint's 64 bits are cut into 32 segments of two bits. The bit counts of
the segments (0, 1 or 2) are a point in 32 dimensions, and the Manhattan
distance of two points never exceeds the bit distance of the fingerprints. Two
points within a distance of 3 lie within 1 of each other in one half of the
dimensions, so the grid of each half is joined with a range of one step: every
point sits in its own cell and probes the cells one step up. What shares a cell
is checked against the Manhattan bound and then against the bit distance.

Bit counts are kept in unary (0: 00, 1: 01, 2: 11), so a whole point is again 64
bits and the Manhattan distance is the number of bits in which two points differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.cells import by_cell, cell_groups, pairs_of
from cohortspan.llm.components import components, star
from cohortspan.llm.rows import ROW_KEY, pick_rows, with_row_key
from cohortspan.llm.texts import as_bytes, slices
from cohortspan.staging import stage, staged_tables

SHINGLE_WORDS = 3
MOST_BITS = 3
HASH_SEED = 42
LOW_BITS = 0x5555555555555555


def fingerprint(text: bytes, words_each: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a text; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    last = max(0, len(words) - words_each)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (
            digest(joined[i:j], HASH_SEED)
            for i, j in zip(starts[: last + 1].tolist(), ends[-(last + 1):].tolist())
        ),
        np.uint64,
        last + 1,
    )
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    set_in = np.zeros(64, np.int64)
    for start in range(0, len(bits), 1 << 16):
        set_in += bits[start:start + (1 << 16)].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > len(hashes)).tobytes(), "big")


def fingerprints(
    docs: DataFrame, words_each: int = SHINGLE_WORDS, carry: tuple[str, ...] = ()
) -> DataFrame:
    """``doc_id``, the ``carry`` columns and ``fp``, the fingerprint as a signed long."""
    names = ["doc_id", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = np.array([fingerprint(t, words_each) for t in as_bytes(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(prints.view(np.int64))], [*names, "fp"]
            )

    kinds = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    return docs.select(*names, "text").mapInArrow(run, f"{kinds}, fp long")


def unary(prints: np.ndarray) -> np.ndarray:
    """Per fingerprint its 32 bit counts in unary."""
    low = np.uint64(LOW_BITS)
    first, second = prints & low, (prints >> np.uint64(1)) & low
    return (first | second) | ((first & second) << np.uint64(1))


def grid_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each fingerprint its own cell and the cells one step up, in both halves."""
    for batch in batches:
        prints = batch.column("fp").to_numpy().view(np.uint64)
        point = unary(prints)
        cells, items, probes = [], [], []
        for half in (0, 1):
            # a half's 16 counts in 32 bits; the half's number keeps the two grids apart
            code = (point >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
            base = np.uint64(half << 32)
            cells.append(code | base)
            items.append(prints)
            probes.append(np.zeros(len(prints), bool))
            for segment in range(16):
                held = (code >> np.uint64(2 * segment)) & np.uint64(3)
                room = held < 3
                up = code[room] | (np.where(held[room] == 0, 1, 2).astype(np.uint64) << np.uint64(2 * segment))
                cells.append(up | base)
                items.append(prints[room])
                probes.append(np.ones(int(room.sum()), bool))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(cells).view(np.int64)),
                pa.array(np.concatenate(items).view(np.int64)),
                pa.array(np.concatenate(probes)),
            ],
            ["cell", "fp", "probe"],
        )


def close_pairs(most_bits: int):
    """Links within the groups of ``by_cell``, as links to one row per component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in cell_groups(batches):
            prints = group["columns"]["fp"].view(np.uint64)
            probe = np.asarray(group["columns"]["probe"], bool)
            if probe.all():
                continue
            point = unary(prints)

            def link(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                bound = np.bitwise_count(point[i][:, None] ^ point[j][None, :]) <= most_bits
                x, y = np.nonzero(bound & ~(probe[i][:, None] & probe[j][None, :]))
                bound[:] = False
                bound[x, y] = np.bitwise_count(prints[i[x]] ^ prints[j[y]]) <= most_bits
                return bound

            a, b = [], []
            for i, j in pairs_of(group, link):
                moved, root = star(i, j, len(prints))
                a.append(moved)
                b.append(root)
            if a and sum(map(len, a)):
                moved, root = star(np.concatenate(a), np.concatenate(b), len(prints))
                signed = prints.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signed[moved]), pa.array(signed[root])], ["a", "b"])

    return run


def fingerprint_components(prints: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """``node`` and ``root`` for all fingerprints that have another one near.

    The range of the grid join fits distances up to 3: of two halves, one holds
    at most one of three steps.
    """
    if not 0 <= most_bits <= 3:
        raise ValueError("the grid's range covers distances up to 3 bits")
    cells = prints.select("fp").distinct().mapInArrow(grid_cells, "cell long, fp long, probe boolean")
    rows = by_cell(cells, "fp")
    return components(stage(rows.mapInArrow(close_pairs(most_bits), "a long, b long"), "near"))


def near_duplicates(
    docs: DataFrame, words_each: int = SHINGLE_WORDS, most_bits: int = MOST_BITS, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Per document its ``fingerprint`` (16 hex digits), ``component_id`` and ``root``.

    A component holds all documents reachable by links of ``most_bits`` differing
    bits or fewer; its id is the smallest doc_id in it, and ``root`` the long that
    names it even where all its ids are NULL. Texts without words (NULL, empty,
    blank) have fingerprint zero and link like any other. Repeated rows are
    documents of their own. An empty table gives no rows; other columns than
    ``carry`` are not looked at.
    """
    prints = stage(fingerprints(docs, words_each, carry), "fingerprints")
    found = stage(fingerprint_components(prints, most_bits), "components")
    rooted = stage(
        prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
        .join(found, F.col("fp") == F.col("node"), "left")
        .select("fp", "least", F.coalesce("root", "fp").alias("root")),
        "rooted",
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = stage(rooted.join(ids, "root").select("fp", "root", "component_id"), "component_ids")
    return prints.join(by_print, "fp").select(
        "doc_id", *carry, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root"
    )


def keep_one(docs: DataFrame, words_each: int = SHINGLE_WORDS, most_bits: int = MOST_BITS) -> DataFrame:
    """The documents without near copies: of each component exactly one row stays.

    It is a row with the component's smallest doc_id, a NULL id coming last. All
    columns are returned as they came.
    """
    with staged_tables(docs.sparkSession) as kept:
        found = near_duplicates(with_row_key(docs), words_each, most_bits, carry=tuple(ROW_KEY))
        rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), *ROW_KEY)
        alike = found.groupBy("root", "doc_id", *ROW_KEY).agg(F.count(F.lit(1)).alias("rows"))
        first = alike.groupBy("root").agg(F.min_by(F.struct(*ROW_KEY, "rows"), rank).alias("first"))
        chosen = kept(first.select("first.*"), "chosen")
    return pick_rows(docs, chosen).select("own.*")
