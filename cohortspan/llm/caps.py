"""Embedding near-duplicates by spherical-cap filters.

A filter is a direction, and a vector belongs to all filters it exceeds a
threshold with. The directions form a product code: the space is cut in two
halves with ``CODES`` random unit directions each, and every pair of them is a
filter, CODES squared in all. Because a filter's inner product is the sum of its
halves', the filters that a vector exceeds are listed from two short sorted
lists, without looking at the others. Close vectors exceed mostly the same
filters, so vectors are joined on filters and verified by their cosine.

The threshold lets a random vector pass about ``FILTERS`` filters; one that
passes fewer than ``LEAST_FILTERS`` takes its best ones instead. Two vectors of
cosine 0.95 share half of their filters or more, so all but a vanishing part of
the pairs meet somewhere.

The join only has to connect vectors. Links are then counted inside components:
there every pair is compared, once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.cells import by_cell, cell_groups, pairs_of
from cohortspan.llm.components import components, star
from cohortspan.staging import stage

LEAST_COSINE = 0.95
CODES = 512
FILTERS = 30
LEAST_FILTERS = 16
SEED = 42


class ProductCode:
    """Two lists of random unit directions, for vectors of one length."""

    def __init__(self, length: int, codes: int = CODES, seed: int = SEED) -> None:
        self.cut = (length + 1) // 2
        random = np.random.default_rng([seed, length])
        self.halves = []
        for width in (self.cut, max(length - self.cut, 1)):
            directions = random.standard_normal((codes, width))
            self.halves.append(directions / np.linalg.norm(directions, axis=1, keepdims=True))
        # random directions give inner products around 0 with variance 1/length
        self.threshold = _upper_quantile(FILTERS / codes**2) / np.sqrt(length) * np.sqrt(2)

    def scores(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = unit[:, : self.cut], unit[:, self.cut:]
        if not right.shape[1]:
            right = np.zeros((len(unit), 1))
        return left @ self.halves[0].T, right @ self.halves[1].T

    def filters(self, unit: np.ndarray) -> list[np.ndarray]:
        """Numbers of the filters of each unit vector."""
        first, second = self.scores(unit)
        codes = first.shape[1]
        found = []
        for a, b in zip(first, second):
            order = np.argsort(-b)
            falling = -b[order]
            passed = np.searchsorted(falling, a - self.threshold, side="right")
            if passed.sum() < LEAST_FILTERS:
                best = np.argsort(-a)[:LEAST_FILTERS]
                near = (a[best][:, None] + b[order[:LEAST_FILTERS]][None, :]).ravel()
                top = np.argsort(-near, kind="stable")[:LEAST_FILTERS]
                found.append(best[top // min(LEAST_FILTERS, codes)] * codes + order[top % min(LEAST_FILTERS, codes)])
                continue
            rows = np.repeat(np.arange(codes), passed)
            within = np.arange(passed.sum()) - np.repeat(np.cumsum(passed) - passed, passed)
            found.append(rows * codes + order[within])
        return found


def _upper_quantile(share: float) -> float:
    """The value that a standard normal exceeds with the given probability."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(1 - share)


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Each vector over its length; scaled first, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes: dict[int, ProductCode] = {}
    for batch in batches:
        vectors = batch.column("vector").to_pylist()
        ids = batch.column("cls").to_numpy()
        lengths = np.array([len(v) for v in vectors])
        for length in np.unique(lengths).tolist():
            code = codes.setdefault(length, ProductCode(length))
            at = np.flatnonzero(lengths == length)
            unit = unit_vectors(np.array([vectors[k] for k in at], np.float64))
            for start in range(0, len(at), 256):
                some = code.filters(unit[start:start + 256])
                sizes = np.array([len(f) for f in some])
                rows = np.repeat(at[start:start + 256], sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(some).astype(np.int64) + (length << 40)),
                        pa.array(ids[rows]),
                        batch.column("vector").take(pa.array(rows)),
                    ],
                    ["cell", "cls", "vector"],
                )


def _linker(group: dict[str, object], least_cosine: float):
    unit = unit_vectors(np.array(group["columns"]["vector"], np.float64))
    return lambda i, j: unit[i] @ unit[j].T >= least_cosine


def _join_filters(least_cosine: float):
    """Vectors linked within a filter, as links to one vector per component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in cell_groups(batches):
            ids = group["columns"]["cls"]
            stars = [star(i, j, len(ids)) for i, j in pairs_of(group, _linker(group, least_cosine))]
            a, b = (np.concatenate([s[k] for s in stars]) for k in (0, 1))
            if len(a):
                a, b = star(a, b, len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    return run


def _count_links(least_cosine: float):
    """Per vector how many others it is linked to within the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in cell_groups(batches):
            ids, copies = group["columns"]["cls"], group["columns"]["copies"]
            links = np.zeros(len(ids), np.int64)
            for i, j in pairs_of(group, _linker(group, least_cosine)):
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some])], ["cls", "links"])

    return run


def near_duplicates(vectors: DataFrame, least_cosine: float = LEAST_COSINE) -> DataFrame:
    """Per vector vec_id, n_links, component_id and kept.

    Vectors are compared by cosine in double precision, whatever their labels,
    and link at ``least_cosine`` or more. A vector that is NULL, empty, zero or
    holds NULL or non-finite components links with nothing, nor do vectors of
    different lengths. Equal vectors count as links of each other and are
    compared once; repeated rows are vectors of their own. The component of a
    vector without a vec_id is named by the others' smallest id, or NULL, and
    only a row with that id is kept. An empty table gives no rows, other columns
    are not looked at.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    usable = (
        F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    usable = F.coalesce(usable, F.lit(False))
    # -0.0 and 0.0 are one number
    plain = F.transform("vector", lambda x: x + F.lit(0.0))
    rows = stage(rows.withColumn("vector", F.when(usable, plain)), "vectors")
    classes = stage(
        rows.where(F.col("vector").isNotNull()).groupBy("vector")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
        .withColumn("cls", F.monotonically_increasing_id()),
        "classes",
    )
    cells = classes.select("cls", "vector").mapInArrow(_cells, "cell long, cls long, vector array<double>")
    links = by_cell(cells, "cls").mapInArrow(_join_filters(least_cosine), "a long, b long")
    found = stage(components(stage(links, "links")), "components")
    members = classes.join(found, F.col("cls") == F.col("node"))
    within = by_cell(members.select(F.col("root").alias("cell"), "cls", "vector", "copies"), "cls")
    counts = stage(
        within.mapInArrow(_count_links(least_cosine), "cls long, links long").groupBy("cls").agg(F.sum("links").alias("links")),
        "counts",
    )
    roots = classes.join(found, F.col("cls") == F.col("node"), "left").select(
        "cls", "copies", "least", F.coalesce("root", "cls").alias("root")
    )
    roots = stage(roots, "roots")
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = stage(
        roots.join(named, "root").join(counts, "cls", "left").join(classes.select("cls", "vector"), "cls").select(
            F.col("vector").alias("__vector"), "component_id",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        ),
        "by_class",
    )
    linked = F.col("vector").isNotNull()
    done = rows.join(by_class, F.col("vector") == F.col("__vector"), "left")
    component = F.when(linked, F.col("component_id")).otherwise(F.col("vec_id"))
    return done.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
