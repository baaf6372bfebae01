"""What several operators need of texts: words, reading, slicing of Arrow batches."""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but these six characters. Python's bytes.split()
# without arguments breaks at exactly the same six.
BREAKS = r"\x20\x09-\x0D"
SLICE_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def count_words(text: Column) -> Column:
    """Number of words, 0 for NULL."""
    spaced = F.trim(F.regexp_replace(text, f"[{BREAKS}]+", F.lit(" ")))
    gaps = F.length(spaced) - F.length(F.translate(spaced, " ", ""))
    return F.when(F.coalesce(F.length(spaced), F.lit(0)) == 0, F.lit(0)).otherwise(gaps + 1).cast("long")


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that ``column`` holds about ``most_bytes`` in each.

    A longer text comes alone, so memory follows the longest text at most.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def as_bytes(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8, NULL as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop of each run of equal values in sorted columns."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, int), np.zeros(0, int)
    changed = np.zeros(n - 1, bool)
    for column in columns:
        changed |= column[1:] != column[:-1]
    cuts = np.flatnonzero(changed) + 1
    return np.concatenate(([0], cuts)), np.concatenate((cuts, [n]))


def kept_in_worker(name: str, make: Callable[[], object]) -> object:
    """An object that later tasks of the same Python worker find again.

    Spark reuses workers, so what is slow to load or remembered for speed is
    made once per worker. It must not change any result.
    """
    kept = vars(sys).setdefault("_kept_in_worker", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


class Shared:
    """An object sent to the executors once, which need no copy of this package to read it.

    It travels as bytes that hold its classes too. A Python worker unpacks it once and lets go of it when Spark
    takes the broadcast back from the worker, as it does with any other.
    """

    def __init__(self, spark: SparkSession, value: object) -> None:
        self.packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self) -> object:
        held = self.packed.value
        if isinstance(held, bytes):
            held = self.packed._value = pickle.loads(held)  # in place of the bytes
        return held


class Remembered(dict):
    """Results of ``make`` by key. When full, the half remembered first is kept.

    What is frequent is met early, so that half holds it.
    """

    def __init__(self, make: Callable[[object], object], most: int) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: object) -> object:
        value = self.make(key)
        if len(self) >= self.most:
            first = list(islice(self.items(), self.most // 2))
            self.clear()
            self.update(first)
        self[key] = value
        return value


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in one array, and the number of words of each text."""
    texts = pc.fill_null(texts, "")
    spaced = pc.ascii_trim(pc.replace_substring_regex(texts, r"[\x09-\x0D\x20]+", " "), " ")
    cut = pc.split_pattern(spaced, " ")
    words, text_of = cut.flatten(), np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy()))
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)  # no words split into one empty string
    return words.filter(pa.array(real)), np.bincount(text_of[real], minlength=len(texts))
