"""Target-distribution importance resampling: documents drawn by how much their n-grams look like the target's.

All n-grams of the documents and of the target are counted in hashed buckets; a
bucket's gain is the logarithm of how much more frequent it is in the target. A document's
weight is the sum of the gains of its n-grams. Weights plus Gumbel noise from the
document's id rank the documents, and the highest are drawn: a sample
without replacement in proportion to the exponential of the weights, the same in each run.

Both passes over texts intern a block's n-grams (``ngrams``), so a bucket is found once per
n-gram of a block: the first counts slots into buckets, the second gives slots their bucket's gain and
gathers gains by the occurrences' slots.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.ngrams import Slots, Words, blocks, checksums, interned, words_of
from cohortspan.llm.prefix import running_totals
from cohortspan.llm.texts import as_bytes, slices
from cohortspan.staging import stage

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
SHARE = 5  # of 100
SEED = 42
TEXT = "text to weigh"


def bucketed(words: Words, buckets: int, longest: int) -> Iterator[tuple[Slots, np.ndarray]]:
    """Per block of words: the table of its n-grams, and the bucket of each slot (any for empty slots)."""
    for block in blocks(words, longest):
        slots = interned(block, longest)
        used = np.flatnonzero(slots.count)
        owner = slots.owner[used]
        bucket = np.zeros(len(slots.owner), np.int64)
        bucket[used] = checksums(block.buffer, slots.starts[owner], slots.lengths[owner]) % np.uint32(buckets)
        yield slots, bucket


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """``bucket, n``: occurrences of n-grams in all texts of ``docs``, for buckets that have any.

    A task sends a row per bucket at most, whatever it reads.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for slots, bucket in bucketed(words_of(as_bytes(batch.column("text"))), buckets, longest):
                total += np.bincount(bucket, weights=slots.count, minlength=buckets).astype(np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    return docs.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Each bucket's gain, in thousandths; a row per bucket comes to the driver, at most ``buckets`` of each table."""
    counts = []
    for texts in (docs, target):
        own = np.zeros(buckets, np.int64)
        for row in bucket_counts(texts, buckets, longest).collect():
            own[row["bucket"]] = row["n"]
        counts.append(own)
    source, wanted = (own.tolist() for own in counts)
    in_source, in_target = float(sum(source) + buckets), float(sum(wanted) + buckets)
    return np.array(
        [math.floor(1000 * math.log((t + 1) * in_source / ((s + 1) * in_target))) for s, t in zip(source, wanted)], np.int64
    )


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``carry``, then ``n_words``, ``n_features`` and ``weight``, the sum of gains over a text's n-grams, per row of ``docs``.

    A NULL text has no words. Blocks of words bound memory, so a text of any length is
    weighed whole.
    """
    held = docs.sparkSession.sparkContext.broadcast(gain)  # a number per bucket
    schema = docs.select(*[F.col(f"`{c}`") for c in carry]).schema
    for name in ("n_words", "n_features", "weight"):
        schema = schema.add(name, "long")
    names = schema.names

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TEXT):
            words = words_of(as_bytes(batch.column(TEXT)))
            weight, features = np.zeros((2, batch.num_rows), np.int64)
            for slots, bucket in bucketed(words, len(held.value), longest):
                gain_of = held.value[bucket]
                np.add.at(weight, slots.text, gain_of[slots.slot])
                np.add.at(features, slots.text, 1)
            n_words = pa.array(np.diff(words.first), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], n_words, pa.array(features), pa.array(weight)], names
            )

    rows = docs.select(*[F.col(f"`{c}`") for c in carry], F.col("text").alias(TEXT))
    return rows.mapInArrow(weighed, schema)


def draw(weighed: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Add ``score`` and ``rank`` (1, 2, ...; NULL where not drawn) to ``doc_id, n_words, n_features, weight``.

    Of the documents with ``least_words`` words or more, ``share`` in 100 are drawn, rounded
    down: those of the highest scores, ties to the smaller id, rows without an id last.
    Rows are ranked over ranges of scores, so no task sees more than its range.
    """
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    even = (F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32
    spread = F.floor(-1000 * F.log(-F.log(even)))
    scored = stage(weighed.withColumn("score", F.col("weight") + spread), "scored")
    able = F.col("n_words") >= least_words
    drawn = share * scored.where(able).count() // 100
    order = [able.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    ranked = running_totals(scored, order, {"rank": able.cast("long")})
    return ranked.withColumn("rank", F.when(able & (F.col("rank") < drawn), F.col("rank") + 1))


def resample(
    docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, buckets: int = BUCKETS,
    longest: int = LONGEST, seed: int = SEED,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``docs``, drawn to look like ``target``.

    Words are runs of digits, a to z without case and characters beyond ASCII. NULL and
    empty texts have no words, weight 0 and are never drawn. Rows that repeat an id have the same noise and
    are drawn each for itself; rows without an id share the noise of an empty one. Ties between equal
    rows fall either way. An empty target leaves gains that favour rare n-grams; no rows
    give no rows. Other columns are not read. Nothing but ``buckets`` counts of each table reaches the driver.
    """
    own = docs.select(F.col("doc_id").cast("long"), "text")
    return draw(weigh(own, gains(own, target.select("text"), buckets, longest), longest), share, least_words, seed)
