"""Line dedup: a line that many documents share stays in one of them.

Lines are exploded with their position, normalised and hashed; the distinct
documents of each hash are counted, and documents are put together again from
the positions that are left. Only hashes and positions are shuffled on the way
to a decision. A text is shuffled once at most, with the positions it loses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.staging import stage

LEAST_CHARS = 20
LEAST_DOCUMENTS = 3
BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ("n_lines", "n_dropped")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """What two lines have to share to count as the same: all but outer blanks and the case of A to Z."""
    return F.btrim(F.translate(line, CAPITALS, SMALL), F.lit(BLANKS))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``doc, row_1, row_2, position, hash_1, hash_2`` of all lines whose key is long enough.

    ``row_1, row_2`` are 128 bits over id and text: what a document loses follows
    from these two alone. Keys are compared by 128 bits as well.
    """
    own = docs.select(
        F.col("doc_id").alias("doc"), *_row_key(), F.posexplode(lines_of(F.col("text"))).alias("position", "line")
    )
    keyed = own.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= least_chars)
    return keyed.select(
        "doc", "row_1", "row_2", "position",
        F.xxhash64("key").alias("hash_1"), F.xxhash64(F.lit("second"), "key").alias("hash_2"),
    )


def common_lines(hashes: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``hash_1, hash_2, keeper``: hashes found in enough documents, and the largest id that holds them.

    Documents are told apart by id, so rows that repeat an id count once and so
    do all rows without one. The distinct ids of a hash are found in tasks dealt
    by hash and id: a line that a third of all documents hold lands in no single one.
    """
    found = hashes.groupBy("hash_1", "hash_2").agg(
        (F.count_distinct("doc") + F.max(F.col("doc").isNull().cast("long"))).alias("documents"),
        F.max("doc").alias("keeper"),
    )
    return found.where(F.col("documents") >= least_documents).drop("documents")


def dropped_positions(hashes: DataFrame, common: DataFrame) -> DataFrame:
    """``row_1, row_2, dropped``: for each document that loses lines, their positions in order.

    ``common`` has to be a written table: Spark then broadcasts it if it is small,
    and else deals both sides by hash and splits the hot ones.
    """
    lost = hashes.join(common, ["hash_1", "hash_2"]).where(~F.col("doc").eqNullSafe(F.col("keeper")))
    return lost.groupBy("row_1", "row_2").agg(F.sort_array(F.collect_set("position")).alias("dropped"))


def dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """All documents, their text without the lines that many documents share.

    A line goes if its key has ``least_chars`` code points or more and is found
    in ``least_documents`` documents or more, unless this document has the
    largest ``doc_id`` that holds it; there all such lines stay, repeats too. The
    rest is joined by ``\\n``.

    Columns are those of ``docs``, then ``n_lines`` (before) and ``n_dropped``; columns of
    ``docs`` with these two names are replaced, any other name may occur. A NULL or
    empty text is one empty line and stays what it is. A text that loses all its
    lines becomes empty. Rows that repeat an id are one document when documents
    are counted, as are rows without an id, which never are the largest; each row
    is kept and loses its own lines. Equal rows stay equal. No rows give no rows. Work
    and memory of a task follow the longest text, in proportion to its length.
    """
    if least_chars < 1:
        raise ValueError("least_chars has to be 1 or more: empty lines are no repeats")
    hashes = stage(line_hashes(docs, least_chars), "line_hashes")
    common = stage(common_lines(hashes, least_documents), "common_lines")
    dropped = stage(dropped_positions(hashes, common), "dropped_lines")

    # the columns of docs travel in a struct, so that no name of theirs meets one of ours
    rest = [c for c in docs.columns if c not in ("text", *COUNTS)]
    cut = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in rest], F.col("text").isNull().alias("text")).alias("own"),
        *_row_key(), lines_of(F.col("text")).alias("lines"),
    )
    joined = cut.join(dropped, ["row_1", "row_2"], "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.when(F.col("dropped").isNotNull(), F.transform(places, lambda i: F.get("lines", i))).otherwise(F.col("lines"))
    text = F.when(F.col("dropped").isNull() & F.col("own.text"), F.lit(None)).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(f"own.`{c}`") for c in docs.columns if c not in COUNTS],
        F.size("lines").cast("long").alias(COUNTS[0]),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias(COUNTS[1]),
    )


def _row_key() -> list[Column]:
    """128 bits over id and text; a missing value leaves a hash as it was, so it is hashed as well."""
    whole = [F.col("doc_id"), F.col("text"), F.col("doc_id").isNull()]
    return [F.xxhash64(*whole).alias("row_1"), F.xxhash64(F.lit("second"), *whole).alias("row_2")]
