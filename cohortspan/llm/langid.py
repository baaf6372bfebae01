"""Language identification, words first, then ever shorter character n-grams.

Every language has its learned words with their log frequency. A word that no
language learned is scored by its character 4-grams, if none of those is known by
its 3-grams, and so on. Word counts and n-gram counts cover all learned documents,
and an entry has its true count in every language.

The most frequent entries, at most ``MOST_WORDS`` words and ``MOST_GRAMS`` n-grams
of each length per language, are sent to the executors. All others are looked up
by exact joins, so the size of that head decides about speed, not about results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspan.llm.rows import ROW_KEY, every_row, with_row_key
from cohortspan.llm.texts import Shared, slices
from cohortspan.staging import stage, staged_tables

MOST_WORDS = 20_000
MOST_GRAMS = 10_000
LONGEST = 4
UNKNOWN = "und"


def words_of(texts: pa.Array) -> pa.ListArray:
    """Per text its runs of letters in lower case; empty strings at the ends are no words."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    return pc.split_pattern(pc.replace_substring_regex(lower, r"[^\p{L}]+", " "), " ")


def grams(word: str, n: int) -> list[str]:
    """The character n-grams of a word between blanks; of one alone the characters."""
    padded = f" {word} " if n > 1 else word
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


def word_counts(labelled: DataFrame) -> DataFrame:
    """``lang``, ``entry`` and ``count`` over all rows with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=8 << 20):
            cut = words_of(batch.column("text"))
            lang = batch.column("lang").dictionary_encode()
            words = cut.flatten().dictionary_encode()
            of = np.repeat(lang.indices.to_numpy(), np.diff(cut.offsets.to_numpy()))
            both = of.astype(np.int64) * max(len(words.dictionary), 1) + words.indices.to_numpy()
            keys, counts = np.unique(both, return_counts=True)
            lang_at, word_at = np.divmod(keys, max(len(words.dictionary), 1))
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(lang_at)), words.dictionary.take(pa.array(word_at)), pa.array(counts)],
                ["lang", "entry", "count"],
            )

    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counted = rows.mapInArrow(run, "lang string, entry string, count long").where("entry <> ''")
    return counted.groupBy("lang", "entry").agg(F.sum("count").alias("count"))


def gram_counts(words: DataFrame) -> DataFrame:
    """``lang``, ``n``, ``entry`` and ``count``: in how many distinct words an n-gram stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], Counter] = {}
        for batch in batches:
            for lang, word in zip(batch.column("lang").to_pylist(), batch.column("entry").to_pylist()):
                for n in range(1, LONGEST + 1):
                    counts.setdefault((lang, n), Counter()).update(grams(word, n))
            if sum(map(len, counts.values())) > 1_000_000:
                yield from _counted(counts)
                counts = {}
        yield from _counted(counts)

    rows = words.select("lang", "entry").mapInArrow(run, "lang string, n int, entry string, count long")
    return rows.groupBy("lang", "n", "entry").agg(F.sum("count").alias("count"))


def _counted(counts: dict[tuple[str, int], Counter]) -> Iterator[pa.RecordBatch]:
    for (lang, n), found in counts.items():
        if found:
            columns = [[lang] * len(found), [n] * len(found), list(found.keys()), list(found.values())]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, kind) for values, kind in zip(columns, kinds)], ["lang", "n", "entry", "count"]
            )


def most_frequent(counts: DataFrame, by: list[str], most: Column) -> DataFrame:
    """The entries of each group above the count at which the group would exceed ``most``.

    Works from the histogram of counts, whose rows are few, so no group is ever
    sorted. Adds ``all_count`` and ``all_entries`` of the group.
    """
    histogram = counts.groupBy(*by, "count").agg(F.count(F.lit(1)).alias("entries"))
    down = Window.partitionBy(*by).orderBy(F.col("count").desc())
    running = histogram.withColumn("at_least", F.sum("entries").over(down))
    floors = stage(
        running.groupBy(*by).agg(
            F.min(F.when(F.col("at_least") <= most, F.col("count"))).alias("floor"),
            F.sum(F.col("count") * F.col("entries")).alias("all_count"),
            F.sum("entries").alias("all_entries"),
        ),
        "floors",
    )
    return counts.join(floors, by).where(F.col("count") >= F.col("floor")).drop("floor")


class Scorer:
    """Log frequencies per language of words (n = 0) and n-grams.

    ``tables`` has the head, ``learned`` (n, entry, scores) has all entries and
    stays with the driver.
    """

    def __init__(self, langs: list[str], head: pa.Table, learned: DataFrame) -> None:
        self.langs, self.learned = langs, learned
        self.tables: dict[int, dict[str, np.ndarray]] = {n: {} for n in range(LONGEST + 1)}
        for n, entry, scores in zip(*[head[c].to_pylist() for c in ("n", "entry", "scores")]):
            self.tables[n][entry] = np.array(scores)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "learned": None}

    def word(self, word: str) -> np.ndarray:
        """The scores of a word as far as the head has them."""
        known = self.tables[0].get(word)
        if known is not None:
            return known
        for _, found, sums, _ in self.parts(word):
            if found:
                return sums / found
        return np.zeros(len(self.langs))

    def parts(self, word: str) -> Iterator[tuple[int, int, np.ndarray, list[str]]]:
        """By length, down to one of which the head has n-grams: their number and sum, and the others."""
        for n in range(LONGEST, 0, -1):
            all_grams = grams(word, n)
            found = [self.tables[n][g] for g in all_grams if g in self.tables[n]]
            yield n, len(found), np.sum(found, axis=0) if found else np.zeros(len(self.langs)), [
                g for g in all_grams if g not in self.tables[n]
            ]
            if found:
                return


def entry_scores(counts: DataFrame) -> tuple[list[str], DataFrame]:
    """The languages, and ``n``, ``entry`` and ``scores`` by language of every entry that one of them has."""
    totals = counts.groupBy("n", "lang").agg(F.sum("count").alias("whole"), F.count(F.lit(1)).alias("distinct")).collect()
    weights = {(r["n"], r["lang"]): r["whole"] + 0.5 * r["distinct"] for r in totals}
    langs = sorted({lang for _, lang in weights})

    def score(lang: str) -> Column:
        by_length = [weights.get((n, lang)) for n in range(LONGEST + 1)]
        own = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("n") + 1)
        never = own([float(np.log(0.5 / w)) if w else 0.0 for w in by_length])
        seen = F.max(F.when(F.col("lang") == lang, F.col("count")))
        return F.coalesce(F.log((seen + 0.5) / own([float(w or 1) for w in by_length])), never)

    scores = F.array(*[score(lang) for lang in langs]).cast("array<double>")
    return langs, counts.groupBy("n", "entry").agg(scores.alias("scores"))


def fit(labelled: DataFrame) -> Scorer:
    """A scorer learned from ``text`` and ``lang`` of all given rows."""
    with staged_tables(labelled.sparkSession) as keep:
        words = stage(word_counts(labelled), "words")
        ngrams = stage(gram_counts(words), "grams")
        langs, scores = entry_scores(words.withColumn("n", F.lit(0)).unionByName(ngrams))
        learned = keep(scores, "learned")
        known = most_frequent(words, ["lang"], F.lit(MOST_WORDS)).withColumn("n", F.lit(0))
        parts = most_frequent(ngrams, ["lang", "n"], F.lit(MOST_GRAMS))
        listed = known.select("n", "entry").unionByName(parts.select("n", "entry")).distinct()
        return Scorer(langs, learned.join(listed, ["n", "entry"]).toArrow(), learned)


def _sums(scores: str, langs: list[str], times: Column | int = 1) -> Column:
    """The sums of arrays with a score per language."""
    return F.array(*[F.sum(F.col(scores)[k] * times) for k in range(len(langs))])


def scores_beyond(words: DataFrame, scorer: Scorer, shared: Shared) -> DataFrame:
    """``word`` and ``scores`` of distinct words beyond the head; none for a word without a known character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.string())]
        names = ["word", "n", "found", "sums", "rest"]
        for batch in slices(batches, "word", 1 << 18):
            rows = [(word, *part) for word in batch.column("word").to_pylist() for part in shared.value.parts(word)]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names)

    own = scorer.learned.where("n = 0").select(F.col("entry").alias("word"), "scores")
    looked_up = stage(words.join(own, "word", "left"), "looked_up")
    parts = stage(
        looked_up.where("scores IS NULL").select("word").mapInArrow(
            run, "word string, n int, found long, sums array<double>, rest array<string>"
        ),
        "parts",
    )
    rest = parts.select("word", "n", F.explode("rest").alias("entry")).join(scorer.learned.where("n > 0"), ["n", "entry"])
    both = parts.select("word", "n", "found", "sums").unionByName(
        rest.select("word", "n", F.lit(1).cast("long").alias("found"), F.col("scores").alias("sums"))
    )
    by_length = both.groupBy("word", "n").agg(F.sum("found").alias("found"), _sums("sums", scorer.langs).alias("sums"))
    longest = by_length.where("found > 0").groupBy("word").agg(F.max_by(F.struct("found", "sums"), "n").alias("best"))
    backed_off = longest.select("word", F.transform("best.sums", lambda x: x / F.col("best.found")).alias("scores"))
    return stage(looked_up.where("scores IS NOT NULL").unionByName(backed_off), "beyond")


def predict(docs: DataFrame, scorer: Scorer, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns, ``lang_pred`` and ``score`` of every row.

    The score is the share of the best language in the likelihood of the whole
    text. A text that is NULL or holds no letter is ``und`` with score 0, and so
    is every text if nothing was learned. Ties go to the first language by name.
    Only ``text`` decides. Rows are independent: repeated rows come out repeated,
    an empty table gives no rows, other columns are not looked at.
    """
    if not scorer.langs:
        return docs.select(*carry, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = Shared(docs.sparkSession, scorer)
    inner = [f"_{k}" for k in range(len(carry))]  # carried names may clash with those used here
    text = inner[carry.index("text")] if "text" in carry else "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, nothing = shared.value.tables[0], np.zeros(len(shared.value.langs))
        for batch in slices(batches, text):
            cut = words_of(batch.column(text))
            words = cut.flatten().dictionary_encode()
            distinct = words.dictionary.to_pylist()
            table = np.array([head.get(w, nothing) for w in distinct]).reshape(len(distinct), len(nothing))
            is_word = np.array([bool(w) for w in distinct])
            beyond = np.array([bool(w) and w not in head for w in distinct])
            number, offsets = words.indices.to_numpy(), cut.offsets.to_numpy()
            # splitting leaves at least one string, so no text is empty here
            sums = np.add.reduceat(table[number], offsets[:-1], axis=0)
            known = np.add.reduceat(is_word[number].astype(int), offsets[:-1]) > 0
            ends = np.arange(len(sums) + 1, dtype=np.int32) * len(nothing)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in inner], batch.column("row"), pa.array(known),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(sums.ravel())),
                    _others(words.dictionary, number, np.diff(offsets), beyond),
                ],
                [*inner, "row", "known", "sums", "others"],
            )

    kinds = "".join(f"{k} {docs.schema[c].dataType.simpleString()}, " for k, c in zip(inner, carry))
    needed = [*[F.col(c).alias(k) for k, c in zip(inner, carry)], *(["text"] if "text" not in carry else [])]
    first = stage(
        docs.select(*needed, F.monotonically_increasing_id().alias("row")).mapInArrow(
            run, f"{kinds}row long, known boolean, sums array<double>, others array<struct<word: string, times: long>>"
        ),
        "head_scores",
    )
    others = first.select("row", F.explode("others").alias("o")).select("row", "o.word", "o.times")
    beyond = scores_beyond(others.select("word").distinct(), scorer, shared)
    more = others.join(beyond, "word").groupBy("row").agg(_sums("scores", scorer.langs, F.col("times")).alias("more"))
    whole = F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "more", lambda a, b: a + b))
    told = first.drop("others").join(more, "row", "left").select(*inner, "known", whole.alias("sums"))
    top = F.array_max("sums")
    best = F.element_at(F.array(*map(F.lit, scorer.langs)), F.array_position("sums", top).cast("int"))
    share = 1 / F.aggregate("sums", F.lit(0.0), lambda total, x: total + F.exp(x - top))
    return told.select(
        *[F.col(k).alias(c) for k, c in zip(inner, carry)],
        F.when(F.col("known"), best).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("known"), share).otherwise(0.0).alias("score"),
    )


def _others(distinct: pa.Array, number: np.ndarray, per_text: np.ndarray, wanted: np.ndarray) -> pa.Array:
    """Per text its wanted words, each once with how many times it stands there."""
    some, size = wanted[number], max(len(distinct), 1)
    text_of = np.repeat(np.arange(len(per_text)), per_text)
    keys, times = np.unique(text_of[some] * size + number[some], return_counts=True)
    of, word = np.divmod(keys, size)
    items = pa.StructArray.from_arrays([distinct.take(pa.array(word)), pa.array(times)], ["word", "times"])
    ends = np.searchsorted(of, np.arange(len(per_text)), side="right")
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), items)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def accepted(docs: DataFrame, scorer: Scorer, least_score: float) -> DataFrame:
    """The documents, all columns as they came, whose language is told with ``least_score`` or more.

    Equal rows are judged once and stay or go together. Texts are looked at where they lie; the
    decisions travel by row key, and what was staged on the way is removed.
    """
    with staged_tables(docs.sparkSession) as keep:
        chosen = keep(_accepted_keys(docs, scorer, least_score), "accepted")
    return every_row(docs, chosen)


def keep_told(docs: DataFrame, least_score: float) -> DataFrame:
    """``accepted`` by what the documents themselves teach, which is removed with the rest."""
    with staged_tables(docs.sparkSession) as keep:
        chosen = keep(_accepted_keys(docs, fit(docs), least_score), "accepted")
    return every_row(docs, chosen)


def _accepted_keys(docs: DataFrame, scorer: Scorer, least_score: float) -> DataFrame:
    found = predict(with_row_key(docs), scorer, carry=tuple(ROW_KEY))
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score))
    return kept.select(*ROW_KEY).distinct()
