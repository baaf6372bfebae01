"""From raw documents to token ids: the stages of a training corpus, one after the other."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.llm import forced_bpe, langid, mixing, simhash, substrings
from cohortspan.llm.texts import documents
from cohortspan.staging import remove, stage_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# A text's language has to carry this share of its likelihood; chance among four languages is 0.25.
LEAST_LANGUAGE_SCORE = 0.4
TOKENIZER = "word_bpe_49k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts without letters or of no clear language go.

    Learns from all documents that state a language. NULL, empty and blank texts go; equal rows
    stay or go together; texts of any length are read whole; no documents give none.
    """
    return langid.keep_told(docs, LEAST_LANGUAGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    NULL and empty texts are copies of each other, as are equal rows; a NULL id comes last.
    """
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that occur more than once.

    NULL stays NULL; equal rows and texts are occurrences of each other, so what they share goes
    from all of them; a text may end up empty.
    """
    return _counted(substrings.without_repeats(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each whole pass over a document and each part of one.

    NULL, empty and blank texts have no words to take; a NULL source is a source; equal rows are taken
    each for itself.
    """
    return _counted(mixing.mixed_documents(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and the text they decode to.

    A row for each row, equal rows included; NULL and empty texts have no ids.
    """
    path = public_tokenizers.path(TOKENIZER)
    done = forced_bpe.encode(docs, path, carry=("doc_id", "lang", "source"), decoded=True)
    return done.withColumn("n_tokens", F.size("ids").cast("long"))


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now."""
    counts = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return docs.withColumns(counts) if counts else docs


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

# The stages learn, hash and tokenize in ways SQL has no words for; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents; each result is written and read back, and goes once the next is written."""
    docs, read = documents(spark, sf_dir), []
    for name, apply in STAGES:
        done, path = apply(spark, docs, sf_dir), stage_path(spark, name)
        done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
        remove(spark, read)
        read = [path]
    return docs
