"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and
one long with a bit per failed rule. A policy is a named set of rules, so any
version of it, and what leaving a rule out would change, follows from the bits
without looking at a text again.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.texts import slices, split_words

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words")

# SQL conditions. A rule's bit is its place in this table. New rules go to the end: bits stay what they were.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "n_symbols > n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "few_letter_words": "2 * n_letter_words < n_words",
}
BASE = ("few_words", "repeated_windows")
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": (*BASE, "many_symbols", "short_words", "long_words", "duplicate_lines"),
    "v3": (*BASE, "many_symbols", "short_words", "long_words", "duplicate_lines", "few_letter_words"),
}
CURRENT = "v3"


def mask(rules: Sequence[str]) -> int:
    return sum(1 << list(RULES).index(rule) for rule in rules)


def _repeated(number: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Marks the words in windows whose words stand twice or more in their document.

    Numbers for 2, 4 and 8 consecutive words are made by pairing numbers, so
    equal numbers mean equal words, not merely equal hashes.
    """
    marked = np.zeros(len(number), bool)
    if len(number) < WINDOW:
        return marked
    run, size = number.astype(np.int64), 1
    while size < WINDOW:
        pair = run[:-size] * (int(run.max()) + 1) + run[size:]
        run = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        size *= 2
    inside = doc[: len(run)] == doc[WINDOW - 1:]
    starts = np.flatnonzero(inside)
    own = doc[starts].astype(np.int64) * (int(run.max()) + 1) + run[starts]
    _, which, counts = np.unique(own, return_inverse=True, return_counts=True)
    again = starts[counts[which] > 1]
    change = np.zeros(len(number) + 1, np.int64)
    np.add.at(change, again, 1)
    np.add.at(change, again + WINDOW, -1)
    return np.cumsum(change)[:-1] > 0


def _lines(text: str | None) -> tuple[int, int]:
    """Lines with a word, and those of them that repeat an earlier line."""
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
    return len(lines), len(lines) - len(set(lines))


def _measured(texts: pa.Array) -> list[np.ndarray]:
    texts = pc.fill_null(texts, "")
    words, counts = split_words(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    coded = words.dictionary_encode()
    letters = pc.match_substring_regex(coded.dictionary, r"\p{L}").to_numpy(zero_copy_only=False)
    number = coded.indices.to_numpy()
    per_doc = lambda weight: np.bincount(doc, weight, len(texts)).astype(np.int64)
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    symbols = pc.binary_length(texts).to_numpy() - pc.binary_length(
        pc.replace_substring_regex(texts, "[" + SYMBOLS.decode() + "]", "")
    ).to_numpy()
    lines = np.array([_lines(t) for t in texts.to_pylist()], np.int64).reshape(-1, 2)
    return [
        per_doc(None), per_doc(sizes), symbols.astype(np.int64), lines[:, 0], lines[:, 1],
        per_doc(_repeated(number, doc)), per_doc(letters[number]),
    ]


def measure(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns and ``MEASURES`` of every whole text; NULL text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = _measured(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *[pa.array(x, pa.int64()) for x in found]], [*carry, *MEASURES]
            )

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry] + [f"{m} long" for m in MEASURES]
    return docs.select(*carry, "text").mapInArrow(run, ", ".join(kinds))


def ledger(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measurements and ``fail_bits`` of every document.

    A text without words fails ``few_words`` and no rule about shares. Rows are
    independent: repeated rows come out repeated, an empty table gives no rows,
    other columns are not looked at. Memory follows the longest text.
    """
    bits = F.lit(0).cast("long")
    for bit, failed in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, carry).withColumn("fail_bits", bits)


def fails(policy: Sequence[str]) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) != 0


def apply_policies(rows: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES) -> DataFrame:
    """Add ``kept_<version>`` for every version of the policy."""
    return rows.withColumns({f"kept_{name}": ~fails(rules) for name, rules in policies.items()})


def ablations(rows: DataFrame, policy: Sequence[str]) -> DataFrame:
    """Per rule of the policy: documents it fails, fails alone, and kept if it is left out.

    Documents are counted by their bits first, at most two to the number of rules.
    """
    counts = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    whole = mask(policy)
    cases = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(mask([rule])).cast("long").alias("bit")) for rule in policy
    ])
    by_rule = counts.withColumn("case", F.explode(cases)).select("case.rule", "case.bit", "fail_bits", "n")
    among = F.col("fail_bits").bitwiseAND(F.lit(whole).cast("long"))
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))
    return by_rule.groupBy("rule").agg(
        total(among.bitwiseAND(F.col("bit")) != 0).alias("failed"),
        total(among == F.col("bit")).alias("failed_alone"),
        total(among.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("kept_without"),
    )
