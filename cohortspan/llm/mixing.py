"""Mixing sources to target weights, in DataFrame operations only.

A source's target is its share of the total by weight, at most ``most`` times its
size; what it cannot take goes to the others by weight. Each source's documents
are spread over shards of a few thousand, and a shard's words, its documents in
seeded order, form blocks of an equal number of words. Sainte-Lague quotients
(weight over 1, 3, 5, ...) hand out the blocks: first to sources by their
targets, then each source's to its shards, the highest quotients winning. A
shard takes whole passes over its blocks as often as its quota allows and then
as many blocks as are left, from a seeded start on. As the documents' order is
seeded, this is a random pick that keeps documents in one piece, and where a
document lies among the words tells what is taken of it: no row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspan.llm.prefix import running_totals
from cohortspan.llm.rows import ROW_KEY, pick_rows, with_row_key
from cohortspan.llm.texts import BREAKS, count_words
from cohortspan.staging import stage, staged_tables

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 16
SHARD_DOCS = 4096
SEED = 42


def source_key(source: Column) -> Column:
    """A source as a key that is never NULL."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def targets(
    sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """Add ``target`` to one row per source with ``source`` and ``source_size``.

    Sources by code point, NULL last, get the weights in turn. Filling starts
    with the sources that are full first; the level at which the rest shares what
    is left is the highest one met on the way.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighted = stage(
        running_totals(sources, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
        .withColumn("weight", F.element_at(cycle, (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")))
        .withColumn("full", F.lit(most) * F.col("source_size"))
        .withColumn("full_at", F.col("full") / F.col("weight"))
        .drop("rank"),
        "weighted",
    )
    filled = stage(
        running_totals(
            weighted, [F.col("full_at"), F.col("key")],
            {"full_before": F.col("full"), "weight_before": F.col("weight")},
        ),
        "filled",
    )
    whole = weighted.agg((F.sum("source_size") * share).alias("words"), F.sum("weight").alias("weight"))
    whole = stage(whole, "whole")
    level = stage(
        filled.agg(
            F.max(
                (whole.select("words").scalar() - F.col("full_before"))
                / (whole.select("weight").scalar() - F.col("weight_before"))
            ).alias("level")
        ),
        "level",
    )
    target = F.least(F.col("full").cast("double"), level.scalar() * F.col("weight"))
    return filled.withColumn("target", F.coalesce(target, F.lit(0.0))).drop("full_before", "weight_before")


def apportion(parts: DataFrame, group: str, part: str) -> DataFrame:
    """Add ``seats``: the group's ``group_seats`` handed out by Sainte-Lague quotients.

    ``parts`` has one row per ``group`` and ``part`` with ``votes`` (double) and
    ``group_seats`` (long). Rounding the exact shares gives nearly all seats; only
    the few quotients around the last seat, no more than about three per part in
    all, are ranked. Ties go to the smaller ``part``.
    """
    votes = F.col("votes")
    sums = parts.groupBy(group).agg(
        F.sum("votes").alias("all_votes"), F.count(F.lit(1)).alias("parts"), F.max("group_seats").alias("goal")
    )
    exact = F.when(F.col("all_votes") > 0, votes / F.col("all_votes") * F.col("goal")).otherwise(F.lit(0.0))
    rounded = stage(
        parts.join(sums, group).withColumn("share", exact)
        .withColumn("base", F.floor(F.col("share") + 0.5).cast("long")),
        "rounded",
    )
    gaps = rounded.groupBy(group).agg(
        (F.max("goal") - F.sum("base")).alias("gap"), F.sum("base").alias("based")
    )
    open_groups = stage(gaps.where("gap <> 0 and based + gap > 0"), "gaps")
    reach = F.ceil(F.when(F.col("all_votes") > 0, votes / F.col("all_votes")).otherwise(F.lit(0.0))
                   * (F.abs("gap") + F.col("parts"))) + 1
    seat = F.when(
        F.col("gap") > 0, F.sequence(F.col("base"), F.col("base") + reach)
    ).when(
        F.col("base") > 0, F.sequence(F.greatest(F.lit(0), F.col("base") - reach - 1), F.col("base") - 1)
    )
    candidates = (
        rounded.join(open_groups, group).where(votes > 0)
        .withColumn("seat", F.explode(seat))
        .withColumn("quotient", votes / (2 * F.col("seat") + 1))
        # seats to add: the highest quotients; seats to take back: the lowest
        .withColumn("place", F.when(F.col("gap") > 0, -F.col("quotient")).otherwise(F.col("quotient")))
        .withColumn("tie", F.when(F.col("gap") > 0, F.col("seat")).otherwise(-F.col("seat")))
        .select(group, part, "gap", "place", "tie")
    )
    ranked = stage(
        running_totals(candidates, [F.col(group), F.col("place"), F.col(part), F.col("tie")], {"rank": F.lit(1)}),
        "ranked",
    )
    firsts = ranked.groupBy(group).agg(F.min("rank").alias("first"))
    changes = (
        ranked.join(firsts, group).where(F.col("rank") - F.col("first") < F.abs("gap"))
        .groupBy(group, part).agg(F.sum(F.signum("gap")).cast("long").alias("change"))
    )
    return (
        rounded.join(changes, [group, part], "left")
        .withColumn("seats", F.col("base") + F.coalesce("change", F.lit(0)))
        .select(*parts.columns, "seats")
    )


def _edge(block: Column) -> Column:
    """First word of a block: blocks of a shard differ by one word at most."""
    words, blocks = F.col("shard_words"), F.col("blocks")
    return block * F.call_function("div", words, blocks) + F.call_function("div", block * (words % blocks), blocks)


def _overlap(start: Column, stop: Column) -> tuple[Column, Column]:
    """The document's words, counted from 0 within it, that lie in [start, stop)."""
    low = F.greatest(start, F.col("place")) - F.col("place")
    high = F.least(stop, F.col("place") + F.col("size")) - F.col("place")
    return F.when(low < high, low).otherwise(F.lit(0)), F.when(low < high, high).otherwise(F.lit(0))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    block_words: int = BLOCK_WORDS,
    seed: int = SEED,
    carry: Sequence[str] = (),
) -> DataFrame:
    """What the mix takes of each document.

    Returns doc_id, the ``carry`` columns, size, source_size, target, taken, and
    the pieces taken: ``passes`` times the whole document and the word ranges
    [from_1, to_1) and [from_2, to_2). No document is taken more than ``most``
    times. NULL text has size 0 and a NULL source is a source; repeated rows are
    documents of their own. Without any word all targets are 0, an empty table
    gives no rows. Reruns agree: every choice follows from doc_id, size and seed.
    """
    sized = stage(
        docs.select(
            "doc_id", *carry, F.col("source").alias("__source"), count_words(F.col("text")).alias("size")
        ).withColumn("key", source_key(F.col("__source"))),
        "sized",
    )
    sources = stage(
        sized.groupBy("key").agg(
            F.min("__source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")
        ),
        "sources",
    )
    sources = stage(targets(sources, weights, share, most), "targets")
    spread = F.ceil(F.col("docs") / SHARD_DOCS).cast("long")
    by_source = sources.select("key", "source_size", "target", spread.alias("shards"))
    dealt = stage(
        sized.join(by_source, "key")
        .withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("shards")))
        .drop("shards"),
        "dealt",
    )
    shards = dealt.groupBy("key", "shard").agg(F.sum("size").alias("shard_words"))
    blocks = F.greatest(F.round(F.col("shard_words") / block_words).cast("long"), F.lit(1))
    shards = stage(shards.where("shard_words > 0").withColumn("blocks", blocks), "shards")

    # blocks to hand out: each source's target in blocks, rounded in all
    votes = shards.groupBy("key").agg(F.sum("blocks").alias("source_blocks")).join(sources, "key")
    votes = stage(
        votes.select("key", (F.col("target") / F.col("source_size") * F.col("source_blocks")).alias("votes"))
        .withColumn("all", F.lit(0)),
        "votes",
    )
    goal = stage(votes.agg(F.round(F.sum("votes")).cast("long").alias("goal")), "goal")
    source_seats = stage(apportion(votes.withColumn("group_seats", goal.scalar()), "all", "key"), "source_seats")
    quotas = apportion(
        shards.withColumn("votes", F.col("blocks").cast("double"))
        .join(source_seats.select("key", F.col("seats").alias("group_seats")), "key"),
        "key", "shard",
    ).withColumn("quota", F.least(F.col("seats"), most * F.col("blocks")))
    quotas = stage(quotas.select("key", "shard", "shard_words", "blocks", "quota"), "quotas")

    order = Window.partitionBy("key", "shard").orderBy(
        F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size"
    ).rowsBetween(Window.unboundedPreceding, -1)
    passes = F.call_function("div", F.col("quota"), F.col("blocks"))
    start = F.pmod(F.xxhash64(F.lit(seed + 2), "key", "shard"), F.col("blocks"))
    laid = (
        dealt.withColumn("place", F.coalesce(F.sum("size").over(order), F.lit(0)))
        .join(quotas, ["key", "shard"], "left")
        .withColumn("passes", F.coalesce(passes, F.lit(0)))
        .withColumn("start", start)
        .withColumn("stop", F.col("start") + F.col("quota") % F.col("blocks"))
    )
    wrapped = F.col("stop") > F.col("blocks")
    from_1, to_1 = _overlap(_edge(F.col("start")), _edge(F.least("stop", "blocks")))
    from_2, to_2 = _overlap(F.lit(0), F.when(wrapped, _edge(F.col("stop") - F.col("blocks"))).otherwise(F.lit(0)))
    pieces = {"from_1": from_1, "to_1": to_1, "from_2": from_2, "to_2": to_2}
    return laid.withColumns(pieces).withColumn(
        "taken", F.col("passes") * F.col("size") + F.col("to_1") - F.col("from_1") + F.col("to_2") - F.col("from_2")
    ).select("doc_id", *carry, "size", "source_size", "target", "taken", "passes", *pieces)


def mixed_documents(docs: DataFrame, **settings: object) -> DataFrame:
    """The mix as documents, in the columns they came with.

    A document taken in whole passes comes once per pass with its text as it is,
    and each range taken of it beside comes as a row with that part of the text.
    Documents of which nothing is taken go, and those without words.
    """
    pieces = ("passes", "from_1", "to_1", "from_2", "to_2")
    with staged_tables(docs.sparkSession) as kept:
        taken = mix(with_row_key(docs), carry=ROW_KEY, **settings).groupBy(*ROW_KEY).agg(
            F.count(F.lit(1)).alias("rows"),
            F.collect_list(F.when(F.col("taken") > 0, F.struct(*pieces))).alias("pieces"),
        )
        chosen = kept(taken.where(F.size("pieces") > 0), "taken")
    words = F.regexp_extract_all(F.col("own.text"), F.lit(f"([^{BREAKS}]+[{BREAKS}]*)"), F.lit(1))
    part = lambda a, b: F.array_join(F.slice(words, a.cast("int") + 1, (b - a).cast("int")), "")
    copies = F.transform("pieces", lambda p: F.concat(
        F.array_repeat(F.col("own.text"), p["passes"].cast("int")),
        *[
            F.when(p[b] > p[a], F.array(part(p[a], p[b]))).otherwise(F.array().cast("array<string>"))
            for a, b in (("from_1", "to_1"), ("from_2", "to_2"))
        ],
    ))
    rows = pick_rows(docs, chosen).select("own", F.explode(F.flatten(copies)).alias("copy"))
    return rows.select(*[F.col("copy").alias("text") if c == "text" else F.col(f"own.`{c}`") for c in docs.columns])
