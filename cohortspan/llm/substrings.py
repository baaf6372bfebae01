"""Removing passages that occur more than once, with repeated-phrase automata.

A window is ``window`` consecutive words. A word goes if a window over it occurs
anywhere else too.

1. Anchors. Of the phrases in a window the one with the smallest hash is its
   anchor. It depends on the window's words alone, so equal windows have equal
   anchors, and neighbouring windows mostly share one: there are about as many
   anchors as two in every ``window - phrase`` words.
2. Confirming. Only stretches around anchors that occur twice go on. They are spread
   over shards by their anchor, so a shard has all windows of its anchors, and those
   found twice in it, by anchor and hash, 128 bits together, recur. An anchor with
   more stretches than a shard should hold has its windows counted by Spark instead,
   and they and its stretches are split over several shards.
3. Automata. Each shard compiles the anchor phrases of its recurring windows into an
   Aho-Corasick automaton over words and streams its stretches through it. Around every phrase
   that the automaton reports, the windows of that phrase that recur are looked up and
   compared word for word; these are removed. Of each text, the stretches around anchors that
   occur twice take part; elsewhere it cannot hold a window that occurs twice.
4. Removing. A text's marked stretches are put together and the words removed.

Equal texts are handled once, with their number as weight. The texts are written
once in buckets by key, so that joining stretches or spans to them moves only
those. Crowded shards are split: windows into parts, stretches over salts. What
a step leaves on disk is removed once the next has used it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.texts import as_bytes, runs, slices, split_words
from cohortspan.staging import stage, stage_path, staged_tables

WINDOW = 35
PHRASE = 8
SHARD_WINDOWS = 100_000
SHARD_STRETCHES = 40_000
BASE = 0x9E3779B97F4A7C15  # odd, so that no information is lost by multiplying
DIGITS = 3


def rolled(values: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of every run of ``size`` values."""
    power = lambda n: np.uint64(pow(BASE, n, 1 << 64))
    count = len(values) - size + 1
    found, at, block, width = np.zeros(count, np.uint64), 0, values, 1
    while width <= size:
        if size & width:
            found += power(at) * block[at:at + count]
            at += width
        block = block[:-width] + power(width) * block[width:]
        width *= 2
    return found


def mixed(values: np.ndarray) -> np.ndarray:
    """The hashes with their bits stirred, so that the smallest is a fair pick."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        values = (values ^ (values >> np.uint64(shift))) * np.uint64(factor)
    return values ^ (values >> np.uint64(31))


def places_of_least(values: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` values the place of its smallest one, the first of equal ones."""
    least, place, size = values, np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        later = least[step:] < least[:-step]
        place = np.where(later, place[step:], place[:-step])
        least = np.where(later, least[step:], least[:-step])
        size += step
    return place


def word_hashes(words: pa.Array, seed: int) -> np.ndarray:
    coded = words.dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    table = np.fromiter(map(xxhash.xxh64_intdigest, distinct, repeat(seed)), np.uint64, len(distinct))
    return table[coded.indices.to_numpy()]


def _anchors(window: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, counts = split_words(batch.column("text"))
            if len(words) < window:
                continue
            text_of = np.repeat(np.arange(len(counts)), counts)
            phrases = mixed(rolled(word_hashes(words, 0), phrase))
            inside = np.flatnonzero(text_of[: len(words) - window + 1] == text_of[window - 1:])
            anchor = places_of_least(phrases, window - phrase + 1)[inside]
            new = np.ones(len(inside), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (text_of[inside[1:]] != text_of[inside[:-1]])
            first = np.flatnonzero(new)
            last = np.concatenate((first[1:], [len(inside)])) - 1
            of = text_of[inside[first]]
            begin = (np.cumsum(counts) - counts)[of]
            columns = [
                pa.array(phrases[anchor[first]].view(np.int64)), batch.column("key").take(pa.array(of)),
                pa.array((inside[first] - begin).astype(np.int32)), pa.array((inside[last] - begin).astype(np.int32)),
                pa.array((anchor[first] - inside[first]).astype(np.int32)),
                batch.column("copies").take(pa.array(of)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "key", "first", "last", "phrase", "copies"])

    return run


def _stretches(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = batch.column("found")
            anchor, first, last, place = (x.to_numpy() for x in found.flatten().flatten())
            words, counts = split_words(batch.column("text"))
            row = b" ".join(words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())
            ends = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1) - 1
            of = np.repeat(np.arange(len(counts)), pc.list_value_length(found).to_numpy())
            begin = (np.cumsum(counts) - counts)[of]
            start, stop = np.concatenate(([0], ends + 1))[begin + first], ends[begin + last + window - 1]
            for low in range(0, len(of), 20_000):
                some = slice(low, low + 20_000)
                parts = [row[a:b] for a, b in zip(start[some].tolist(), stop[some].tolist())]
                rows = pa.array(of[some])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor[some]), batch.column("key").take(rows), pa.array(first[some]), pa.array(place[some]),
                        batch.column("copies").take(rows), pa.array(parts, pa.binary()).cast(pa.string()),
                    ],
                    ["anchor", "key", "first", "phrase", "copies", "words"],
                )

    return run


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, kind) for values, kind in zip(zip(*rows), schema.types)], schema.names
    )


def window_hashes(words: pa.Array, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every window that lies in one text, its text's number and its first word's place among all."""
    text_of = np.repeat(np.arange(len(counts)), counts)
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, int), np.zeros(0, int)
    inside = np.flatnonzero(text_of[: len(words) - window + 1] == text_of[window - 1:])
    return rolled(word_hashes(words, 1), window)[inside].view(np.int64), text_of[inside], inside


def split_joined(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``split_words`` of stretches, which are words joined by one blank."""
    cut = pc.split_pattern(texts, " ")
    return cut.flatten(), np.diff(cut.offsets.to_numpy())


def joined(anchor: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Anchor and window hash in one number, to look both up at once."""
    return mixed(anchor.view(np.uint64)) ^ window.view(np.uint64)


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "words"):
            hashes, of, _ = window_hashes(*split_joined(batch.column("words")), window)
            rows = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [batch.column("anchor").take(rows), pa.array(hashes), batch.column("copies").take(rows)],
                ["anchor", "hash", "copies"],
            )

    return run


def compiled(phrases: list[str]) -> ahocorasick.Automaton:
    """An Aho-Corasick automaton over words, each word being ``DIGITS`` characters to it; it reports a phrase's place in the list."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, phrase in enumerate(phrases):
        automaton.add_word(phrase, k)
    automaton.make_automaton()
    return automaton


def as_characters(number: np.ndarray, distinct: int, begins: np.ndarray, used: np.ndarray) -> str:
    """All stretches in a row, ``DIGITS`` characters a word and a sign before each; words that are not ``used`` share a sign.

    An automaton looks a character up among those that may follow, one by one, so few characters make it fast. The
    digits of a word have ranges of their own, so what is found begins with a word.
    """
    base = int(len(used) ** (1 / DIGITS)) + 1
    sign = np.full((distinct + 1, DIGITS), DIGITS * base, "<u4")
    for k in range(DIGITS):
        sign[used, k] = np.arange(len(used)) // base**k % base + k * base
    return sign[np.insert(number, begins, distinct)].tobytes().decode("utf-32-le")


def located(
    row: str, places: np.ndarray, begins: np.ndarray, of: np.ndarray, phrase: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the phrases at ``places`` of stretches ``of`` occur anywhere in the row, in which stretch, and which it is."""
    at = (places + of + 1).tolist()  # the row has a sign more before each stretch
    automaton = compiled([row[k * DIGITS:(k + phrase) * DIGITS] for k in at])
    hits = np.fromiter(chain.from_iterable(automaton.iter(row)), np.int64).reshape(-1, 2)
    end = hits[:, 0] // DIGITS
    stretch = np.searchsorted(begins + np.arange(len(begins)), end, side="right") - 1
    return end - phrase - stretch, stretch, hits[:, 1]


def same_words(number: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """Whether the windows at ``a`` and at ``b`` are the same word for word. Words that neighbours share are compared once."""
    same = a == b
    other = np.flatnonzero(~same)
    for low in range(0, len(other), 1 << 15):
        left = other[low:low + (1 << 15)]
        x, y = a[left], b[left]
        first, stop = runs(x - np.arange(len(x)), y - np.arange(len(y)))
        each = stop - first + window - 1  # words
        begin = np.cumsum(each) - each
        within = np.arange(each.sum()) - np.repeat(begin, each)
        differ = number[np.repeat(x[first], each) + within] != number[np.repeat(y[first], each) + within]
        total = np.concatenate(([0], np.cumsum(differ)))
        at = np.arange(len(left)) + np.repeat(begin - first, stop - first)
        same[left] = total[at + window] == total[at]
    return same


def kinds(keys: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """A number for each key found twice, the same for equal ones; -1 for others. A key of ``copies`` counts as often."""
    order = np.argsort(keys)
    begin, end = runs(keys[order])
    kind = np.arange(len(begin))
    if len(begin):
        kind[np.add.reduceat(copies[order], begin) < 2] = -1
    out = np.empty(len(keys), int)
    out[order] = np.repeat(kind, end - begin)
    return out


def shard_spans(shard: pa.Table, window: int, phrase: int) -> pa.RecordBatch | None:
    """The stretches of a shard that recurring windows cover.

    Rows with a ``hash`` are recurring windows, the others stretches. Without the former, the windows found twice in
    these stretches recur. The phrases that anchor recurring windows
    make the automaton, and all stretches are streamed through it. Where it reports the phrase that anchors a
    stretch, the windows around that place are looked up among the recurring windows of this very phrase, and one that
    is found is compared word for word with the first of its kind. Around other phrases there is nothing to look up, as
    all windows of a stretch have one anchor.
    """
    known = shard.filter(shard["hash"].is_valid())
    stretches = shard.filter(shard["hash"].is_null()).combine_chunks()
    if not stretches.num_rows:
        return None
    anchor = stretches["anchor"].to_numpy()
    words, counts = split_joined(stretches["words"].combine_chunks())
    begins = np.cumsum(counts) - counts
    coded = words.dictionary_encode()
    number = coded.indices.to_numpy()
    hashes, of, inside = window_hashes(coded, counts, window)
    keys = joined(anchor[of], hashes)
    if known.num_rows:
        both = np.unique(joined(known["anchor"].to_numpy(), known["hash"].to_numpy()))
        slot = np.minimum(np.searchsorted(both, keys), len(both) - 1)
        kind = np.where(both[slot] == keys, slot, -1)
    else:
        kind = kinds(keys, stretches["copies"].to_numpy()[of])
    recurs = np.flatnonzero(kind >= 0)
    if not len(recurs):
        return None
    first = np.zeros(kind.max() + 1, int)  # window of each kind
    first[kind[recurs[::-1]]] = recurs[::-1]

    # phrases of recurring windows, from a stretch that holds each
    holds = np.unique(of[recurs])
    wanted, at = np.unique(anchor[holds], return_index=True)
    places = begins + stretches["phrase"].to_numpy()
    origin = holds[at]
    used = np.unique(number[places[origin, None] + np.arange(phrase)])
    row = as_characters(number, len(coded.dictionary), begins, used)
    at, stretch, which = located(row, places[origin], begins, origin, phrase)
    own = np.flatnonzero((at == places[stretch]) & (wanted[which] == anchor[stretch]))
    at, stretch = at[own], stretch[own]

    number_of = np.zeros(len(words), np.int64)  # of the window that begins at a word
    number_of[inside] = np.arange(len(inside))
    # the windows of a stretch that hold the phrase found in it
    low = np.maximum(at - (window - phrase), begins[stretch])
    high = np.minimum(at, begins[stretch] + counts[stretch] - window)
    each = np.maximum(high - low + 1, 0)
    begin = number_of[np.repeat(low - (np.cumsum(each) - each), each) + np.arange(each.sum())]
    begin = begin[kind[begin] >= 0]
    start = inside[begin]
    start = start[same_words(number, start, inside[first[kind[begin]]], window)]
    if not len(start):
        return None
    of = np.searchsorted(begins, start, side="right") - 1
    start = start - begins[of]
    new = np.ones(len(start), bool)
    new[1:] = (of[1:] != of[:-1]) | (start[1:] > start[:-1] + window)
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(start)])) - 1
    offset = stretches["first"].to_numpy()[of[first]]
    return pa.RecordBatch.from_arrays(
        [
            stretches["key"].combine_chunks().take(pa.array(of[first])),
            pa.array((offset + start[first]).astype(np.int32)),
            pa.array((offset + start[last] + window).astype(np.int32)),
        ],
        ["key", "from", "to"],
    )


def _locate(window: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            ids = [batch.column(c).to_numpy() for c in ("shard", "part", "salt")]
            for start, stop in zip(*runs(*ids)):
                shard = tuple(int(x[start]) for x in ids)
                if shard != current and held:
                    if (spans := shard_spans(pa.Table.from_batches(held), window, phrase)) is not None:
                        yield spans
                    held = []
                current = shard
                held.append(batch.slice(start, stop - start))
        if held and (spans := shard_spans(pa.Table.from_batches(held), window, phrase)) is not None:
            yield spans

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for key, text, spans in zip(
            batch.column("key").to_pylist(), as_bytes(batch.column("text")), batch.column("spans").to_pylist()
        ):
            words = text.split()
            kept, at = [], 0
            for a, b in sorted((s["from"], s["to"]) for s in spans or []):
                kept += words[at:a]
                at = max(at, b)
            kept += words[at:]
            rows.append((key, len(words), len(words) - len(kept), b" ".join(kept).decode()))
        yield _rows(rows, RESULT)


RESULT = pa.schema([("key", pa.binary()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def text_key(text: Column) -> Column:
    """128 bits of a text's SHA-256: equal for equal texts only."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _bucketed(df: DataFrame, buckets: int) -> tuple[DataFrame, str]:
    """The table written in buckets by ``key``, and its name in the catalog."""
    name = f"texts_{uuid.uuid4().hex}"
    path = stage_path(df.sparkSession, "texts")
    df.write.option("path", path).option("compression", "zstd").bucketBy(buckets, "key").saveAsTable(name)
    return df.sparkSession.table(name), name


ROWS = ["shard", "part", "salt", "anchor", "hash", "key", "first", "phrase", "copies", "words"]


def repeated_windows(texts: DataFrame, window: int, phrase: int) -> DataFrame:
    """``key``, ``from`` and ``to`` of stretches of words covered by recurring windows."""
    anchors = stage(
        texts.mapInArrow(
            _anchors(window, phrase), "anchor long, key binary, first int, last int, phrase int, copies long"
        ),
        "anchors",
    )
    counted = anchors.groupBy("anchor").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("stretches"))
    crowded = (F.col("stretches") > SHARD_STRETCHES).alias("crowded")
    twice = stage(counted.where("n > 1").select("anchor", "stretches", crowded), "twice")
    total = {r["crowded"]: r["n"] for r in twice.groupBy("crowded").agg(F.sum("stretches").alias("n")).collect()}

    def stretches(some: DataFrame) -> DataFrame:
        found = anchors.drop("copies").join(some.select("anchor"), "anchor").groupBy("key").agg(
            F.collect_list(F.struct("anchor", "first", "last", "phrase")).alias("found")
        )
        return texts.join(found.hint("shuffle_hash"), "key").mapInArrow(
            _stretches(window), "anchor long, key binary, first int, phrase int, copies long, words string"
        )

    shards = -(-2 * total.get(False, 0) // SHARD_STRETCHES) or 1  # half full, as anchors come in lumps
    rows = stretches(twice.where("not crowded")).withColumns({
        "shard": F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int"), "part": F.lit(0), "salt": F.lit(0),
        "hash": F.lit(None).cast("long"),
    }).select(*ROWS)
    if True in total:
        few = stage(twice.where("crowded"), "crowded")  # small, so the anchors need no shuffle for them
        rows = rows.unionByName(crowded_rows(stretches(few), shards, window))
    place = ["shard", "part", "salt"]
    return rows.repartition(*place).sortWithinPartitions(*place).mapInArrow(
        _locate(window, phrase), "key binary, from int, to int"
    )


def crowded_rows(stretches: DataFrame, others: int, window: int) -> DataFrame:
    """Recurring windows and stretches of anchors too frequent for one shard, spread over shards that follow the ``others``."""
    stretches = stage(stretches, "stretches")
    windows = stretches.select("anchor", "words", "copies").mapInArrow(
        _windows(window), "anchor long, hash long, copies long"
    )
    recurring = stage(
        windows.groupBy("anchor", "hash").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor", "hash"),
        "recurring",
    )
    shards = -(-recurring.count() // SHARD_WINDOWS) or 1
    shard = (F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int") + others).alias("shard")
    count = lambda df, name: df.groupBy(shard).agg(F.count(F.lit(1)).alias(name))
    sizes = stage(
        count(recurring, "windows").join(count(stretches, "stretches"), "shard").select(
            "shard",
            F.ceil(F.col("windows") / SHARD_WINDOWS / 2).cast("int").alias("parts"),
            F.ceil(F.col("stretches") / SHARD_STRETCHES).cast("int").alias("salts"),
        ),
        "shards",
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one_of = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    as_windows = recurring.select("*", shard).join(sizes, "shard").withColumns(
        {
            "part": one_of("parts", "hash"), "key": none("binary"), "first": none("int"), "phrase": none("int"),
            "copies": none("long"), "words": none("string"),
        }
    ).withColumn("salt", every("salts"))
    as_stretches = stretches.select("*", shard).join(sizes, "shard").withColumns(
        {"salt": one_of("salts", "key", "first"), "hash": none("long")}
    ).withColumn("part", every("parts"))
    return as_windows.select(*ROWS).unionByName(as_stretches.select(*ROWS))


def dedup_texts(docs: DataFrame, window: int, phrase: int, changed_only: bool) -> DataFrame:
    """Per distinct text its ``key``, ``n_words``, ``n_removed`` and the SHA-256 of what is kept.

    With ``changed_only`` only the texts of which something is removed, and what is
    kept of them itself, words joined by one blank, as ``kept``.
    """
    if not 0 < window - phrase < 32:
        raise ValueError("a phrase is shorter than the window, by 31 words at most")
    spark = docs.sparkSession
    with staged_tables(spark) as kept:
        copies = (
            docs.where(F.col("text").isNotNull())
            .select(text_key(F.col("text")).alias("key"), "text")
            .groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
        )
        texts, name = _bucketed(copies, int(spark.conf.get("spark.sql.shuffle.partitions")))
        with staged_tables(spark) as kept_spans:
            spans = kept_spans(
                repeated_windows(texts, window, phrase).groupBy("key").agg(
                    F.collect_list(F.struct("from", "to")).alias("spans")
                ),
                "spans",
            )
        joined = texts.join(spans.hint("shuffle_hash"), "key", "left").select("key", "text", "spans")
        done = joined.mapInArrow(_kept, "key binary, n_words long, n_removed long, kept string")
        if changed_only:
            done = kept(done.where("n_removed > 0"), "changed")
        else:
            done = kept(done.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept"), "deduplicated")
        spark.sql(f"DROP TABLE {name}")
    return done


def dedup(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """Per document doc_id, n_words, n_removed and kept_sha256.

    NULL text counts as empty. Repeated rows and equal texts count as occurrences
    of each other, so a text of ``window`` words or more that comes twice goes
    whole. Shorter texts stay whole. An empty table gives no rows, other columns
    are not looked at.
    """
    done = dedup_texts(docs, window, phrase, changed_only=False)
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("key"))
    nothing = F.sha2(F.lit(""), 256)
    return keyed.join(done, "key", "left").select(
        "doc_id",
        F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", nothing).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """The documents, all columns as they came, with repeated passages removed from their texts.

    A text of which nothing is removed stays as it is, line breaks included.
    """
    done = dedup_texts(docs, window, phrase, changed_only=True)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    changed = docs.select(own, text_key(F.col("text")).alias("key")).join(done, "key", "left")
    return changed.select(*[F.coalesce("kept", "own.text").alias(c) if c == "text" else F.col(f"own.`{c}`") for c in docs.columns])
