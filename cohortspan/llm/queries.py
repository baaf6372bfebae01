"""The operators over their whole tables, with the columns the contract fixes."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.llm import (
    caps, chat, forced_bpe, interactions, langid, ledger, linededup, logbilinear, mixing, resampling, simhash, substrings,
    tokenfiles,
)
from cohortspan.llm.texts import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


@query
def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(documents(spark, sf_dir))


ORACLES["op2_substrings"] = r"""
WITH texts AS (
    SELECT row_number() OVER () AS row_no, doc_id,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), starts AS (
    SELECT row_no, i, array_to_string(words[i:i + 34], ' ') AS win
    FROM texts, generate_series(1, len(words) - 34) g(i)
), again AS (
    SELECT row_no, i FROM starts WHERE win IN (SELECT win FROM starts GROUP BY win HAVING count(*) > 1)
), covered AS (
    SELECT DISTINCT row_no, i + k AS i FROM again, generate_series(0, 34) s(k)
), gone AS (
    SELECT row_no, list(i) AS removed FROM covered GROUP BY row_no
), kept AS (
    SELECT row_no, doc_id, words, coalesce(len(removed), 0) AS n,
           list_filter(words, lambda w, i: removed IS NULL OR NOT list_contains(removed, i)) AS rest
    FROM texts LEFT JOIN gone USING (row_no)
)
SELECT doc_id, len(words)::BIGINT AS n_words, n::BIGINT AS n_removed,
       sha256(array_to_string(rest, ' ')) AS kept_sha256
FROM kept
"""


@query
def op3_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    done = forced_bpe.encode(documents(spark, sf_dir), path, decoded=True)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op4_logbilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return logbilinear.score(docs.withColumn("held_out", langid.fold(F.col("doc_id"), 7) == 2))


@query
def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn(
        "held_out", langid.fold(F.col("doc_id"), 4) == 2
    )
    scorer = langid.fit(docs.where("not held_out"))
    return langid.predict(docs, scorer, carry=("doc_id", "held_out"))


@query
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"),
    )
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    done = chat.format_chats(rows.unionByName(own))
    turns, loss = chat.read_turns(F.col("formatted")), chat.learned_text(F.col("segments"))
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return done.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


ORACLES["op6_chat"] = """
WITH own AS (
    SELECT -7::BIGINT AS conv_id, t AS turn, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END AS role,
           '\\### Assistant: </turn> ok' AS text
    FROM (VALUES (0), (1)) v(t)
), turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM own)
), written AS (
    SELECT *, replace(replace(replace(text, '\\', '\\b'), '</turn>', '\\t'), '###', '\\h') AS safe,
           replace(replace(replace(replace(role, '\\', '\\b'), '</turn>', '\\t'), '###', '\\h'), ': ', '\\c') AS safe_role
    FROM turns
), joined AS (
    SELECT conv_id, count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS all_turns,
           coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
           sum(length('### ' || safe_role || ': ' || safe || ' </turn>' || chr(10)))::BIGINT AS formatted_chars,
           string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE '-' END, ''
               ORDER BY turn NULLS FIRST, role, text) AS moves
    FROM written GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(all_turns) AS turns_sha256, length(loss) AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars, regexp_full_match(moves, 's?(ua)+') AS valid
FROM joined
"""


@query
def op7_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLES["op7_caps"] = """
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))
      AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.95
), reach AS (
    SELECT vec_id AS node, vec_id AS seen FROM embeddings
    UNION
    SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.seen
), least AS (
    SELECT node, min(seen) AS component_id FROM reach GROUP BY node
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, component_id,
       e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON node = e.vec_id
"""


@query
def op8_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.apply_policies(ledger.ledger(documents(spark, sf_dir)))
    failed = ledger.fails(ledger.BASE)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~ledger.fails(ledger.POLICIES[ledger.CURRENT])).alias("kept"),
        "fail_bits", *[f"kept_{version}" for version in ledger.POLICIES],
    )


# What the ledger holds, written from its rules: the measurements and a bit per failed rule.
_LEDGER = r"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), starts AS (
    SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win
    FROM texts, generate_series(1, len(words) - 7) g(i)
), again AS (
    SELECT doc_id, i FROM starts QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), covered AS (
    SELECT doc_id, count(DISTINCT i + k) AS n FROM again, generate_series(0, 7) s(k) GROUP BY doc_id
), lined AS (
    SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts
), measured AS (
    SELECT doc_id, len(words)::BIGINT AS n_words,
           length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
           len(lines)::BIGINT AS n_lines,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
           coalesce(n, 0)::BIGINT AS n_repeat_words,
           len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter_words
    FROM lined LEFT JOIN covered USING (doc_id)
), ruled AS (
    SELECT *, [n_words < 20, 100 * n_repeat_words > 30 * n_words, n_symbols > n_words, word_chars < 2 * n_words,
               word_chars > 20 * n_words, 2 * n_dup_lines > n_lines, 2 * n_letter_words < n_words] AS fails
    FROM measured
)
"""
ORACLES["op8_ledger"] = _LEDGER + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       fails[1] OR fails[2] AS base_failed, NOT list_bool_or(fails) AS kept,
       list_sum(list_transform(fails, lambda f, i: f::INTEGER * (1 << (i - 1)::INTEGER)))::BIGINT AS fail_bits,
       NOT (fails[1] OR fails[2]) AS kept_v1, NOT list_bool_or(fails[1:6]) AS kept_v2, NOT list_bool_or(fails) AS kept_v3
FROM ruled
"""


def ledger_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy does to the whole table, from the ledger's bits."""
    return ledger.ablations(ledger.ledger(documents(spark, sf_dir)), ledger.POLICIES[ledger.CURRENT])


QUERIES["ledger_ablations"] = ledger_ablations
ORACLES["ledger_ablations"] = _LEDGER + """, cases AS (
    SELECT unnest(['few_words', 'repeated_windows', 'many_symbols', 'short_words', 'long_words', 'duplicate_lines',
                   'few_letter_words']) AS rule, unnest(range(1, 8)) AS i
)
SELECT rule, count(*) FILTER (fails[i]) AS failed,
       count(*) FILTER (fails[i] AND len(list_filter(fails, lambda f: f)) = 1) AS failed_alone,
       count(*) FILTER (len(list_filter(fails, lambda f: f)) = fails[i]::INTEGER) AS kept_without
FROM ruled, cases GROUP BY rule
"""


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest, folder = tokenfiles.write_token_files(documents(spark, sf_dir), path)
    return tokenfiles.read_token_files(manifest, folder)


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).drop("root")


@query
def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


ORACLES["op11_lines"] = """
WITH texts AS (
    SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), keyed AS (
    SELECT row_no, doc_id, i, lines[i] AS line,
           trim(translate(lines[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
    FROM texts, generate_series(1, len(lines)) g(i)
), common AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INTEGER) >= 3
), judged AS (
    SELECT row_no, keyed.doc_id, i, line, keeper IS NOT NULL AND keyed.doc_id IS DISTINCT FROM keeper AS gone
    FROM keyed LEFT JOIN common USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY row_no, doc_id
"""


@query
def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resampling.resample(documents(spark, sf_dir), target).drop("n_words")


ORACLES["op12_resampling"] = r"""
WITH RECURSIVE crc_step(n, value, bit) AS (
    SELECT n, n::BIGINT, 0 FROM generate_series(0, 255) g(n)
    UNION ALL
    SELECT n, xor(value >> 1, CASE WHEN value % 2 = 1 THEN 3988292384 ELSE 0 END), bit + 1 FROM crc_step WHERE bit < 8
), crc_table AS (
    SELECT list(value ORDER BY n) AS crcs FROM crc_step WHERE bit = 8
), read AS (
    SELECT 'd' AS side, row_number() OVER () AS row_no, doc_id, text FROM documents
    UNION ALL
    SELECT 'b', row_number() OVER (), NULL, text FROM benchmark
), texts AS (
    SELECT side, row_no, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM read
), features AS (
    SELECT side, row_no, array_to_string(words[i:i + n - 1], ' ') AS feature, count(*) AS times
    FROM texts, generate_series(1, 3) s(n), generate_series(1, len(words) - n + 1) g(i)
    GROUP BY ALL
), named AS (
    SELECT DISTINCT feature, regexp_extract_all(hex(encode(feature)), '..') AS pairs FROM features
), bucketed AS (
    SELECT feature, xor(list_reduce(
               list_transform(pairs, lambda h: ('0x' || h)::BIGINT),
               lambda crc, byte: xor(crc >> 8, crcs[(xor(crc, byte) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
    FROM named, crc_table
), counted AS (
    SELECT bucket, coalesce(sum(times) FILTER (side = 'd'), 0) AS s, coalesce(sum(times) FILTER (side = 'b'), 0) AS t
    FROM features JOIN bucketed USING (feature) GROUP BY bucket
), gains AS (
    SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000))))::BIGINT AS gain
    FROM counted
), weights AS (
    SELECT row_no, sum(times)::BIGINT AS n_features, sum(times * gain)::BIGINT AS weight
    FROM features JOIN bucketed USING (feature) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row_no
), scored AS (
    SELECT row_no, doc_id, len(words) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln(
               (('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM texts LEFT JOIN weights USING (row_no) WHERE side = 'd'
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place,
           count(*) FILTER (able) OVER () AS n
    FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 5 * n // 100 THEN place END AS rank FROM ranked
"""


@query
def op13_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLES["op13_interactions"] = r"""
WITH measured AS (
    SELECT row_number() OVER () AS row_no, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), marks AS (
    SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id
), judged AS (
    SELECT row_no, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {
        'A': len(words) < 200,
        'B': 100 * len(list_distinct(words)) < 50 * len(words),
        'C': 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t),
        'D': regexp_matches(t, '[#$%&*|]'),
        'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)
    } AS fails
    FROM measured LEFT JOIN marks USING (doc_id)
), failed AS (
    SELECT row_no, part, good, toxic, letter,
           CASE letter WHEN 'A' THEN fails.A WHEN 'B' THEN fails.B WHEN 'C' THEN fails.C WHEN 'D' THEN fails.D ELSE fails.E END
               AS fail,
           fails.A::INTEGER + fails.B::INTEGER + fails.C::INTEGER + fails.D::INTEGER + fails.E::INTEGER AS n_fails
    FROM judged, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) l(letter)
), orders AS (
    SELECT a || b || c || d || e AS filter_order
    FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(a), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) w(b),
         (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) x(c), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) y(d),
         (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) z(e)
    WHERE len(list_distinct([a, b, c, d, e])) = 5
), steps AS (
    SELECT filter_order, i::INTEGER AS step, substr(filter_order, i, 1) AS letter FROM orders, generate_series(1, 5) g(i)
), met AS (
    SELECT part, filter_order, step, letter, good, toxic, n_fails,
           step = min(step) OVER (PARTITION BY row_no, filter_order) AS first
    FROM failed JOIN steps USING (letter) WHERE fail
), counted AS (
    SELECT part, filter_order, step, count(*) FILTER (first) AS removed, count(*) FILTER (NOT first) AS redundant,
           count(*) FILTER (n_fails = 1) AS unique_fails,
           sum(good) FILTER (first) AS good_lost, sum(toxic) FILTER (first) AS toxic_lost
    FROM met GROUP BY ALL
), parts AS (
    SELECT part, count(*) AS total FROM measured GROUP BY part
), whole AS (
    SELECT part, filter_order, step, letter, total, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant,
           coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost
    FROM parts CROSS JOIN steps LEFT JOIN counted USING (part, filter_order, step)
)
SELECT part, filter_order, step,
       (total - sum(removed) OVER (PARTITION BY part, filter_order ORDER BY step))::BIGINT AS kept,
       removed, redundant, unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM whole
"""
