"""Substring dedup, mixing, chats, language ID, quality ledger and scoring against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortspan.llm import chat, langid, ledger, logbilinear, mixing, substrings
from cohortspan.llm.queries import ORACLES, QUERIES
from check_oracles import compare, connect
from tests.llm.cases import LOWER, SCHEMA, no_docs, odd_docs, odd_rows, phrase, table, words

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, SF_DIR), duck, ORACLES[name]) is None


# -- substring dedup ----------------------------------------------------------

def plain_dedup(texts, window):
    found = [words(t) for t in texts]
    starts = Counter(tuple(w[i:i + window]) for w in found for i in range(len(w) - window + 1))
    kept = []
    for w in found:
        gone = {i + k for i in range(len(w) - window + 1) if starts[tuple(w[i:i + window])] > 1 for k in range(window)}
        kept.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return kept


@pytest.mark.parametrize("crowded", [False, True])
@pytest.mark.parametrize(("window", "size"), [(35, 8), (12, 3), (9, 2)])
def test_repeated_passages_go(spark, monkeypatch, window, size, crowded):
    if crowded:  # many shards, each split over parts and salts
        monkeypatch.setattr(substrings, "SHARD_WINDOWS", 7)
        monkeypatch.setattr(substrings, "SHARD_STRETCHES", 3)
    pick = random.Random(window)
    passages = [phrase(k, pick.randrange(8, 60)) for k in range(12)]
    rows = odd_rows()
    for k in range(60):
        parts = [phrase(1000 + k, pick.randrange(0, 30), 30), *pick.sample(passages, pick.randrange(3)), phrase(2000 + k, 5)]
        rows.append((100 + k, " ".join(parts), "en", "a", None))
    rows += [(500, "x " * 80, "en", "a", None), (501, "x y " * 60, "en", "a", None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("z") for c in ("key", "anchor", "hash", "spans")})
    want = plain_dedup([r[1] for r in rows], window)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = substrings.dedup(docs, window, size).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(
        str((r[0], n, gone, digest(kept))) for r, (n, gone, kept) in zip(rows, want)
    )
    if not crowded:
        left = substrings.without_repeats(docs, window, size)
        assert left.columns == docs.columns
        assert sorted(str((r["doc_id"], r["text"])) for r in left.collect()) == sorted(
            str((r[0], kept if gone else r[1])) for r, (_, gone, kept) in zip(rows, want)
        )


def test_the_automaton_decides_what_goes(monkeypatch):
    """A shard whose automaton finds nothing, or too much, gives other spans."""
    import numpy as np
    import pyarrow as pa

    window, size = 12, 3
    shared = phrase(5, 30)
    texts = [f"{phrase(k, 9)} {shared} {phrase(50 + k, 9)}" for k in range(3)] + [phrase(90, 40)]
    column, counts = substrings.split_joined(pa.array(texts))
    hashes, of, _ = substrings.window_hashes(column, counts, window)
    found = Counter(hashes.tolist())
    known = [h for h, n in found.items() if n > 1]
    # two phrases anchor windows of the passage, the third one stands nowhere
    anchors = {9: (11, 5), 20: (12, 40)}
    rows = [(a, h, None, None, None, None) for a, _ in anchors.values() for h in known]
    rows += [(a, None, bytes([k]), 100, place, text) for place, (a, _) in anchors.items() for k, text in enumerate(texts)]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.string()]
    shard = pa.table([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], ["anchor", "hash", "key", "first", "phrase", "words"])

    def covered():
        spans, out = substrings.shard_spans(shard, window, size), set()
        for r in spans.to_pylist() if spans else []:
            out |= {(r["key"], k) for k in range(r["from"], r["to"])}
        return out

    want = {(bytes([k]), 109 + i) for k in range(3) for i in range(30)}
    near = {(k, i) for k, i in want if i < 109 + 3 + 20}  # what lies around the two phrases
    assert near <= covered() <= want

    class Nothing:
        def iter(self, row):
            return iter(())

    class Everything:
        def iter(self, row):
            return iter([(end, 0) for end in range(size, len(row))])

    class Swapped:
        def __init__(self, real, n):
            self.real, self.n = real, n

        def iter(self, row):
            return iter([(end + 1, k) for end, k in self.real.iter(row)])

    right, real = covered(), substrings.compiled
    monkeypatch.setattr(substrings, "compiled", lambda phrases: Nothing())
    assert covered() == set()
    monkeypatch.setattr(substrings, "compiled", lambda phrases: Everything())
    assert covered() != right
    monkeypatch.setattr(substrings, "compiled", lambda phrases: Swapped(real(phrases), len(phrases)))
    assert covered() != right

    # two windows whose hashes meet by chance are told apart by their words
    numbers = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3])
    assert substrings.same_words(numbers, np.array([0, 0, 0]), np.array([0, 3, 6]), 3).tolist() == [True, False, True]
    values = np.random.default_rng(1).integers(0, 9, 500).astype(np.uint64)
    for width in (1, 2, 3, 7, 8, 28):
        view = np.lib.stride_tricks.sliding_window_view(values, width)
        assert (substrings.places_of_least(values, width) == view.argmin(axis=1) + np.arange(len(view))).all()


def test_the_automaton_chooses_among_few_characters():
    """However many words there are, few characters can follow one another, and phrases are found at whole words only."""
    import numpy as np

    phrases = 3
    number = np.random.default_rng(3).permutation(np.arange(20_000) % 5_000)
    begins, places, of = np.array([0, 9_000, 9_500]), np.array([17, 9_100, 19_990]), np.array([0, 1, 2])
    row = substrings.as_characters(number, 5_000, begins, np.arange(4_000))
    assert len(set(row)) < 100
    view = np.lib.stride_tricks.sliding_window_view(number, phrases)
    at, stretch, which = substrings.located(row, places, begins, of, phrases)
    places_of = [set(np.flatnonzero((view == view[p]).all(axis=1)).tolist()) for p in places]
    assert {(a, w) for a, w in zip(at.tolist(), which.tolist())} == {(a, w) for w, some in enumerate(places_of) for a in some}
    assert (stretch == np.searchsorted(begins, at, side="right") - 1).all()


def test_windows_of_a_whole_shard_are_counted_in_it():
    import numpy as np

    pick = np.random.default_rng(4)
    keys, copies = pick.integers(0, 300, 400).astype(np.uint64), pick.integers(1, 3, 400)
    kind, total = substrings.kinds(keys, copies), Counter()
    for k, n in zip(keys.tolist(), copies.tolist()):
        total[k] += n
    assert ((kind >= 0) == [total[k] > 1 for k in keys.tolist()]).all()
    recurring = [(k, n) for k, n in zip(keys.tolist(), kind.tolist()) if n >= 0]
    assert len({n for _, n in recurring}) == len({k for k, _ in recurring}) == len(set(recurring))
    assert not len(substrings.kinds(keys[:0], copies[:0]))
    # neighbours are compared together, each with its own result
    number = pick.integers(0, 2, 500)
    a, b = np.arange(400), np.concatenate([np.arange(50, 250), pick.integers(0, 490, 200)])
    want = [(number[x:x + 5] == number[y:y + 5]).all() for x, y in zip(a, b)]
    assert substrings.same_words(number, a, b, 5).tolist() == want


def test_crowded_anchors_are_split_beside_whole_shards(spark, monkeypatch):
    """An anchor of more stretches than a shard should hold is counted by Spark, all others in their shards."""
    monkeypatch.setattr(substrings, "SHARD_WINDOWS", 7)
    monkeypatch.setattr(substrings, "SHARD_STRETCHES", 12)
    crowded, many, few = [], phrase(1, 40), phrase(2, 40)
    real = substrings.crowded_rows
    monkeypatch.setattr(
        substrings, "crowded_rows", lambda stretches, *args: crowded.append(stretches.count()) or real(stretches, *args)
    )
    texts = [f"{phrase(100 + k, 9)} {many if k % 5 else few} {phrase(200 + k, 9)}" for k in range(25)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    want = sorted((k, n, gone) for k, (n, gone, _) in enumerate(plain_dedup(texts, 12)))
    got = substrings.dedup(docs, 12, 3).select("doc_id", "n_words", "n_removed").collect()
    assert sorted(map(tuple, got)) == want and crowded and 0 < crowded[0]


def test_dedup_of_nothing(spark):
    assert substrings.dedup(no_docs(spark)).count() == 0
    assert substrings.without_repeats(no_docs(spark)).count() == 0


# -- mixing ---------------------------------------------------------------------

def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    budget, free, target = share * sum(sizes.values()), set(names), {}
    while free:
        level = budget / sum(weight[s] for s in free)
        full = {s for s in free if most * sizes[s] <= level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: most * sizes[s] for s in full}
        budget -= sum(most * sizes[s] for s in full)
        free -= full
    return target


@pytest.mark.parametrize("shard_docs", [4096, 7])
def test_mix_meets_its_targets(spark, monkeypatch, shard_docs):
    monkeypatch.setattr(mixing, "SHARD_DOCS", shard_docs)
    rows = [(k, phrase(k, 20 + k % 90), "en", [None, "a", "b", "ç", "Z", "hot", "hot", "hot"][k % 8], None) for k in range(300)]
    rows += odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("z") for c in ("size", "target", "key", "shard")})
    got = mixing.mix(docs, carry=("source",)).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((r[0], r[3], len(words(r[1]))) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    targets, taken = plain_targets(sizes), Counter()
    for r in got:
        assert r["target"] == pytest.approx(targets[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for source, target in targets.items():
        shards = sum(r[3] == source for r in rows) / shard_docs + 1
        assert abs(taken[source] - target) <= mixing.BLOCK_WORDS * (1 + shards)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5), carry=("source",)).collect()))


def test_mixed_documents_hold_the_words_taken(spark):
    docs = odd_docs(spark)
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    held = Counter()
    texts = {r[0]: r[1] for r in odd_rows()}
    for r in out.collect():
        held[r["doc_id"]] += len(words(r["text"]))
        assert r["text"] in texts[r["doc_id"]]
    assert +held == +taken
    assert mixing.mix(no_docs(spark)).count() == 0 and mixing.mixed_documents(no_docs(spark)).count() == 0


def test_seats_follow_the_highest_quotients(spark):
    pick = random.Random(3)
    rows = []
    for g in range(40):
        seats = pick.randrange(0, 60)
        rows += [(g, p, float(pick.choice([0, 1, 2, 3, 50, pick.randrange(1, 900)])), seats) for p in range(pick.randrange(1, 9))]
    frame = spark.createDataFrame(rows, "g int, p int, votes double, group_seats long")
    got = {(r["g"], r["p"]): r["seats"] for r in mixing.apportion(frame, "g", "p").collect()}
    for g in range(40):
        votes = {p: v for gg, p, v, _ in rows if gg == g}
        seats = next(s for gg, _, _, s in rows if gg == g)
        want = dict.fromkeys(votes, 0)
        for _ in range(seats if any(votes.values()) else 0):
            want[max(votes, key=lambda p: (votes[p] / (2 * want[p] + 1), -p))] += 1
        assert sum(want.values()) == sum(got[g, p] for p in votes)
        # ties between equal quotients may fall either way
        for p in votes:
            assert abs(got[g, p] - want[p]) <= (len(set(votes.values())) < len(votes) or True)


# -- chats ----------------------------------------------------------------------

def test_chats_read_back(spark):
    nasty = ["", "\\", "\\b", "\\t\\h", "</turn>", " </turn>\n", "### user: x", "####", "a: b", "\\### Assistant: </turn> ok", "é\n\n"]
    roles = ["user", "assistant", "system", "a: b", "###", "", None]
    pick = random.Random(1)
    rows = [(c, t, pick.choice(roles), pick.choice([*nasty, None])) for c in (1, 2, 3, None) for t in (0, 1, 1, 2, None, 7)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("z"))
    done = chat.format_chats(frame).select(
        "conv_id", "segments", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.learned_text(F.col("segments")).alias("learned"),
    ).collect()
    assert len(done) == 4
    for r in done:
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == r["conv_id"]))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2], x[3]) for x in own]
        assert r["learned"] == "".join(x[3] for x in own if x[2] == "assistant")
        assert r["formatted"] == "".join(s["text"] for s in r["segments"])
    assert chat.format_chats(frame.where("turn > 99")).count() == 0


@pytest.mark.parametrize(("roles", "valid"), [
    ("system user assistant", True), ("user assistant user assistant", True), ("user", False), ("assistant", False),
    ("user user assistant", False), ("user system assistant", False), ("user assistant system", False), ("tool", False),
])
def test_machine_checks_turn_order(spark, roles, valid):
    rows = [(1, k, role, "x") for k, role in enumerate(roles.split())]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert chat.format_chats(frame).first()["valid"] is valid


def test_chat_query_stays_in_the_jvm(spark):
    for name in ("op1_mixing", "op6_chat"):
        plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# -- language ID ------------------------------------------------------------------

def test_held_out_languages_are_told(spark):
    docs = {r["doc_id"]: r for r in table("documents")}
    got = QUERIES["op5_langid"](spark, SF_DIR).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.95 * len(held)


def test_words_first_then_shorter_grams(spark):
    rows = [(1, "the cat the dog", "en", None, None), (2, "der hund und die katze", "de", None, None)]
    scorer = langid.fit(spark.createDataFrame(rows, SCHEMA))
    assert scorer.langs == ["de", "en"]
    counts = Counter({"the": 2, "cat": 1, "dog": 1})
    own = lambda c, n, v: math.log((c + 0.5) / (n + 0.5 * v))
    assert scorer.word("the")[1] == pytest.approx(own(counts["the"], 4, 3))
    # unseen: its only known 4-gram, " hun", decides; then 3-grams; then characters
    assert scorer.word("hunx") == pytest.approx(scorer.tables[4][" hun"])
    assert " xe" not in scorer.tables[3] and scorer.word("xqhq") == pytest.approx(scorer.tables[1]["h"])
    assert scorer.word("яя").tolist() == [0.0, 0.0]


def test_odd_texts_and_nothing_learned(spark):
    scorer = langid.fit(odd_docs(spark))
    got = {r["doc_id"]: r for r in langid.predict(odd_docs(spark), scorer).collect()}
    for doc in (3, 4, 5, 12):
        assert (got[doc]["lang_pred"], got[doc]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    nothing = langid.fit(no_docs(spark))
    assert {r["lang_pred"] for r in langid.predict(odd_docs(spark), nothing).collect()} == {"und"}
    assert langid.predict(no_docs(spark), scorer).count() == 0
    kept = langid.accepted(odd_docs(spark), scorer, 0.4)
    assert kept.columns == odd_docs(spark).columns and 3 not in {r["doc_id"] for r in kept.collect()}


@pytest.mark.parametrize("most", [0, 3, 10_000])
def test_languages_follow_from_all_counts(spark, monkeypatch, most):
    """Every learned word and n-gram counts, whatever the size of the head."""
    monkeypatch.setattr(langid, "MOST_WORDS", most)
    monkeypatch.setattr(langid, "MOST_GRAMS", most)
    pick = random.Random(5)
    say = lambda letters, n: " ".join("".join(pick.choices(letters, k=pick.randint(1, 6))) for _ in range(n))
    learned = [("en", say("abcdef", 300)), ("de", say("cdefgh", 120) + " der" * 40), ("fr", "a b b")]
    asked = [say("abcdefgh", n) for n in (1, 2, 3, 5, 8, 13)] + ["der " + say("gh", 2), "я", "яa", "12", ""]
    counts = {(0, lang): Counter(text.split()) for lang, text in learned}
    for (_, lang), found in list(counts.items()):
        for n in range(1, 5):
            counts[n, lang] = Counter(g for w in found for g in langid.grams(w, n))

    def score(lang, n, entry):
        own = counts[n, lang]
        return math.log((own[entry] + 0.5) / (own.total() + 0.5 * len(own))) if own else 0.0

    langs = sorted(lang for lang, _ in learned)
    known = lambda n, entry: any(counts[n, lang][entry] for lang in langs)

    def word(w):
        if known(0, w):
            return [score(lang, 0, w) for lang in langs]
        for n in range(4, 0, -1):
            if found := [g for g in langid.grams(w, n) if known(n, g)]:
                return [sum(score(lang, n, g) for g in found) / len(found) for lang in langs]
        return [0.0] * len(langs)

    rows = [(k, text, lang, None, None) for k, (lang, text) in enumerate(learned)]
    scorer = langid.fit(spark.createDataFrame(rows, SCHEMA))
    docs = spark.createDataFrame([(k, text, None, None, None) for k, text in enumerate(asked)], SCHEMA)
    got = {r["doc_id"]: r for r in langid.predict(docs, scorer).collect()}
    assert len(got) == len(asked)
    for k, text in enumerate(asked):
        sums = [sum(x) for x in zip(*[word(w) for w in text.split()])] if text not in ("", "12") else None
        want = (langs[sums.index(max(sums))], 1 / sum(math.exp(x - max(sums)) for x in sums)) if sums else ("und", 0.0)
        assert got[k]["score"] == pytest.approx(want[1]), text
        if sums is None or sorted(sums)[-1] - sorted(sums)[-2] > 1e-9:
            assert got[k]["lang_pred"] == want[0], text


def test_most_frequent_cuts_above_ties(spark):
    rows = [("a", w, n) for w, n in (("p", 9), ("q", 5), ("r", 5), ("s", 1))] + [("b", "p", 1)]
    counts = spark.createDataFrame(rows, "lang string, entry string, count long")
    kept = langid.most_frequent(counts, ["lang"], F.lit(2)).collect()
    assert {(r["lang"], r["entry"], r["all_count"], r["all_entries"]) for r in kept} == {("a", "p", 20, 4), ("b", "p", 1, 1)}


# -- quality ----------------------------------------------------------------------

def test_ledger_of_odd_documents(spark):
    got = {(r["doc_id"], r["n_words"]): r for r in ledger.ledger(odd_docs(spark)).collect()}
    for doc_id, text, *_ in odd_rows():
        r, w = got[doc_id, len(words(text))], words(text)
        runs = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        covered = {i + k for i in range(len(w) - 7) if runs[tuple(w[i:i + 8])] > 1 for k in range(8)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        assert r["word_chars"] == sum(map(len, w)) and r["n_repeat_words"] == len(covered)
        assert r["n_symbols"] == sum((text or "").count(c) for c in "#*$%&|<>")
        assert (r["n_lines"], r["n_dup_lines"]) == (len(lines), len(lines) - len(set(lines)))
        assert bool(r["fail_bits"] & 1) == (len(w) < 20)
    assert ledger.ledger(no_docs(spark)).count() == 0


def test_policies_and_ablations_come_from_the_bits(spark):
    bits = [0, 1, 1, 2, 3, 4, 5, 64, 66]
    rows = spark.createDataFrame([(b,) for b in bits], "fail_bits long")
    kept = ledger.apply_policies(rows, {"a": ("few_words",), "b": ("few_words", "repeated_windows")}).collect()
    assert [r["kept_a"] for r in kept] == [not b & 1 for b in bits]
    assert [r["kept_b"] for r in kept] == [not b & 3 for b in bits]
    report = {r["rule"]: r for r in ledger.ablations(rows, ("few_words", "repeated_windows")).collect()}
    assert (report["few_words"]["failed"], report["few_words"]["failed_alone"]) == (4, 3)
    assert report["few_words"]["kept_without"] == sum(not b & 2 for b in bits)
    assert report["repeated_windows"]["failed"] == 3


# -- scoring ----------------------------------------------------------------------

def test_scores_and_base(spark):
    rows = [*odd_rows(), *[(100 + r["doc_id"], r["text"], "en", "a", 0) for r in table("documents")[:40]]]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("z") for c in ("row", "word", "n", "count", "others")})
    held = lambda doc: zlib.crc32(str(doc).encode() if doc is not None else b"") % 7 == 2
    got = logbilinear.score(docs.withColumn("held_out", langid.fold(F.col("doc_id"), 7) == 2)).collect()
    tokens = lambda text: [*words((text or "").translate(LOWER)), None]
    counts = Counter(t for r in rows if not held(r[0]) for t in tokens(r[1]))
    total, types = sum(counts.values()), len(counts)
    want = Counter()
    for doc_id, text, *_ in rows:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 1) / (total + types + 1)) for t in own)
        want[doc_id, held(doc_id), len(own), sum(counts[t] > 0 for t in own), total, round(base, 6)] += 1
    assert Counter(
        (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got
    ) == want
    assert all(r["score"] < 0 for r in got)


def test_words_of_a_class_score_alike_in_and_beyond_the_head(spark, monkeypatch):
    """By brute force: a word of a class has its count and one, a word never seen one."""
    import numpy as np

    fitted = []
    fit_model = logbilinear.fit_model
    monkeypatch.setattr(logbilinear, "fit_model", lambda *args: fitted.append(fit_model(*args)) or fitted[-1])
    monkeypatch.setattr(logbilinear, "VOCABULARY", 2)
    monkeypatch.setattr(logbilinear, "STEPS", 5)
    long_word = "x" * 70
    learned = ["aa aa aa bb bb bb cc cc once", f"dd, ee, ee, 12 12 7 é {long_word}", None]
    asked = ["aa once cc", f"dd, new, é {long_word}", "12 99 new", "ö", ""]
    rows = [(k, text, k >= len(learned)) for k, text in enumerate([*learned, *asked])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    counts = Counter(w for text in learned for w in words(text))
    vocabulary = ["aa", "bb"]
    shape = lambda w: (2 * (w[-1] == ",") + (not w.isascii())) if any(c.isalpha() for c in w) else 4
    mass, types = Counter(), Counter()
    for w, n in counts.items():
        if w not in vocabulary:
            mass[shape(w)] += n
            types[shape(w)] += 1

    def token(w):
        return vocabulary.index(w) if w in vocabulary else 2 + shape(w)

    def inner(w):
        if w in vocabulary:
            return 1.0
        k = shape(w)
        return (counts[w] + 1) / (mass[k] + types[k] + 1)

    scores = []
    for size in (0, 200_000):
        monkeypatch.setattr(logbilinear, "HEAD", size)
        got = {r["doc_id"]: r["score"] for r in logbilinear.score(docs).collect()}
        table, end, base = fitted[-1].log_table(), 7, 9
        for doc_id, text, _ in rows:
            before, last, total = end + 1, end + 1, 0.0
            for w in [*words(text), None]:
                now = end if w is None else token(w)
                total += table[before * base + last, now] + (0 if w is None else math.log10(inner(w)))
                before, last = last, now
            assert got[doc_id] == pytest.approx(total), (size, text)
        scores.append([got[k] for k in range(len(rows))])
    assert np.allclose(*scores)
    for k in mass:
        seen = sum(inner(w) for w in counts if w not in vocabulary and shape(w) == k)
        assert seen + 1 / (mass[k] + types[k] + 1) == pytest.approx(1)


def test_the_model_beats_its_base_on_learned_and_on_held_out_texts(spark):
    got = QUERIES["op4_logbilinear"](spark, "/root/testdata/sf0.01").collect()
    for held_out in (False, True):
        own = [r for r in got if r["held_out"] is held_out]
        tokens = sum(r["n_tokens"] for r in own)
        base, model = (sum(r[c] for r in own) / tokens for c in ("base_score", "score"))
        assert model > base + 0.02, (held_out, base, model)


def test_copies_share_out_every_occurrence(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(logbilinear, "COPY_TOKENS", 10)
    monkeypatch.setattr(logbilinear, "ROUNDS", 1)
    monkeypatch.setattr(logbilinear, "STEPS", 1)
    staged = logbilinear.stage
    monkeypatch.setattr(logbilinear, "stage", lambda df, name: seen.append(staged(df, name)) or seen[-1])
    rows = {3 * k + k % 2: 1 + k * k % 17 for k in range(9)}
    triples = spark.createDataFrame(list(rows.items()), "triple long, count long")
    logbilinear.fit_model(triples, 2)
    dealt = seen[-1].groupBy("triple").agg(F.sum("count").alias("n"), F.max("count").alias("most"), F.min("count").alias("least"))
    assert {r["triple"]: r["n"] for r in dealt.collect()} == rows
    assert seen[-1].select("share").distinct().count() == -(-(sum(rows.values()) + 2) // 10)


def test_model_is_a_distribution_and_learns():
    import numpy as np

    model = logbilinear.Model(9)
    assert np.allclose((10 ** model.log_table()).sum(axis=1), 1)
    base, random_state = 10, np.random.default_rng(0)
    tokens = np.zeros(4000, int)
    for k in range(2, 4000):  # a token follows from the one before, mostly
        tokens[k] = (tokens[k - 1] + 1) % 9 if random_state.random() < 0.9 else random_state.integers(9)
    triples, counts = np.unique((tokens[:-2] * base + tokens[1:-1]) * base + tokens[2:], return_counts=True)
    noise = np.bincount(tokens, minlength=9) / len(tokens)
    model.bias = np.log(noise)
    loss = lambda: -(model.log_table()[triples // base, triples % base] * counts).sum() / counts.sum()
    before = loss()
    model.train(triples, counts, noise, 1)
    assert loss() < before - 0.4
    assert np.allclose((10 ** model.log_table()).sum(axis=1), 1)


def test_scores_without_anything_to_learn(spark):
    docs = odd_docs(spark).select("doc_id", "text", F.lit(True).alias("held_out"))
    got = logbilinear.score(docs).collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in got} == {(0, 0, 0.0)}
    assert logbilinear.score(docs.where("doc_id = 12345")).count() == 0
