"""The pipeline's stages against plain Python, each on what the stages before it really kept."""

import math
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import regex
import tokenizers

import corpus_pipeline
from cohortspan.llm import langid, mixing
from cohortspan.staging import stage
from tests.llm.cases import SCHEMA, phrase, table, words
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_text_operators import plain_dedup, plain_targets

SF_DIR = "/root/testdata/sf0.001"


def plain_languages(rows):
    """Language and share of the likelihood, words first, from counts over all rows."""
    letters = [regex.findall(r"\p{L}+", (r["text"] or "").lower()) for r in rows]
    counts = defaultdict(Counter)
    for r, own in zip(rows, letters):
        if r["lang"] is not None and r["text"] is not None:
            counts[0, r["lang"]].update(own)
    langs = sorted({lang for _, lang in counts})
    for lang in langs:
        for n in range(1, langid.LONGEST + 1):
            counts[n, lang] = Counter(g for w in counts[0, lang] for g in langid.grams(w, n))
    whole = {key: (own.total() + 0.5 * len(own)) for key, own in counts.items()}
    score = lambda lang, n, x: math.log((counts[n, lang][x] + 0.5) / whole[n, lang])
    scores = {}

    def word(w):
        if w not in scores:
            scores[w] = [0.0] * len(langs)
            for n in range(langid.LONGEST + 1):
                n = langid.LONGEST + 1 - n if n else 0
                found = [x for x in ([w] if n == 0 else langid.grams(w, n)) if any(counts[n, lang][x] for lang in langs)]
                if found:
                    scores[w] = [sum(score(lang, n, x) for x in found) / len(found) for lang in langs]
                    break
        return scores[w]

    out = []
    for own in letters:
        sums = [sum(x) for x in zip(*map(word, own))]
        out.append((langs[sums.index(max(sums))], 1 / sum(math.exp(x - max(sums)) for x in sums)) if sums else ("und", 0.0))
    return out


def as_tuple(row):
    return row["doc_id"], row["text"], row["lang"], row["source"], row["n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage and comes out of the last, as rows."""
    shared = phrase(77, 60)
    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in table("documents", SF_DIR)]
    rows += [
        (9001, None, "en", "src0", 0), (9002, "", None, None, 0), (9003, "1234 %%", "en", "src0", 7),
        (9004, shared + " the of and", "en", None, None), (9005, phrase(5, 20) + "\n" + shared, "en", "src1", 3),
    ]
    docs, seen = spark.createDataFrame(rows, SCHEMA), []
    for name, apply in corpus_pipeline.STAGES:
        seen.append((name, docs, docs.collect()))
        docs = stage(apply(spark, docs, SF_DIR), name)
    return {name: (before, rows, after) for (name, before, rows), after in zip(seen, [s[2] for s in seen[1:]] + [docs.collect()])}


def test_language_stage(stages):
    _, rows, kept = stages["language_id"]
    told = plain_languages(rows)
    close = [abs(share - corpus_pipeline.LEAST_LANGUAGE_SCORE) < 1e-9 for _, share in told]
    want = [as_tuple(r) for r, (lang, share) in zip(rows, told) if lang != "und" and share >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    assert not any(close) and len(want) < len(rows)
    assert Counter(map(as_tuple, kept)) == Counter(want)


def test_near_copies_stage(stages):
    _, rows, kept = stages["simhash_near_dedup"]
    groups = plain_components([plain_fingerprint(r["text"]) for r in rows], [r["doc_id"] for r in rows])
    assert Counter(map(as_tuple, kept)) == Counter(as_tuple(r) for r, least in zip(rows, groups) if r["doc_id"] == least)
    assert len(kept) < len(rows)


def test_passages_stage(stages):
    _, rows, kept = stages["substring_dedup"]
    want = []
    for r, (_, gone, left) in zip(rows, plain_dedup([r["text"] for r in rows], 35)):
        text = left if gone else r["text"]
        want.append((r["doc_id"], text, r["lang"], r["source"], None if text is None else len(text)))
    assert Counter(map(as_tuple, kept)) == Counter(want)
    assert any(a[1] != r["text"] for a, r in zip(want, rows))


def test_mixing_stage(stages):
    docs, rows, kept = stages["mix_sources"]
    texts = {r["doc_id"]: r for r in rows}
    held, sources = Counter(), Counter()
    for r in kept:
        before = texts[r["doc_id"]]
        assert r["text"] in before["text"] and (r["lang"], r["source"]) == (before["lang"], before["source"])
        assert r["n_chars"] == len(r["text"])
        held[r["doc_id"]] += len(words(r["text"]))
        sources[r["source"]] += len(words(r["text"]))
    assert all(n <= 2 * len(words(texts[d]["text"])) for d, n in held.items())
    assert held == Counter({r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect() if r["taken"]})
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(words(r["text"]))
    for source, target in plain_targets(sizes).items():
        assert abs(sources[source] - target) <= 2 * mixing.BLOCK_WORDS


def test_encoding_stage(stages):
    _, rows, done = stages["bpe_encode"]
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    library.no_truncation()
    library.no_padding()
    want = Counter()
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], r["lang"], r["source"], tuple(ids), library.decode(ids, skip_special_tokens=False), len(ids)] += 1
    assert Counter((r["doc_id"], r["lang"], r["source"], tuple(r["ids"]), r["decoded"], r["n_tokens"]) for r in done) == want
