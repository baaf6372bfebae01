"""Token files and forced-boundary BPE against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortspan.llm import forced_bpe, tokenfiles
from tests.llm.cases import no_docs, odd_docs, odd_rows, table

BYTE, WORDS = (public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "word_bpe_49k.json"))
STRINGS = [
    "a  b", "a   b c", " a b ", " \n a\n \nb c", "x<|endoftext|> y", "", "don't 'sit x'y's !'s ''s 'LL 'rest",
    "Ünï² ½ a1b2 _x_ ́e  b", " ", "\x1c a\x00b", "日本 語。x", "a <|startoftext|><|endoftext|> b", "a.\nb c\n\nd", "a\n",
    "\na b", "İstanbul ΟΔΟΣ ﬁ é xqzj qq're", "'", "'s", "<|endoftext|>", "'<|endoftext|>s", "ǅ ß ẞ ı K Å", " x  ",
    "qzxj" * 50, "a" * 3000, "🙂🙃 x🙂",
]


@pytest.fixture(scope="module")
def texts():
    return STRINGS + [r["text"] for r in table("documents")[:60]] + [r[1] or "" for r in odd_rows()]


def test_forced_boundaries_encode_like_the_library(texts):
    bpe, library = forced_bpe.ForcedBpe(WORDS), Tokenizer.from_file(WORDS)
    ids = bpe.encode(pa.array(texts))
    decoded = bpe.decode(ids).to_pylist()
    for text, mine, back in zip(texts, ids.to_pylist(), decoded):
        want = library.encode(text, add_special_tokens=False).ids
        assert mine == want, text[:60]
        assert back == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(pa.array([None, ""], pa.string())).to_pylist() == [[], []]


def test_no_token_holds_a_forced_pair():
    bpe, library = forced_bpe.ForcedBpe(WORDS), Tokenizer.from_file(WORDS)
    assert 0 < (~bpe.joined).sum() < 256 * 256
    byte_of = {c: b for b, c in enumerate(tokenfiles.byte_characters())}
    for token in list(library.get_vocab())[:5000]:
        codes = [byte_of[c] for c in token.removesuffix("</w>") if c in byte_of]
        if len(codes) == len(token.removesuffix("</w>")):
            assert all(bpe.joined[a, b] for a, b in zip(codes, codes[1:]))


def test_round_trip_of_frames(spark):
    docs = odd_docs(spark)
    once = forced_bpe.encode(docs, WORDS, decoded=True)
    assert once.columns == ["doc_id", "ids", "decoded"]
    again = forced_bpe.decode(once, WORDS).select("decoded").collect()
    assert [r["decoded"] for r in again] == [r["decoded"] for r in once.collect()]
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    library = Tokenizer.from_file(WORDS)
    want = [library.encode(r[1] or "", add_special_tokens=False).ids for r in odd_rows()]
    got = once.select(F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("h")).collect()
    assert [r["h"] for r in got] == [digest(" ".join(map(str, ids))) for ids in want]
    assert forced_bpe.encode(no_docs(spark), WORDS).count() == 0


def test_pieces_encode_like_the_library(texts):
    encoder, library = tokenfiles.PieceEncoder(BYTE, np.dtype("<u2")), Tokenizer.from_file(BYTE)
    for _ in range(2):  # the second time from memory
        ids, per_text = encoder.encode(pa.array(texts), 0)
        want = [library.encode(t, add_special_tokens=False).ids + [0] for t in texts]
        assert ids.tolist() == sum(want, [])
        assert per_text.tolist() == [len(x) for x in want]


def test_files_hold_all_documents_in_order(spark):
    manifest, folder = tokenfiles.write_token_files(odd_docs(spark).repartition(3), BYTE)
    got = tokenfiles.read_token_files(manifest, folder).collect()
    library = Tokenizer.from_file(BYTE)
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_files_of_nothing_and_wide_ids(spark):
    manifest, folder = tokenfiles.write_token_files(no_docs(spark), BYTE)
    assert tokenfiles.read_token_files(manifest, folder).count() == 0
    narrow = tokenfiles.read_token_files(*tokenfiles.write_token_files(odd_docs(spark), BYTE))
    wide = tokenfiles.read_token_files(*tokenfiles.write_token_files(odd_docs(spark), BYTE, vocabulary=1 << 20))
    assert sorted(map(str, narrow.collect())) == sorted(map(str, wide.collect()))
