"""BPE encoding by forced boundaries, and decoding.

Two neighbouring bytes that never stand side by side inside a vocabulary token
can't be joined by any merge, so a text may be cut between them. Together with
the pre-tokenizer's own boundaries such cuts break texts into fragments that are
encoded independently; every distinct fragment of a batch is encoded once, by
the library's BPE model, and the ids are put together by the fragments' numbers.

A fragment that ends a word is encoded with the vocabulary's end-of-word suffix
and one in front of a forced cut without it. Everything is done on the bytes of
an Arrow column at once.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cohortspan.llm.texts import kept_in_worker, slices
from cohortspan.llm.tokenfiles import byte_characters

FRAGMENTS_KEPT = 200_000  # encoded fragments remembered in a worker
SPACE, LETTER, DIGIT, MARK = range(4)
# Below this code point texts are composed already and lower-case one by one, but for U+0130.
PLAIN_BELOW = 0x300
# Word endings that the pre-tokenizer splits off after an apostrophe.
ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the given spans, one span after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class ForcedBpe:
    """A tokenizer file's vocabulary, its byte pairs and its encoders."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.encoders = {
            True: Tokenizer(self.tokenizer.model),
            False: Tokenizer(BPE(vocab=model["vocab"], merges=merges)),
        }
        self.known: dict[bool, dict[bytes, bytes]] = {True: {}, False: {}}
        characters = byte_characters()
        self.characters = dict(enumerate(characters))
        self.joined = self._pairs_inside(model["vocab"], {c: b for b, c in enumerate(characters)})
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if added else None
        tokens = {**{i: t for t, i in model["vocab"].items()}, **{i: t.content for i, t in added.items()}}
        self.tokens = pa.array([tokens.get(i, "") for i in range(max(tokens) + 1)])
        self.classes: dict[int, int] = {}
        self.plain_classes = np.array([self._class(c) for c in range(PLAIN_BELOW)], np.uint8)

    def _pairs_inside(self, vocab: dict[str, int], byte_of: dict[str, int]) -> np.ndarray:
        """For each pair of bytes whether some token holds them side by side."""
        joined = np.zeros((256, 256), bool)
        for token in vocab:
            codes = [byte_of.get(c) for c in token.removesuffix(self.suffix)]
            for a, b in zip(codes, codes[1:]):
                if a is not None and b is not None:
                    joined[a, b] = True
        return joined

    def _class(self, code: int) -> int:
        """What the pre-tokenizer takes a character for."""
        if 0xD800 <= code < 0xE000:
            return MARK
        pieces = lambda text: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(text))
        c = chr(code)
        if pieces(f"a{c}a") == 1:
            return LETTER
        if pieces(f"!{c}!") == 1:
            return MARK
        return DIGIT if pieces(c) else SPACE

    def _classes(self, codes: np.ndarray) -> np.ndarray:
        found = self.plain_classes[np.minimum(codes, PLAIN_BELOW - 1)]
        rare = codes >= PLAIN_BELOW
        if rare.any():
            distinct, where = np.unique(codes[rare], return_inverse=True)
            for code in distinct.tolist():
                if code not in self.classes:
                    self.classes[code] = self._class(code)
            found[rare] = np.array([self.classes[c] for c in distinct.tolist()], np.uint8)[where]
        return found

    def _normal(self, texts: pa.Array) -> pa.Array:
        """The texts as the tokenizer's normalizer leaves them, but for runs of white space."""
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
        far = np.flatnonzero(data >= 0xCC)  # first byte of a character from U+0300 on
        plain = np.searchsorted(far, offsets[1:]) == np.searchsorted(far, offsets[:-1])
        plain &= ~pc.match_substring(texts, "İ").to_numpy(zero_copy_only=False)
        lower = pc.utf8_lower(pc.if_else(pa.array(plain), texts, ""))
        if plain.all():
            return lower
        others = [None if p else self.tokenizer.normalizer.normalize_str(t.as_py()) for p, t in zip(plain, texts)]
        return pc.coalesce(pa.array(others, pa.string()), lower)

    def _fragments(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The fragments, which of them end a word, and each one's text number."""
        texts = pa.concat_arrays([texts])
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
        data = data[: offsets[-1]]
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        codes = self._code_points(data, lead)
        kinds = self._classes(codes)
        # word boundaries, in characters: another kind, each digit, the start of a text
        bound = np.ones(len(lead), bool)
        bound[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT)
        first = np.zeros(len(lead), bool)
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[np.searchsorted(lead, begins)] = True
        bound |= first
        self._apostrophes(codes, kinds, bound, first)
        word = np.zeros(len(data) + 1, bool)
        word[lead[bound]] = True
        word[len(data)] = True
        cut = word.copy()
        cut[1:-1] |= ~self.joined[data[:-1], data[1:]]
        at = np.flatnonzero(cut)
        array = pa.Array.from_buffers(
            pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data.tobytes())]
        )
        kind = kinds[np.searchsorted(lead, at[:-1], side="right") - 1]
        number = np.searchsorted(offsets, at[:-1], side="right") - 1
        kept = np.flatnonzero(kind != SPACE)
        return array.take(pa.array(kept)), word[at[1:]][kept], number[kept]

    @staticmethod
    def _code_points(data: np.ndarray, lead: np.ndarray) -> np.ndarray:
        top = data[lead].astype(np.int32)
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        tail = [(padded[lead + k] & 0x3F).astype(np.int32) for k in (1, 2, 3)]
        codes = top.copy()
        two, three, four = (top >= 0xC0) & (top < 0xE0), (top >= 0xE0) & (top < 0xF0), top >= 0xF0
        codes[two] = (top[two] & 0x1F) << 6 | tail[0][two]
        codes[three] = (top[three] & 0x0F) << 12 | tail[0][three] << 6 | tail[1][three]
        codes[four] = (top[four] & 0x07) << 18 | tail[0][four] << 12 | tail[1][four] << 6 | tail[2][four]
        return codes

    @staticmethod
    def _apostrophes(codes: np.ndarray, kinds: np.ndarray, bound: np.ndarray, first: np.ndarray) -> None:
        """An apostrophe that begins a word takes one of the endings after it along."""
        at = np.flatnonzero((codes == ord("'")) & bound)
        padded = np.concatenate([codes, [0, 0, 0]])
        edge = np.concatenate([first, [True, True, True]])
        for ending in ENDINGS:
            fits = np.ones(len(at), bool)
            for k, c in enumerate(ending, 1):
                fits &= (padded[at + k] == c) & ~edge[at + k]
            here = at[fits]
            bound[here + 1] = False
            after = here + 1 + len(ending)
            bound[after[after < len(bound)]] = True
            at = at[~fits]

    def _ids(self, fragments: list[bytes], ends: bool) -> list[bytes]:
        known = self.known[ends]
        if len(known) > FRAGMENTS_KEPT:
            known = self.known[ends] = dict(islice(known.items(), FRAGMENTS_KEPT // 2))
        new = [f for f in fragments if f not in known]
        if new:
            mapped = [f.decode("latin-1").translate(self.characters) for f in new]
            found = self.encoders[ends].encode(mapped, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found.ids, np.int32).tobytes()
            stops = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(new)), side="right")
            start = 0
            for fragment, stop in zip(new, (4 * stops).tolist()):
                known[fragment] = ids[start:stop]
                start = stop
        return [known[f] for f in fragments]

    def encode(self, texts: pa.Array) -> pa.Array:
        """Per text the list of its ids; NULL counts as empty."""
        texts = pc.fill_null(texts, "")
        owner, parts, special = self._parts(texts)
        fragments, ends, number = self._fragments(self._normal(parts))
        pool, coded = [], np.zeros(len(fragments), np.int64)
        for flag in (True, False):
            at = np.flatnonzero(ends == flag)
            numbered = fragments.take(pa.array(at)).dictionary_encode()
            coded[at] = numbered.indices.to_numpy().astype(np.int64) + len(pool)
            pool += self._ids(numbered.dictionary.to_pylist(), flag)
        if len(special):
            # special tokens are parts of one id, set between the fragments of the parts around them
            places = np.searchsorted(number, special[:, 0])
            coded = np.insert(coded, places, len(pool) + np.arange(len(special)))
            number = np.insert(number, places, special[:, 0])
            pool += [np.int32(i).tobytes() for i in special[:, 1]]
        sizes = np.fromiter(map(len, pool), np.int64, len(pool)) // 4
        each = sizes[coded]
        ids = np.frombuffer(b"".join(pool), np.int32)[spans((np.cumsum(sizes) - sizes)[coded], each)]
        per_text = np.bincount(owner[number], each, len(texts)).astype(np.int64)
        return pa.ListArray.from_arrays(
            pa.array(np.concatenate(([0], np.cumsum(per_text))).astype(np.int32)), pa.array(ids)
        )

    def _parts(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Texts cut at special tokens: each part's text number, the parts, and (part, id) of special ones."""
        held = np.zeros(len(texts), bool)
        for content in self.special:
            held |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        if not held.any():
            return np.arange(len(texts)), texts, np.zeros((0, 2), np.int64)
        owner, parts, special = [], [], []
        for k, text in enumerate(texts.to_pylist()):
            for part in self.split_special.split(text) if held[k] else [text]:
                if part in self.special:
                    special.append((len(parts), self.special[part]))
                    part = ""
                owner.append(k)
                parts.append(part)
        return np.array(owner), pa.array(parts, pa.string()), np.array(special, np.int64).reshape(-1, 2)

    def decode(self, ids: pa.Array) -> pa.Array:
        """Per list of ids its text: this vocabulary has no decoder, so tokens are joined by a blank."""
        tokens = pc.take(self.tokens, ids.flatten())
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, tokens), " ")


def _bpe(path: str) -> ForcedBpe:
    return kept_in_worker(f"forced {path}", lambda: ForcedBpe(path))


def encode(docs: DataFrame, tokenizer_path: str, carry: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """The ``carry`` columns and ``ids``, and with ``decoded`` the text that the ids decode to.

    Encodes whole texts as the tokenizers library does without template tokens.
    NULL and empty texts have no ids and decode to an empty text. Special tokens
    written out in a text are taken for themselves. Rows are independent of each
    other: an empty table gives no rows, repeated rows come out repeated, and
    other columns are not looked at. Memory follows the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(tokenizer_path)
        for batch in slices(batches, most_bytes=2 << 20):
            ids = bpe.encode(batch.column(batch.num_columns - 1))
            columns = [*batch.columns[:-1], ids, *([bpe.decode(ids)] if decoded else [])]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [*carry, "ids", *(["decoded"] if decoded else [])]
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry] + ["ids array<int>"]
    return docs.select(*carry, "text").mapInArrow(run, ", ".join(kinds + ["decoded string"] * decoded))


def decode(encoded: DataFrame, tokenizer_path: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns and ``decoded`` for rows with ``ids``; NULL ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(tokenizer_path)
        for batch in batches:
            ids = pa.array(batch.column(batch.num_columns - 1).fill_null([]).to_pylist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], bpe.decode(ids)], [*carry, "decoded"])

    kinds = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in carry)
    return encoded.select(*carry, "ids").mapInArrow(run, f"{kinds}, decoded string")
