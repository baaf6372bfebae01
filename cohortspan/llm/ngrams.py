"""Word n-grams of many texts at once: interned in an open-addressed table of NumPy arrays.

The words of a slice of texts lie in one buffer, each followed by one blank, so an
n-gram is a stretch of that buffer. N-grams of equal length are hashed together,
eight bytes at a time. Two n-grams share a slot only if all their bytes are
equal; the hash just says where to look.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash

# Fixed values of XXH64 and of CRC-32.
PRIMES = (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5,
)
CRC_POLYNOMIAL = 0xEDB88320

LONG = 96  # n-grams of more bytes are rare and hashed one by one
BLOCK_WORDS = 1 << 16

# What a byte becomes inside words: digits, letters without case of A to Z, all beyond ASCII; else a blank.
_BYTES = np.arange(256)
_KEPT = (_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
_CAPITAL = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
FOLDED = np.where(_CAPITAL, _BYTES + 32, np.where(_KEPT, _BYTES, 0x20)).astype(np.uint8)


@dataclass
class Words:
    """Words one after the other, and each text's first one; the last entry of ``first`` is their number."""

    buffer: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    first: np.ndarray


def words_of(texts: list[bytes]) -> Words:
    """The words of all texts, A to Z as a to z."""
    joined = FOLDED[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
    inside = joined != 0x20
    before = np.concatenate(([False], inside[:-1]))
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(~inside & before)
    lengths = ends - starts
    begins = np.cumsum([0, *[len(text) + 1 for text in texts]])
    buffer = np.concatenate((joined[inside | before], np.zeros(8, np.uint8)))  # a word and the blank behind it
    return Words(buffer, np.cumsum(lengths + 1) - lengths - 1, lengths, np.searchsorted(starts, begins))


@dataclass
class Block:
    """Words of a slice, of which the first ``own`` begin n-grams; the others are there for the last ones to reach into.

    ``text`` is the text of each word.
    """

    buffer: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    text: np.ndarray
    own: int


@dataclass
class Slots:
    """The table of a block's n-grams, and their occurrences.

    Columns of the table: ``owner``, an occurrence that stands for the slot's n-gram, and
    ``count``, its occurrences (0: an empty slot). Columns of occurrences: ``starts``,
    ``lengths``, ``text`` and ``slot``.
    """

    owner: np.ndarray
    count: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    text: np.ndarray
    slot: np.ndarray


def blocks(words: Words, longest: int) -> Iterator[Block]:
    """All words in blocks of bounded number; every n-gram of up to ``longest`` words begins in one of them."""
    n = len(words.starts)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    for start in range(0, n, BLOCK_WORDS):
        stop = min(n, start + BLOCK_WORDS + longest - 1)
        low, high = words.starts[start], words.starts[stop - 1] + words.lengths[stop - 1]
        yield Block(
            words.buffer[low:high + 8], words.starts[start:stop] - low, words.lengths[start:stop], text[start:stop],
            min(BLOCK_WORDS, n - start),
        )


def stretches(block: Block, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of all runs of 1 to ``longest`` words within one text."""
    found = []
    for n in range(1, longest + 1):
        i = np.arange(max(0, min(block.own, len(block.text) - n + 1)))
        i = i[block.text[i] == block.text[i + n - 1]]
        ends = block.starts[i + n - 1] + block.lengths[i + n - 1]
        found.append((block.starts[i], ends - block.starts[i], block.text[i]))
    return tuple(np.concatenate(column) for column in zip(*found))


def eights(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; ``buffer`` ends with eight spare bytes."""
    return np.ndarray((len(buffer) - 7,), "<u8", np.ascontiguousarray(buffer), 0, (1,)).copy()


def by_length(lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each length of at most ``LONG`` bytes and the places where it stands; 0 and the places of all longer ones."""
    capped = np.minimum(lengths, LONG + 1).astype(np.uint8)
    order = np.argsort(capped, kind="stable")
    ends = np.cumsum(np.bincount(capped, minlength=LONG + 2))
    for length in np.unique(capped).tolist():
        yield length if length <= LONG else 0, order[ends[length - 1] if length else 0:ends[length]]


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def hashes(buffer: np.ndarray, lanes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of each stretch."""
    out = np.empty(len(starts), np.uint64)
    for length, at in by_length(lengths):
        if length:
            out[at] = _hashed(lanes, starts[at], length, seed)
        else:
            own = buffer.tobytes()
            out[at] = [xxhash.xxh64_intdigest(own[s:s + n], seed) for s, n in zip(starts[at].tolist(), lengths[at].tolist())]
    return out


def _hashed(lanes: np.ndarray, starts: np.ndarray, length: int, seed: int) -> np.ndarray:
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in PRIMES)
    wide = 1 << 64

    def stirred(lane: np.ndarray) -> np.ndarray:
        return _turned(lane * p2, 31) * p1

    done = 0
    if length >= 32:
        sums = [np.uint64((seed + add) % wide) for add in (PRIMES[0] + PRIMES[1], PRIMES[1], 0, wide - PRIMES[0])]
        while done + 32 <= length:
            sums = [_turned(v + lanes[starts + (done + 8 * k)] * p2, 31) * p1 for k, v in enumerate(sums)]
            done += 32
        h = sum((_turned(v, bits) for v, bits in zip(sums[1:], (7, 12, 18))), _turned(sums[0], 1))
        for v in sums:
            h = (h ^ stirred(v)) * p1 + p4
        h += np.uint64(length)
    else:
        h = np.full(len(starts), np.uint64((seed + PRIMES[4] + length) % wide))
    while done + 8 <= length:
        h = _turned(h ^ stirred(lanes[starts + done]), 27) * p1 + p4
        done += 8
    if done < length:
        rest = lanes[starts + done]
        if done + 4 <= length:
            h = _turned(h ^ ((rest & np.uint64(0xFFFFFFFF)) * p1), 23) * p2 + p3
            done, rest = done + 4, rest >> np.uint64(32)
        while done < length:
            h = _turned(h ^ ((rest & np.uint64(0xFF)) * p5), 11) * p1
            done, rest = done + 1, rest >> np.uint64(8)
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def same_bytes(
    buffer: np.ndarray, lanes: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray
) -> np.ndarray:
    """Whether the stretches at ``a`` and at ``b``, of equal lengths, hold the same bytes."""
    same = np.ones(len(a), bool)
    left = np.flatnonzero(a != b)
    done = 0
    while len(left) and done <= LONG:
        unread = np.maximum(0, 8 * (8 + done - lengths[left])).astype(np.uint64)  # bits of a lane behind the stretch
        differ = ((lanes[a[left] + done] ^ lanes[b[left] + done]) << unread) != 0
        same[left[differ]] = False
        done += 8
        left = left[~differ & (lengths[left] > done)]
    if len(left):
        own = buffer.tobytes()
        for k in left.tolist():
            x, y, n = int(a[k]), int(b[k]), int(lengths[k])
            same[k] = own[x:x + n] == own[y:y + n]
    return same


def interned(block: Block, longest: int) -> Slots:
    """The n-grams of a block in their table.

    All occurrences probe together. In each round the ones before a free slot
    claim it, one of them becomes its owner, and who has the owner's hash, length
    and bytes stays; the others go on to the next slot. Equal n-grams thus always look
    at the same slot and end in the same one.
    """
    lanes = eights(block.buffer)
    starts, lengths, text = stretches(block, longest)
    hashed = hashes(block.buffer, lanes, starts, lengths)
    size = 1 << max(4, (2 * len(starts)).bit_length())
    slot = (hashed & np.uint64(size - 1)).astype(np.int64)
    owner = np.full(size, -1, np.int64)
    pending = np.arange(len(starts))
    while len(pending):
        at = slot[pending]
        free = owner[at] < 0
        owner[at[free]] = pending[free]
        held = owner[at]
        alike = np.flatnonzero((hashed[held] == hashed[pending]) & (lengths[held] == lengths[pending]))
        one, other = held[alike], pending[alike]
        going = np.ones(len(pending), bool)
        going[alike[same_bytes(block.buffer, lanes, starts[one], starts[other], lengths[other])]] = False
        pending = pending[going]
        slot[pending] = (slot[pending] + 1) & (size - 1)
    return Slots(owner, np.bincount(slot, minlength=size), starts, lengths, text, slot)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(CRC_POLYNOMIAL), np.uint32(0))
    return table


def checksums(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each stretch, unsigned."""
    table, out = _crc_table(), np.empty(len(starts), np.uint32)
    for length, at in by_length(lengths):
        if length:
            crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
            begin = starts[at]
            for k in range(length):
                crc = table[(crc ^ buffer[begin + k]) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
            out[at] = ~crc
        else:
            own = buffer.tobytes()
            out[at] = [zlib.crc32(own[s:s + n]) for s, n in zip(starts[at].tolist(), lengths[at].tolist())]
    return out
