"""Vectorised word splitting and hashing over Arrow string batches.

All of it works on UTF-8 bytes.  The word classes used here treat every byte of a
multi-byte character as a word byte, so byte boundaries and character boundaries agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Bytes that one vectorised pass takes at once; a longer document is a pass of its own.
SLICE_BYTES = 1 << 19
#: Bytes of a word that is hashed together with others, eight bytes at a time; a longer one goes through XXH3 alone.
LONG_WORD = 64
#: Odd multipliers, a row for each family of hashes.
_ODD = np.random.default_rng(0x5EED_2024).integers(0, 2**64, (2, 8), dtype=np.uint64) | U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)

#: Anything but a space or one of the five ASCII controls from tab to carriage return.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: ASCII letters, digits and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def joined(left: np.ndarray, right: np.ndarray, family: int = 0) -> np.ndarray:
    """The hash of a sequence from those of its two parts."""
    return mix(left * _ODD[family, 1] + right)


def run_hashes(words: np.ndarray, k: int, family: int = 0) -> np.ndarray:
    """The hash of words[i : i + k] for every i: a tree over runs of 1, 2, 4 and so on, whatever the words."""
    power, size, out, done = words, 1, None, 0
    while True:
        if k & size:
            ahead = power[done:] if done else power
            out = ahead if out is None else joined(out[: len(ahead)], ahead[: len(out)], family)
            done += size
        if 2 * size > k:
            return out[: max(0, len(words) - k + 1)]
        power, size = joined(power[: max(0, len(power) - size)], power[size:], family), 2 * size


class Slice:
    """Some whole documents of a batch as one byte array. offsets: where each begins, and the end."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray) -> None:
        self.first, self.data, self.offsets = first, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and for each document the index of its first word, with the end.

        kind: which bytes belong to words.  No word crosses documents.
        """
        inside = kind[self.data]
        edge = np.zeros(len(inside) + 1, dtype=bool)
        edge[self.offsets] = True
        before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
        starts = np.flatnonzero(inside & ~before)
        after = np.concatenate((inside[1:], [False])) & ~edge[1:]
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool, family: int = 0) -> np.ndarray:
        """A hash of each word's bytes; those of different families are independent. lower: with A-Z as a-z."""
        data, odd = (_LOWER[self.data] if lower else self.data), _ODD[family]
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        numbers = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
        sizes = ends - starts
        out = mix(sizes.astype(np.uint64) * odd[2] + odd[3])
        rows = np.flatnonzero(sizes <= LONG_WORD)
        for at in range(0, LONG_WORD, 8):
            rows = rows[sizes[rows] > at] if at else rows
            if not len(rows):
                break
            chunk = numbers[starts[rows] + at] & _FIRST_BYTES[np.minimum(sizes[rows] - at, 8)]
            out[rows] = mix((out[rows] ^ chunk) * odd[4])
        for k in np.flatnonzero(sizes > LONG_WORD).tolist():
            out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes(), int(odd[5]))
        return out


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """A string array in order, as slices of at most limit bytes or one document; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Slice(at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


def ngrams(words: np.ndarray, first: np.ndarray, k: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words of one document, and the index of the word each begins at."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    fits = np.ones(n - k + 1, dtype=bool)
    for back in range(1, k):
        cut = first[1:-1] - back
        fits[cut[(cut >= 0) & (cut < len(fits))]] = False
    at = np.flatnonzero(fits)
    return run_hashes(words, k, family)[at], at
