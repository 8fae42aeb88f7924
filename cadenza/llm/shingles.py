"""Words and word n-grams of many texts at once, hashed with numpy over the UTF-8 bytes."""

from __future__ import annotations

import functools

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEED = 20240117


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Words of more bytes are hashed one by one; shorter ones all at once, eight bytes a step.
_LONG = 64


@functools.cache
def _masks() -> np.ndarray:
    """Which bits of eight little-endian bytes belong to a word that has 0 to 8 of them left."""
    return np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(padded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range. Every step is a bijection of the hash so far and the next eight bytes, so
    no structure of the bytes cancels out, as it does in polynomials modulo 2^64. padded has eight spare bytes."""
    import xxhash

    lanes = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    left = ends - starts
    with np.errstate(over="ignore"):
        out = splitmix(left.astype(np.uint64) * _BASE + np.uint64(_SEED))
    out = splitmix(out ^ (lanes[starts] & _masks()[np.minimum(left, 8)]))
    for at in range(8, _LONG, 8):
        more = np.flatnonzero((left > at) & (left <= _LONG))
        if not len(more):
            break
        out[more] = splitmix(out[more] ^ (lanes[starts[more] + at] & _masks()[np.minimum(left[more] - at, 8)]))
    for i in np.flatnonzero(left > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(padded[starts[i] : ends[i]].data, _SEED)
    return out


class Words:
    """The words of some texts: `hashes` in order unless not hashed, and `first[i]:first[i + 1]` are those of text i."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray, fold: np.ndarray, hashed: bool = True):
        """is_word, fold: tables over byte values; a word is a maximal run of is_word bytes, folded before hashing."""
        padded = fold[np.frombuffer(b" ".join([*texts, b""]) + bytes(8), np.uint8)]
        data = padded[:-8]
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        inside = is_word[data]
        inside[ends - 1] = False
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        self.data, self.text_starts = data, np.concatenate([[0], ends])
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.padded = padded
        if hashed:
            self.hashes = word_hashes(padded, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, self.text_starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def tables(separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    """is_word and fold for Words: all but `separators` are word bytes, A-Z fold to a-z."""
    is_word = np.ones(256, bool)
    is_word[list(separators)] = False
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return is_word, fold


SPACES = b" \t\n\x0b\x0c\r"


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's `width`-word shingles; fewer words make one shingle, none make none."""
    words = Words(texts, *tables(SPACES))
    h, first = words.hashes, words.first
    factors = splitmix(np.arange(1, width + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    with np.errstate(over="ignore"):
        raw = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for j in range(width):
            raw += h[j : j + len(raw)] * factors[j]
        raw = splitmix(raw)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                own = raw[a : b - width + 1].copy()
                own.sort()
                out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            elif b > a:
                out.append(splitmix((h[a:b] * factors[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a) * _BASE))
            else:
                out.append(raw[:0])
    return out
