"""Token ids of many texts at once: words are looked up in arrays, and unknown ones merged in step with numpy."""

from __future__ import annotations

import json
import re

import numpy as np

from .common import chunks
from .shingles import Words, splitmix, word_hashes

_CHUNK = 1 << 20
_LONGEST = 24
_NONE = np.int32(1 << 30)


def byte_symbols() -> list[str]:
    """The character by which byte-level vocabularies write each byte: itself where it is visible Latin-1, else the
    next one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Merges:
    """The merges of a byte-level vocabulary whose words end in `</w>`, applied to many words of letters at once.

    Each round merges in every unfinished word the pair of least rank, the first such pair on ties, as the vocabulary
    wants it one by one. Pairs are found in an open-addressed hash table.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.uint64)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        self.bits = int(4 * len(pairs)).bit_length()
        self.keys = np.full(1 << self.bits, 2**64 - 1, np.uint64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        spot, left = self._spots(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[spot] == np.uint64(2**64 - 1)
            first = np.unique(spot[free], return_index=True)[1]
            take = np.flatnonzero(free)[first]
            self.keys[spot[take]], self.ranks[spot[take]] = keys[left[take]], left[take]
            rest = np.ones(len(left), bool)
            rest[take] = False
            left, spot = left[rest], (spot[rest] + 1) & ((1 << self.bits) - 1)
        self.inner = np.array([vocabulary[c] for c in byte_symbols()], np.int32)
        self.last = np.array([vocabulary[c + "</w>"] for c in byte_symbols()], np.int32)

    def _spots(self, keys: np.ndarray) -> np.ndarray:
        return (splitmix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Each pair's rank, or _NONE."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        spot = self._spots(keys)
        at = self.keys[spot]
        out = np.where(at == keys, self.ranks[spot], _NONE)
        left = np.flatnonzero((at != keys) & (at != np.uint64(2**64 - 1)))
        for _ in range(self.probes):
            if not len(left):
                break
            spot[left] = (spot[left] + 1) & ((1 << self.bits) - 1)
            at = self.keys[spot[left]]
            same = at == keys[left]
            out[left[same]] = self.ranks[spot[left[same]]]
            left = left[~same & (at != np.uint64(2**64 - 1))]
        return out

    def apply(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many) of the words of letters at data[start : start + size], ids of all words in a row."""
        counts = np.empty(len(starts), np.int64)
        pieces, owners, low = [], [], 0
        for high in (5, 8, 12, 16, _LONGEST):
            these = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            for at in range(0, len(these), 1 << 16):
                own = these[at : at + (1 << 16)]
                ids, counts[own] = self._merged(data, starts[own], sizes[own], high)
                pieces.append(ids)
                owners.append(np.repeat(own, counts[own]))
        if not pieces:
            return np.empty(0, np.int32), counts
        order = np.argsort(np.concatenate(owners), kind="stable")
        return np.concatenate(pieces)[order], counts

    def _merged(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        column = np.arange(width)
        letter = data[np.minimum(starts[:, None] + column, len(data) - 1)]
        inside = column < sizes[:, None]
        ids = np.where(column == sizes[:, None] - 1, self.last[letter], self.inner[letter])
        ranks = np.full(ids.shape, _NONE, np.int32)
        pair = inside[:, 1:]
        ranks[:, :-1][pair] = self.rank(ids[:, :-1][pair], ids[:, 1:][pair])
        left, rows = sizes.copy(), np.arange(len(sizes))
        whole = np.zeros(ids.shape, np.int32)
        while len(rows):
            at = ranks.argmin(axis=1)
            line = np.arange(len(at))
            best = ranks[line, at]
            more = best < _NONE
            if not more.all():
                whole[rows[~more]] = ids[~more]
                ids, ranks, rows, at, best = ids[more], ranks[more], rows[more], at[more], best[more]
                line = np.arange(len(at))
                if not len(rows):
                    break
            left[rows] -= 1
            shift = np.minimum(column + (column > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, shift, 1)
            ids[line, at] = self.made[best]
            ranks = np.take_along_axis(ranks, np.minimum(column + (column >= at[:, None]), width - 1), 1)
            ranks[:, -1] = _NONE
            size = left[rows]
            ranks[line, at] = _NONE
            after, before = np.flatnonzero(at + 1 < size), np.flatnonzero(at > 0)
            ranks[after, at[after]] = self.rank(ids[after, at[after]], ids[after, at[after] + 1])
            ranks[before, at[before] - 1] = self.rank(ids[before, at[before] - 1], ids[before, at[before]])
        return whole[column < left[:, None]], left


class WordTokens:
    """The token ids of texts as little-endian uint32 bytes, from a table of the words that appeared.

    The tokenizer never joins characters across white space, so a text's ids are those of its space-separated words
    in a row. Only texts of ASCII and Latin-1 letters and marks go this way, where its normalisation is
    lower-casing; all others go through it whole. Words are told apart by a 64-bit hash. Unknown words of
    letters alone are merged here, other ones by the tokenizer. The table starts anew when it holds `room` words: some 30 bytes each.
    """

    OTHER = re.compile(r"[^\t\n\r\x20-\x7e¡-ÿ]")

    def __init__(self, path: str, room: int = 1_500_000):
        from tokenizers import Tokenizer

        self.room, self.tokenizer = room, Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.merges = Merges(model["vocab"], model["merges"])
        self.is_word, self.same = np.ones(256, bool), np.arange(256, dtype=np.uint8)
        self.is_word[list(b" \t\n\r")] = False
        # lower-case Latin-1 letters beyond a-z are two bytes of UTF-8: 0xC3 and one of these
        self.plain, self.second = np.zeros(256, bool), np.zeros(256, bool)
        self.plain[97:123] = True
        self.second[[0x9F, *range(0xA0, 0xB7), *range(0xB8, 0xC0)]] = True
        self._forget()

    def _letters(self, data: np.ndarray) -> np.ndarray:
        """Which bytes are of letters."""
        out, pair = self.plain[data], (data[:-1] == 0xC3) & self.second[data[1:]]
        out[:-1] |= pair
        out[1:] |= pair
        return out

    def _forget(self) -> None:
        """keys ascend; word i's ids are flat[at[i] : at[i] + size[i]]."""
        self.keys, self.at, self.size, self.flat = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def _places(self, unique: np.ndarray, data: np.ndarray, letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where in the table the words stand, which have the ascending hashes `unique`; unknown ones are added."""
        if len(self.keys) + len(unique) > self.room:
            self._forget()
        spot = np.searchsorted(self.keys, unique)
        known = self.keys[np.minimum(spot, len(self.keys) - 1)] == unique if len(self.keys) else np.zeros(len(unique), bool)
        new = np.flatnonzero(~known)
        if len(new):
            ids, sizes = self._learned(data, letters, starts[new], ends[new])
            first = len(self.flat) + np.cumsum(sizes) - sizes
            self.keys, self.at, self.size = (np.insert(x, spot[new], y) for x, y in ((self.keys, unique[new]), (self.at, first), (self.size, sizes)))
            self.flat = np.concatenate([self.flat, ids])
            spot = np.searchsorted(self.keys, unique)
        return spot

    def _learned(self, data: np.ndarray, letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many) of unknown words."""
        lengths = ends - starts
        odd = np.concatenate([[0], np.cumsum(~letters)])
        plain = (odd[ends] == odd[starts]) & (lengths <= _LONGEST)
        easy, hard = np.flatnonzero(plain), np.flatnonzero(~plain)
        sizes = np.empty(len(starts), np.int64)
        found, sizes[easy] = self.merges.apply(data, starts[easy], lengths[easy])
        pieces, owners = [found.astype(np.uint32)], [np.repeat(easy, sizes[easy])]
        for a in range(0, len(hard), 2000):
            own = hard[a : a + 2000]
            words = [data[starts[i] : ends[i]].tobytes().decode() for i in own.tolist()]
            got = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
            sizes[own] = np.bincount(np.array(got.word_ids, np.int64), minlength=len(own))
            pieces.append(np.array(got.ids, np.uint32))
            owners.append(np.repeat(own, sizes[own]))
        order = np.argsort(np.concatenate(owners), kind="stable")
        return np.concatenate(pieces)[order], sizes

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        slow = [i for i, t in enumerate(texts) if "<|" in t or self.OTHER.search(t)]
        odd = set(slow)
        for i, found in zip(slow, self.tokenizer.encode_batch([texts[i] for i in slow], add_special_tokens=False), strict=True):
            out[i] = np.array(found.ids, "<u4").tobytes()
        quick = [i for i in range(len(texts)) if i not in odd]
        for a, b in chunks([len(texts[i]) for i in quick], _CHUNK):
            for i, ids in zip(quick[a:b], self._quick([texts[i].lower().encode() for i in quick[a:b]]), strict=True):
                out[i] = ids
        return out

    def _quick(self, texts: list[bytes]) -> list[bytes]:
        words = Words(texts, self.is_word, self.same, hashed=False)
        starts, ends, data = words.starts, words.ends, words.data
        # a mark behind a letter is a token of its own, and so a word of its own here
        letters, last = self._letters(data), data[ends - 1]
        marked = ((last == 44) | (last == 46)) & (ends - starts > 1) & letters[ends - 2]
        each = 1 + marked.astype(np.int64)
        place = np.cumsum(each) - each
        starts, ends = np.repeat(starts, each), np.repeat(ends, each)
        own = place[marked]
        ends[own] -= 1
        starts[own + 1] = ends[own]
        if not len(starts):
            return [b""] * len(texts)
        unique, first, inverse = np.unique(word_hashes(words.padded, starts, ends), return_index=True, return_inverse=True)
        spot = self._places(unique, data, letters, starts[first], ends[first])[inverse]
        sizes = self.size[spot]
        until = np.cumsum(sizes)
        total = np.concatenate([[0], until])
        ids = self.flat[np.repeat(self.at[spot] - total[:-1], sizes) + np.arange(total[-1])]
        cuts = (total[np.concatenate([place, [len(starts)]])[words.first]] * 4).tolist()
        raw = ids.astype("<u4").tobytes()
        return [raw[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
