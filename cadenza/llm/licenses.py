"""License notices found by an exact set-containment join of text blocks against templates."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, chunks, lean, picked
from .shingles import Words, tables

# The phrases that always count, the notices that the join looks for, and the words without which a notice
# is not one of that label.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the apache license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
]
REQUIRED = {
    "mit": ("permission", "granted", "software"), "isc": ("permission", "copy", "fee"), "apache-2": ("apache", "license"), "gpl-3": ("gnu", "general", "public", "license", "3"),
    "gpl": ("gnu", "general", "public"), "lgpl": ("gnu", "lesser"), "agpl": ("gnu", "affero"), "cc-by-sa": ("creative", "commons", "sharealike"), "cc-by-nc": ("creative", "commons", "noncommercial"),
    "bsd": ("source", "binary", "conditions"), "mpl-2": ("mozilla", "public"), "unlicense": ("unencumbered", "software"), "zlib": ("software", "damages", "alter"),
}
THRESHOLD = Fraction(4, 5)
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_CHUNK = 1 << 19


def _words(texts: list[bytes]) -> Words:
    return Words(texts, *tables(SEPARATORS))


def _hashes(phrase: str) -> np.ndarray:
    return _words([phrase.encode()]).hashes


class Matcher:
    """Templates with their tokens in one global order, rarest first, and the index and filters that this order allows.

    The index leads from each token to the templates that hold it and to its rank there, so a text's words are looked
    up once however many templates there are, and only templates that the filters leave are counted.
    """

    #: A block with `need` of a template's tokens has this many of its first len - need + this many (positional filter).
    DEPTH = 3

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], threshold: Fraction, frequency: dict[int, int], required: dict[str, tuple] | None = None):
        self.phrases = [(_hashes(p), label) for p, label in phrases.items()]
        self.labels, self.sizes, self.needs, self.must = [], [], [], []
        rows = []
        for number, (label, text) in enumerate(templates):
            tokens = sorted(set(_hashes(text).tolist()), key=lambda t: (frequency.get(t, 0), t))
            must = set(_hashes(" ".join((required or {}).get(label, ()))).tolist())
            if not must <= set(tokens):
                raise ValueError(f"template {number} lacks words that {label} requires")
            self.labels.append(label)
            self.sizes.append(len(tokens))
            self.needs.append(ceil(threshold * len(tokens)))
            self.must.append(len(must))
            rows += [(token, number, rank, token in must) for rank, token in enumerate(tokens)]
        rows.sort()
        self.index = [np.array(c, t) for c, t in zip(zip(*rows, strict=True), (np.uint64, np.int64, np.int64, bool), strict=True)] if rows else [np.empty(0, np.uint64)] + [np.empty(0, np.int64)] * 3
        self.vocabulary, first = np.unique(self.index[0], return_index=True)
        self.first = np.concatenate([first, [len(self.index[0])]])

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(template, word, rank, required) of every word's places in the index, by template, then word."""
        if not len(self.vocabulary) or not len(h):
            return (np.empty(0, np.int64),) * 4
        place = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[place] == h)
        place = place[known]
        many = self.first[place + 1] - self.first[place]
        at = np.repeat(self.first[place] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        order = np.argsort(self.index[1][at], kind="stable")
        at, word = at[order], np.repeat(known, many)[order]
        return self.index[1][at], word, self.index[2][at], self.index[3][at]

    def blocks(self, number: int, place: np.ndarray, rank: np.ndarray, must: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hit, distinct tokens) of the blocks of 2 * size words that begin at a hit and meet the threshold."""
        size, need, span = self.sizes[number], self.needs[number], 2 * self.sizes[number]
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        # positional filter: a block that meets the threshold misses at most size - need tokens, so of the first
        # size - need + depth in the global order it holds at least `depth`; its hits stand less than span apart
        depth = min(self.DEPTH, need)
        rare = np.flatnonzero(rank < size - need + depth)
        if len(rare) < depth:
            return none
        close = place[rare[depth - 1 :]] - place[rare[: len(rare) - depth + 1]] < span
        if not close.any():
            return none
        low, high = place[rare[: len(close)][close]] - span, place[rare[depth - 1 :][close]] + span
        near = np.searchsorted(low, place, side="right") > np.searchsorted(np.maximum.accumulate(high), place, side="right")
        kept = np.flatnonzero(near)
        place, rank, must = place[kept], rank[kept], must[kept]
        # a block loses no token if it begins at its first one, so blocks begin at each hit; hit j is new to
        # the blocks begun after the hit before it of the same token, as far back as span words reach
        by = np.argsort(rank, kind="stable")
        before = np.full(len(by), -1)
        same = rank[by[1:]] == rank[by[:-1]]
        before[by[1:][same]] = by[:-1][same]
        begin = np.maximum(before + 1, np.searchsorted(place, place - span, side="right"))

        def distinct(counted: np.ndarray) -> np.ndarray:
            gain = np.bincount(begin[counted], minlength=len(by))
            loss = counted.astype(np.int64)
            return np.cumsum(gain - np.concatenate([[0], loss[:-1]]))

        total = distinct(np.ones(len(by), bool))
        good = np.flatnonzero((total >= need) & (distinct(must) >= self.must[number]))
        return kept[good], total[good]

    def scan(self, texts: list[bytes]) -> list[tuple]:
        """(n_words, n_base, first_word, last_word, base labels, labels, score) of each text."""
        words = _words(texts)
        h, count = words.hashes, words.counts()
        owner = np.repeat(np.arange(len(texts)), count)
        base: list[list[tuple[int, str]]] = [[] for _ in texts]
        for parts, label in self.phrases:
            n = len(parts)
            at = np.flatnonzero(h[: len(h) - n + 1] == parts[0]) if len(h) >= n else np.empty(0, np.int64)
            for j in range(1, n):
                at = at[h[at + j] == parts[j]]
            at = at[owner[at] == owner[at + n - 1]] if len(at) else at
            for i in at.tolist():
                base[owner[i]].append((i - int(words.first[owner[i]]), label))
        labels = [{label for _, label in found} for found in base]
        best = [1.0 if found else 0.0 for found in base]
        template, word, rank, must = self.hits(h)
        cuts = np.searchsorted(template, np.arange(len(self.labels) + 1))
        for number in np.unique(template).tolist():
            own = slice(cuts[number], cuts[number + 1])
            doc = owner[word[own]]
            # places in one line, with room between texts for no block to span two
            hit, total = self.blocks(number, word[own] + doc * (2 * self.sizes[number]), rank[own], must[own].astype(bool))
            for d, n in zip(doc[hit].tolist(), total.tolist(), strict=True):
                labels[d].add(self.labels[number])
                best[d] = max(best[d], n / self.sizes[number])
        out = []
        for i, found in enumerate(base):
            starts = [p for p, _ in found]
            out.append((int(count[i]), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found})), ",".join(sorted(labels[i])), best[i]))
        return out


def frequencies(df: DataFrame, templates: list[tuple[str, str]], text: str = "text") -> dict[int, int]:
    """How many documents hold each template token, over all documents; no more rows than template tokens."""
    vocabulary = np.unique(np.concatenate([_hashes(t) for _, t in templates]))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for a, b in chunks([len(t) + 1 for t in texts], _CHUNK):
                words = _words(texts[a:b])
                spot = np.minimum(np.searchsorted(vocabulary, words.hashes), len(vocabulary) - 1)
                hit = vocabulary[spot] == words.hashes
                owner = np.repeat(np.arange(b - a), words.counts())
                total += np.bincount(np.unique(owner[hit] * len(vocabulary) + spot[hit]) % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocabulary), dtype=np.int32)), pa.array(total)], names=["token", "n"])

    rows = picked(df, text=text).mapInArrow(lean(counted), "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {int(vocabulary[r.token]): r.n for r in rows}


def scan_licenses(df: DataFrame, key: str = "doc_id", text: str = "text", templates=None, phrases=None, threshold: Fraction = THRESHOLD, required=None) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of df.

    Words are runs of 0-9, a-z (A-Z folded) and non-ASCII characters. Base places are where a phrase's words stand
    consecutively. Beyond those, every text block is joined with every template: a template of n distinct words
    takes as blocks all runs of up to 2n words, wherever they begin, and its label goes to the documents with a
    block that holds at least `threshold` of its distinct words, the label's `required` words among them. The join is
    exact: tokens are ordered by their document frequency over all documents, an index leads from tokens to
    templates, and only blocks are counted that hold enough of a template's rarest tokens close together. Only the
    frequencies of template tokens reach the driver. score is the largest share found, 1 with a base place.

    Null and empty text: no words, empty labels, score 0. Very long texts are scanned whole. Every row gives one row,
    repeated ones and null keys too; an empty table gives none.
    """
    required = REQUIRED if templates is None and required is None else required
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    matcher = Matcher(templates, phrases, threshold, frequencies(df, templates, text) if templates else {}, required)
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            rows = [r for a, b in chunks([len(t) + 1 for t in texts], _CHUNK) for r in matcher.scan(texts[a:b])]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], names=["key", *names])

    rows = picked(df, key=key, text=text)
    schema = rows.select("key").schema
    for name, kind in zip(names, ("long", "long", "long", "long", "string", "string", "double"), strict=True):
        schema = schema.add(name, kind)
    return rows.mapInArrow(lean(scanned), schema)
