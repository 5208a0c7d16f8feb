"""License notices inside documents: MinHash bands over overlapping windows, then exact containment.

Templates and documents are sets of word shingles.  A document is cut into overlapping windows
for each class of template length, so close-set that some window holds every occurrence of
a template of the class.  Windows and templates that agree in a band of MinHash values meet; how
many of the template's shingles the window really holds decides.  The number of bands follows
from the least similarity a window can have to a template it must find, so that
missing one has at most the probability ``miss``.
"""

from __future__ import annotations

import json
import math
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.llm import shingles as S
from monthloom.llm.common import carried, sliced, text_buffers

_SCHEMA = "doc_id long, license_id string, containment double, first_word long, n_windows long"

# Short notices as they stand in documents, by the usual identifiers.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction"
    ),
    "BSD-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met"
    ),
}


def registered() -> dict[str, str]:
    """The notices above and the whole texts, standard headers and notices of ``license_texts.json``."""
    with open(os.path.join(os.path.dirname(__file__), "license_texts.json"), encoding="utf-8") as f:
        return {**NOTICES, **json.load(f)}


def ladder(m: int) -> int:
    """The length class of a template of ``m`` shingles: 1, 2, 3, 4, 6, 8, 12, 16, 24, ..."""
    c = 1
    while c < m:
        c = c + 1 if c < 4 else (c * 3 // 2 if c & (c - 1) == 0 else c * 4 // 3)
    return c


def geometry(c: int) -> tuple[int, int]:
    """(stride, blocks of a stride in a window) of a class: a window begins every stride and is long
    enough that some window holds any stretch of ``c`` shingles."""
    stride = max(1, c // 4)
    return stride, -(-(c + stride - 1) // stride)


class Templates:
    """Shingles, classes and bands of the templates."""

    def __init__(self, names: list, texts: list, shingle: int, containment: float, rows: int, miss: float, seed: int):
        words, counts = S.word_hashes(*text_buffers(pa.array(texts, pa.string())), S.ALNUM)
        h, n = S.distinct(*S.shingles(words, counts, shingle), len(texts))
        ends = np.cumsum(n)
        self.entries = [
            (name, h[e - k : e], k, math.ceil(containment * k - 1e-9), ladder(max(1, int(c) - shingle + 1)), int(c) if c < shingle else shingle)
            for name, e, k, c in zip(names, ends, n, counts, strict=True)
            if k
        ]
        self.rows, self.shingle = rows, shingle
        least = 1.0
        for _, _, m, need, c, _ in self.entries:
            stride, blocks = geometry(c)
            least = min(least, need / (stride * blocks + m - need))
        self.least_similarity = least
        self.bands = 1 if least >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - least**rows)))
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(0, 2**63, self.bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        # by words of a shingle: all shingles of the templates, and a coarse filter of them
        self.known = {}
        for k in {e[5] for e in self.entries}:
            every = np.unique(np.concatenate([e[1] for e in self.entries if e[5] == k]))
            coarse = np.zeros(1 << 16, bool)
            coarse[(every >> np.uint64(48)).astype(np.int64)] = True
            self.known[k] = (every, coarse)
        # by (class, words of a shingle): sorted band keys and their templates (the index travels: nothing larger than them)
        self.index = {}
        for c, k in sorted({(e[4], e[5]) for e in self.entries}):
            mine = [i for i, e in enumerate(self.entries) if (e[4], e[5]) == (c, k)]
            per_band = []
            for b in range(self.bands):
                keys = self._key(b, [np.array([(self.entries[i][1] * f).min() for i in mine]) for f in self._of(b)])
                order = np.argsort(keys)
                per_band.append((keys[order], np.array(mine)[order]))
            self.index[c, k] = per_band
        # by the same: the fewest shingles that make a find
        self.least = {x: min(e[3] for e in self.entries if (e[4], e[5]) == x) for x in self.index}

    def _of(self, band):
        return self.factors[band * self.rows : (band + 1) * self.rows]

    def _key(self, band, minima):
        key = np.full(len(minima[0]), band + 1, np.uint64)
        for m in minima:
            key = (key ^ m) * np.uint64(0x9FB21C651E98DF25)
            key = key ^ (key >> np.uint64(28))
        return key * np.uint64(0xD6E8FEB86659FD93)

    def candidates(self, h: np.ndarray, row: np.ndarray, rows: int, held: np.ndarray, c: int, k: int):
        """(first shingle of a window, template) that agree in some band; shingles come in order of rows.

        Only windows that hold as many shingles of templates as the least find of the class takes,
        counted by the places ``held`` of such shingles, can hold a template: these get values.
        """
        stride, blocks = geometry(c)
        width = stride * blocks
        stop = np.cumsum(np.bincount(row, minlength=rows))
        first = np.concatenate([[0], stop[:-1]])
        inside = held - first[row[held]]
        low, high = np.maximum(0, -(-(inside - width + 1) // stride)), inside // stride
        n = high - low + 1
        number = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        starts = np.unique(np.repeat(first[row[held]], n) + number * stride)
        inside = np.searchsorted(held, np.minimum(starts + width, stop[row[starts]])) - np.searchsorted(held, starts)
        starts = starts[inside >= self.least[c, k]]
        found = []
        step = max(1, 1_000_000 // width)  # bounds the arrays of long windows
        for a in range(0, len(starts), step):
            at = starts[a : a + step]
            place = at[:, None] + np.arange(width)
            beyond = place >= stop[row[at]][:, None]
            values = h[np.minimum(place, len(h) - 1)]
            for b, (keys, mine) in enumerate(self.index[c, k]):
                minima = []
                for f in self._of(b):
                    hashed = values * f
                    hashed[beyond] = np.uint64(0xFFFFFFFFFFFFFFFF)
                    minima.append(hashed.min(axis=1))
                key = self._key(b, minima)
                for x in np.flatnonzero(keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key):
                    lo, hi = np.searchsorted(keys, key[x], "left"), np.searchsorted(keys, key[x], "right")
                    found.extend((at[x], t) for t in mine[lo:hi])
        return np.unique(np.array(found, np.int64).reshape(-1, 2), axis=0)

    def scan(self, words: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(row, template, containment, first word, windows) of what each row holds."""
        rows, best = len(counts), {}
        ends = np.cumsum(counts)
        begin = ends - counts
        for k in sorted({k for _, k in self.index}):
            # shingles of k words in their order; a shorter row has none
            at = np.flatnonzero(np.arange(len(words)) + k <= np.repeat(ends, counts))
            row = np.repeat(np.arange(rows), counts)[at]
            h = S.folded(words, at, k)
            known, coarse = self.known[k]
            held = np.flatnonzero(coarse[(h >> np.uint64(48)).astype(np.int64)])
            held = held[np.isin(h[held], known)]
            if not len(held):
                continue
            stop = np.cumsum(np.bincount(row, minlength=rows))
            for c, kk in self.index:
                if kk != k:
                    continue
                stride, blocks = geometry(c)
                for s, t in self.candidates(h, row, rows, held, c, k).tolist():
                    window = h[s : min(s + stride * blocks, stop[row[s]])]
                    _, shingles, m, need, _, _ = self.entries[t]
                    here = np.isin(window, shingles)
                    share = len(np.unique(window[here]))
                    if share >= need:
                        r = int(row[s])
                        word = int(at[s + int(np.argmax(here))] - begin[r])
                        old = best.get((r, t), (0.0, word, 0))
                        best[r, t] = (max(old[0], share / m), min(old[1], word), old[2] + 1)
        return [(r, t, *v) for (r, t), v in sorted(best.items())]


def scan(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    shingle: int = 5,
    containment: float = 0.8,
    rows: int = 2,
    miss: float = 1e-4,
    seed: int = 7,
    template_bytes: int = 16_000_000,
) -> DataFrame:
    """A row per document and template it holds: ``doc_id``, ``license_id``, ``containment`` (largest
    share of the template's shingles in one window), ``first_word`` (where the first of them
    begins) and ``n_windows`` (windows that hold enough).  Without ``templates`` those of ``registered``
    are looked for.  Versions of a license that share most of their words are each found where one
    stands; the largest containment names it.

    A template of fewer than ``shingle`` words is one shingle as a whole; one without words is
    never found.  Null and empty texts hold nothing.  Rows with equal or null ids are judged each by
    itself.  Templates travel to the tasks: more than ``template_bytes`` of them is an error, scan them
    in several calls.  Documents are not shuffled.
    """
    templates = registered() if templates is None else templates
    if sum(len(t.encode()) for t in templates.values() if t) > template_bytes:
        raise ValueError(f"templates exceed {template_bytes} bytes")
    names = sorted(templates)
    known = carried(
        docs.sparkSession, Templates(names, [templates[n] for n in names], shingle, containment, rows, miss, seed)
    )

    def look(batches):
        index = known()
        for part, data, off in sliced(batches):
            words, counts = S.word_hashes(data, off, S.ALNUM)
            found = index.scan(words, counts) if index.entries else []
            yield pa.record_batch(
                [
                    part.column("doc_id").take(pa.array([f[0] for f in found], pa.int64())),
                    pa.array([index.entries[f[1]][0] for f in found], pa.string()),
                    pa.array([f[2] for f in found], pa.float64()),
                    pa.array([f[3] for f in found], pa.int64()),
                    pa.array([f[4] for f in found], pa.int64()),
                ],
                names=["doc_id", "license_id", "containment", "first_word", "n_windows"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(look, _SCHEMA)
