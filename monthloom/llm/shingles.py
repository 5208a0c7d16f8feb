"""Word and shingle hashes of many texts at once, by numpy.

A word's hash is a polynomial over its bytes modulo 2^64, got for all words of a stretch of
text from one running sum, then mixed.  Equal words have equal hashes wherever they stand.
Words and shingles are compared by these 64 bits.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEGMENT = 1 << 20
_POWERS: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_classes(word) -> tuple[np.ndarray, np.ndarray]:
    """From a rule on lower-cased bytes: which bytes belong to words, and A-Z lowered."""
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return np.array([bool(word(int(fold[b]))) for b in range(256)]), fold


#: Words are runs of anything but white space.
SPACED = byte_classes(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words are runs of digits, letters and everything beyond ASCII.
ALNUM = byte_classes(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def _powers(n: int):
    have = _POWERS.get("n", 0)
    if have < n:
        n = max(n, _SEGMENT + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
        _POWERS["n"] = n
    return _POWERS["up"], _POWERS["down"]


def word_hashes(data: np.ndarray, offsets: np.ndarray, classes=SPACED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each row."""
    is_word, fold = classes
    rows, total = len(offsets) - 1, len(data)
    inner = is_word[data]
    first, last = inner.copy(), inner.copy()
    first[1:] &= ~inner[:-1]
    last[:-1] &= ~inner[1:]
    # a word ends with its row
    edges = np.unique(offsets[1:-1])
    edges = edges[(edges > 0) & (edges < total)]
    first[edges] = inner[edges]
    last[edges - 1] = inner[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.bincount(np.searchsorted(offsets, starts, side="right") - 1, minlength=rows).astype(np.int64)
    out = np.empty(len(starts), np.uint64)
    w = 0
    while w < len(starts):
        a = starts[w]
        v = max(w + 1, int(np.searchsorted(ends, a + _SEGMENT, side="right")))
        b = ends[v - 1]
        up, down = _powers(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((fold[data[a:b]].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=sums[1:])
        s, e = starts[w:v] - a, ends[w:v] - a
        out[w:v] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        w = v
    return out, counts


def folded(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position ``at`` on."""
    h = np.full(len(at), k, np.uint64)
    for j in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[at + j]
    return mix(h)


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every shingle of ``k`` words; a shorter row is one shingle as a whole."""
    ends = np.cumsum(counts)
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(np.arange(len(words)) + k <= np.repeat(ends, counts))
    hashes, rows = [folded(words, at, k)], [row[at]]
    for c in range(1, k):
        short = np.flatnonzero(counts == c)
        hashes.append(folded(words, ends[short] - c, c))
        rows.append(short)
    return np.concatenate(hashes), np.concatenate(rows)


def distinct(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, in order, and how many each row has."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[keep], np.bincount(r[keep], minlength=n).astype(np.int64)
