"""Spelling variants: words one edit apart, found by blocked Gram matrices of their letter counts.

Letter counts of words one edit apart are at a squared distance of 1 (a letter more or less) or 2
(a letter replaced).  Words of adjacent lengths are compared in blocks, whose distances come from
one matrix product; the few pairs at most two apart are then compared letter by letter.

Comparing all words of a length would grow with the square of the vocabulary, so length blocks are
divided further without losing a pair: the alphabet is dealt into four parts of like weight, and an
edit touches the counts of two parts at most.  Every such pair of words thus agrees in all counts
of some two parts; a word enters one block for each of the six choices of two parts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.llm.common import sliced, stored

#: a-z, then U+00C0 to U+00FF.
LETTERS = 26 + 64
PARTS = 4
CHOICES = tuple(combinations(range(PARTS), 2))
#: Words of a block that are compared in one task; larger blocks are cut into tiles of about this many.
TILE = 1024
#: Bytes of counted words that a task holds before it hands them on.
HELD_BYTES = 24_000_000
#: Bytes of the letter counts and distances of blocks that are multiplied together.
BLOCK_BYTES = 8_000_000
#: Pairs at most two apart that are verified together.
PAIRS = 100_000
#: Bytes of rows after which a task begins to compare.
ROW_BYTES = 500_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])


def _rows(counts: Counter) -> pa.RecordBatch:
    words = pa.array(list(counts), pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], schema=_COUNTED)


def count_words(docs: DataFrame, min_length: int = 5, min_count: int = 3, misspell_every: int = 0) -> DataFrame:
    """``word``, ``n``: maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased, over all texts.

    Kept are words of at least ``min_length`` letters with at least ``min_count`` occurrences.
    With ``misspell_every`` m, a run in a document loses one letter where m divides the crc32 h of
    ``<doc_id>:<run>``: the letter at h modulo its length.  Null or empty texts have no words, a
    null ``doc_id`` counts as an empty one, repeated rows count again; an empty table gives none.
    A text of any length is read whole.  Other columns are not looked at.
    """
    pattern = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % max(min_length, 1))

    def count(batches):
        counts, since, crc = Counter(), 0, zlib.crc32
        for part, data, off in sliced(batches):
            text = data.tobytes().translate(_LOWER)
            ids = part.column("__id").to_pylist()
            for doc, a, b in zip(ids, off[:-1].tolist(), off[1:].tolist(), strict=True):
                runs = pattern.findall(text, a, b)
                counts.update(runs)
                if not misspell_every:
                    continue
                start = crc((doc + ":").encode())
                for run in [r for r in set(runs) if not crc(r, start) % misspell_every]:
                    n, word = runs.count(run), run.decode()
                    at = crc(run, start) % len(word)
                    counts[run] -= n
                    counts[(word[:at] + word[at + 1 :]).encode()] += n
            since += len(text)
            if since > HELD_BYTES and (len(counts) > HELD_BYTES // 100 or sum(map(len, counts)) > HELD_BYTES):
                yield _rows(counts)
                counts, since = Counter(), 0
        if counts:
            yield _rows(counts)

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), "text")
    counted = texts.mapInArrow(count, "word string, n long")
    return (
        counted.groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= min_count) & (F.length("word") >= min_length))
    )


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letter numbers of all words in a row, and where each word begins."""
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    off = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if len(words) and off[-1] > off[0] else np.zeros(0, np.uint8)
    first = raw != 0xC3
    letter = np.where(raw >= 0x80, raw.astype(np.int16) - 0x80 + 26, raw.astype(np.int16) - 97)
    begins = np.concatenate(([0], np.cumsum(first)))[off - off[0]]
    return letter[first].astype(np.uint8), begins


def _counts(letters: np.ndarray, begins: np.ndarray) -> np.ndarray:
    rows = len(begins) - 1
    row = np.repeat(np.arange(rows), np.diff(begins))
    return np.bincount(row * LETTERS + letters, minlength=rows * LETTERS).reshape(rows, LETTERS).astype(np.int32)


def _alphabet(words: DataFrame) -> np.ndarray:
    """The part of each letter: the most frequent first, each to the lightest part.  90 numbers at most come to the driver."""

    def tally(batches):
        total = np.zeros(LETTERS, np.int64)
        for batch in batches:
            total += np.bincount(_letters(batch.column("word"))[0], minlength=LETTERS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["letter", "n"])

    found = words.select("word").mapInArrow(tally, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()
    part, weight = np.zeros(LETTERS, np.int64), [0] * PARTS
    for r in sorted(found, key=lambda r: (-r["n"], r["letter"])):
        lightest = weight.index(min(weight))
        part[r["letter"]] = lightest
        weight[lightest] += r["n"]
    return part


def _signatures(counts: np.ndarray, part: np.ndarray) -> np.ndarray:
    """One number per choice of two parts, equal where all counts of these letters are."""
    weights = np.random.default_rng(13).integers(1, 2**63, (LETTERS, len(CHOICES)), dtype=np.uint64) | np.uint64(1)
    for k, chosen in enumerate(CHOICES):
        weights[~np.isin(part, chosen), k] = 0
    return counts.astype(np.uint64) @ weights


def _verified(x: np.ndarray, y: np.ndarray, letters: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Which pairs (x no longer than y) are exactly one edit apart."""
    length = np.diff(begins)
    good = np.zeros(len(x), bool)
    order = np.argsort(length[y], kind="stable")
    at = 0
    while at < len(order):
        width = int(length[y[order[at]]])
        width = max(16, 1 << (width - 1).bit_length())
        upto = int(np.searchsorted(length[y[order]], width, side="right"))
        together = max(BLOCK_BYTES // (32 * width), 1)
        for a in range(at, upto, together):
            chosen = order[a : min(a + together, upto)]
            p, q = x[chosen], y[chosen]
            col = np.arange(width)
            inside = col < length[p][:, None]
            last = max(len(letters) - 1, 0)
            left = letters[np.minimum(begins[p][:, None] + col, last)] == letters[np.minimum(begins[q][:, None] + col, last)]
            shift = (length[q] - length[p])[:, None]
            right = letters[np.minimum(begins[p][:, None] + col, last)] == letters[np.minimum(begins[q][:, None] + col + shift, last)]
            before = np.where(inside & ~left, col, width).min(axis=1)
            after = np.where(inside & ~right, col, -1).max(axis=1)
            # All letters before the first difference agree from the left, all after the edit from the right.
            good[chosen] = np.where(shift[:, 0] == 0, before == after, after < before)
        at = upto
    return good


def _near_in_blocks(edges, side, tile, cross, length, counts):
    """Index pairs (the first no longer) at a squared distance of 1 or 2, for rows in blocks that begin at ``edges``."""
    sizes = np.diff(edges)
    # Small blocks are filled up to a power of two and multiplied together, large ones alone.
    filled = np.array([1 << (s - 1).bit_length() if s <= 512 else s for s in sizes.tolist()])
    for size in sorted(set(filled[sizes > 1].tolist())):
        blocks = np.flatnonzero((filled == size) & (sizes > 1))
        together = max(BLOCK_BYTES // (size * (LETTERS + 2 * size) * 4), 1)
        for a in range(0, len(blocks), together):
            some = blocks[a : a + together]
            real = np.arange(size) < sizes[some][:, None]
            index = np.where(real, edges[some][:, None] + np.arange(size), edges[some][:, None])
            # Squares of counts stay exact: below 2**24 in the short form, below 2**53 in the long one.
            block = counts[index].astype(np.float32 if length[index].max() <= 2000 else np.float64)
            square = np.einsum("bij,bij->bi", block, block)
            apart = block @ block.transpose(0, 2, 1)
            apart *= -2
            apart += square[:, :, None]
            apart += square[:, None, :]
            near = (apart > 0.5) & (apart < 2.5)
            near &= (real & (side[index] == 0))[:, :, None]
            near &= real[:, None, :]
            b, i, j = np.nonzero(near)
            x, y = index[b, i], index[b, j]
            # Two words of the shorter length meet twice in a product; words of one tile are compared where it is alone.
            keep = ((side[y] == 1) | (x < y)) & ((cross[x] == 0) | (tile[x] != tile[y]))
            x, y = x[keep], y[keep]
            for k in range(0, len(x), PAIRS):
                yield x[k : k + PAIRS], y[k : k + PAIRS]


def _compare(batches, part):
    """Near pairs among rows that stand together by block."""
    out = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])

    def blocks_of(table):
        block = table.column("block").to_numpy()
        pair = table.column("pair").to_numpy()
        edges = np.flatnonzero((block[1:] != block[:-1]) | (pair[1:] != pair[:-1])) + 1
        return np.concatenate(([0], edges, [len(block)]))

    def pairs(table):
        table = table.combine_chunks()
        words, n = (table.column(c).chunk(0) for c in ("word", "n"))
        choice, side, tile, cross = (table.column(c).to_numpy() for c in ("choice", "side", "tile", "cross"))
        letters, begins = _letters(words)
        counts = _counts(letters, begins)
        sign = _signatures(counts, part)
        for x, y in _near_in_blocks(blocks_of(table), side, tile, cross, np.diff(begins), counts):
            # A pair may share several blocks; the first choice of parts in which both agree has it.
            first = (np.argmax(sign[x] == sign[y], axis=1) == choice[x]) & (choice[x] == choice[y])
            x, y = x[first], y[first]
            good = _verified(x, y, letters, begins)
            one, other = np.concatenate((x[good], y[good])), np.concatenate((y[good], x[good]))
            if len(one):
                yield pa.RecordBatch.from_arrays([words.take(one), words.take(other), n.take(other)], schema=out)

    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += batch.nbytes
        if size < ROW_BYTES:
            continue
        table = pa.Table.from_batches(waiting)
        last = int(blocks_of(table)[-2])
        if last:
            yield from pairs(table.slice(0, last))
        waiting = table.slice(last).to_batches()
        size = sum(b.nbytes for b in waiting)
    if waiting:
        yield from pairs(pa.Table.from_batches(waiting))


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``near``, ``near_n``: both directions of every pair one edit apart.

    ``words`` holds distinct ``word`` with ``n``; it is read several times, so store it.  Blocks
    larger than ``TILE`` are cut into tiles, every two of which meet in one task.
    """
    part = _alphabet(words)

    def place(batches):
        for batch in batches:
            column = batch.column("word")
            letters, begins = _letters(column)
            sign = _signatures(_counts(letters, begins), part)
            length = np.diff(begins)
            for k in range(len(CHOICES)):
                for side in (0, 1):
                    shorter = (length - side).astype(np.uint64)
                    block = (sign[:, k] + shorter * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(block.view(np.int64)),
                            pa.array(np.full(len(length), k, np.int32)),
                            pa.array(np.full(len(length), side, np.int32)),
                            column.cast(pa.string()),
                            batch.column("n"),
                        ],
                        names=["block", "choice", "side", "word", "n"],
                    )

    schema = "block long, choice int, side int, word string, n long"
    placed = words.select("word", "n").mapInArrow(place, schema)
    large = placed.groupBy("block").agg(F.count("*").alias("size")).where(F.col("size") > TILE)
    large = large.select("block", F.ceil(F.col("size") / TILE).cast("int").alias("tiles"))
    tiled = placed.join(stored(large, "large-blocks"), "block", "left")
    tiles, tile, other = F.coalesce("tiles", F.lit(1)), F.col("tile"), F.col("other")
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("word"), tiles).cast("int"))
    # A tile meets every tile of its block, and itself alone.
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    tiled = tiled.select(
        "block", "choice", "side", "word", "n", "tile",
        (F.least(tile, other).cast("long") * tiles + F.greatest(tile, other)).alias("pair"),
        (tile != other).cast("int").alias("cross"),
    )
    together = tiled.repartition("block", "pair").sortWithinPartitions("block", "pair")
    return together.mapInArrow(lambda batches: _compare(batches, part), "word string, near string, near_n long")


def variants(words: DataFrame) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root`` of distinct ``word`` with ``n``.

    ``n_near`` counts the words one edit apart.  The form is the most frequent of them (ties: the
    first in code-point order) if it occurs at least twice as often, else null.  The root is where
    forms lead, the word itself without one: a form is at least twice as frequent, so there is no
    circle and 62 steps at most, which six doublings cover.  An empty table gives an empty one.
    """
    words = stored(words.select("word", "n"), "words")
    near = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("top")
    )
    better = F.col("top.m").isNotNull() & (-F.col("top.m") >= 2 * F.col("n"))
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(better, F.col("top.w")).alias("form"), F.when(better, -F.col("top.m")).alias("form_n"),
    )
    found = stored(found, "forms")
    roots = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
