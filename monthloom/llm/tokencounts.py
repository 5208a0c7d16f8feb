"""Token counts under a unigram model, without encoding every word again.

The distinct pre-tokens of a stretch of text are put in a trie - here their sorted order, in
which neighbours share a path from the root.  Going through the trie, the forward score of each
prefix (the best segmentation of its bytes) is computed once for all pre-tokens that begin with
it, and the count of pieces at a pre-token's end is stored.  A text's count is the sum of
the stored counts of its pre-tokens.
"""

from __future__ import annotations

import base64
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word with the blank before it; any other white space by itself.
PRETOKEN = r" ?[^\s]+|\s"


def load_pieces(path: str) -> tuple[dict[bytes, float], int]:
    """Pieces of a rank file with scores by Zipf's law on their rank, and the longest length."""
    pieces = {}
    with open(path, "rb") as file:
        for line in file:
            name, rank = line.split()
            pieces[base64.b64decode(name)] = -math.log(int(rank) + 2.0)
    return pieces, max(map(len, pieces))


class Trie:
    """Forward scores along the path of the last inserted pre-token, and counts at their ends."""

    def __init__(self, pieces: dict[bytes, float], longest: int, unknown: float = -50.0):
        self.pieces, self.longest, self.unknown = pieces, longest, unknown
        # which lengths a piece that ends in a byte can have: skips most slices
        lengths: dict[int, set] = {}
        for p in pieces:
            lengths.setdefault(p[-1], set()).add(len(p))
        self.lengths = [sorted(lengths.get(b, ())) for b in range(256)]
        self.visits = 0

    def counts(self, tokens: list[bytes]) -> list[int]:
        """Piece counts of sorted distinct ``tokens``; every shared prefix is scored once.

        Of segmentations with equal scores the one with fewer pieces counts.  A byte that no
        piece covers is a piece of its own with the score ``unknown``.
        """
        score, count = [0.0], [0]
        out, last = [], b""
        get, lengths = self.pieces.get, self.lengths
        for token in tokens:
            keep, most = 0, min(len(last), len(token))
            while keep < most and last[keep] == token[keep]:
                keep += 1
            del score[keep + 1 :]
            del count[keep + 1 :]
            for end in range(keep + 1, len(token) + 1):
                best, fewest = score[end - 1] + self.unknown, count[end - 1] + 1
                for n in lengths[token[end - 1]]:
                    if n > end:
                        break
                    s = get(token[end - n : end])
                    if s is not None:
                        s += score[end - n]
                        c = count[end - n] + 1
                        if s > best or (s == best and c < fewest):
                            best, fewest = s, c
                score.append(best)
                count.append(fewest)
                self.visits += 1
            out.append(count[-1])
            last = token
        return out


def count_tokens(docs: DataFrame, vocabulary: str, pretoken: str = PRETOKEN, remembered: int = 600_000, slice_rows: int = 2000) -> DataFrame:
    """Per document ``doc_id``, ``n_pretokens`` and ``n_tokens`` under the unigram model.

    ``vocabulary`` is a rank file all executors can read; its pieces cover every byte.  Whole texts
    are counted; a null or empty text has 0 of both.  Rows with equal or null ids each give a row.
    Nothing is shuffled: a task keeps the counts of at most ``remembered`` pre-tokens (plus those of
    one slice of rows) and starts over beyond that, so its memory does not grow with the data.
    """
    cut = pretoken

    def count(batches):
        pieces, longest = load_pieces(vocabulary)
        trie, split, known = Trie(pieces, longest), re.compile(cut).findall, {}
        for batch in batches:
            for a in range(0, batch.num_rows, slice_rows):
                part = batch.slice(a, slice_rows)
                found = [split(t) if t else () for t in part.column("text").to_pylist()]
                wanted = set().union(*found)
                if len(known) > remembered:
                    known = {}
                fresh = sorted((w.encode("utf-8", "replace"), w) for w in wanted if w not in known)
                known.update(zip((w for _, w in fresh), trie.counts([b for b, _ in fresh]), strict=True))
                yield pa.record_batch(
                    [
                        part.column("doc_id"),
                        pa.array([len(x) for x in found], pa.int64()),
                        pa.array([sum(map(known.__getitem__, x)) for x in found], pa.int64()),
                    ],
                    names=["doc_id", "n_pretokens", "n_tokens"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        count, "doc_id long, n_pretokens long, n_tokens long"
    )
