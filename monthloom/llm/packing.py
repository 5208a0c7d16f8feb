"""Best-fit packing of texts into sequences of several permitted lengths.

Pieces are spread over blocks by a hash, each block is packed by itself: longest first, into the
open bin that leaves the least room.  Where none has room, a bin is opened whose capacity costs
least per token that can still go into it, given what is left of the block; at the end every
bin shrinks to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = "doc_id long, piece long, length long, bin_id long, bin_offset long, capacity long, used long"


@dataclass(frozen=True)
class Cost:
    """Cost of a sequence of ``c`` positions: ``fixed + c + quadratic * c^2``."""

    fixed: float = 32.0
    quadratic: float = 1 / 65_536

    def of(self, c):
        return self.fixed + c + self.quadratic * c * c


def pack_block(lengths: np.ndarray, capacities: tuple[int, ...], cost: Cost) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, in the given order, and (capacity, used) of each bin.

    No piece may be longer than the largest capacity.  Equal lengths keep their order.
    """
    caps = sorted(capacities)
    order = np.argsort(-lengths, kind="stable")
    left = int(lengths.sum())
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[tuple[int, int]] = []  # (free, -bin), so that of equal bins the oldest comes last
    capacity, used = [], []
    for i in order:
        need = int(lengths[i])
        at = bisect_left(room, (need, -len(capacity)))
        if at < len(room):
            free, minus = room.pop(at)
            b = -minus
        else:
            fits = [c for c in caps if c >= need]
            c = min(fits, key=lambda c: (cost.of(c) / min(c, max(left, 1)), c))
            b, free = len(capacity), c
            capacity.append(c)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += need
        left -= need
        if free > need:
            insort(room, (free - need, -b))
    used_a = np.array(used, np.int64)
    final = np.array(caps, np.int64)[np.searchsorted(caps, used_a)] if len(used_a) else np.zeros(0, np.int64)
    return bins, offsets, final, used_a


def pack(
    docs: DataFrame,
    length: str = "length",
    capacities: tuple[int, ...] = (512, 1024, 2048, 4096, 8192),
    cost: Cost | None = None,
    block_tokens: int = 8_000_000,
    block_pieces: int = 20_000,
) -> DataFrame:
    """Where every document goes: a row per piece with ``doc_id``, ``piece``, ``length``, ``bin_id``,
    ``bin_offset``, ``capacity`` and ``used`` (tokens in the bin).

    ``docs`` has ``doc_id`` and the token count ``length``.  A document longer than the largest
    capacity is cut into pieces of that capacity and a rest, numbered from 0; nothing is dropped.
    A null or negative length counts as 0; a document of length 0 is one piece of length 0.
    Rows with equal or null ids are separate documents.  A block holds about ``block_tokens`` tokens
    and ``block_pieces`` pieces, however large the table: pieces are spread by a hash of id, length,
    piece and input partition (so that a repeated id does not pile up), and pieces that fill the
    largest capacity by themselves, which need no company, are not shuffled at all.  ``bin_id``
    is unique in the result; negative numbers are the bins of full pieces.
    """
    cost = cost or Cost()
    caps = tuple(sorted(set(int(c) for c in capacities)))
    top = caps[-1]
    n = F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n"))
    totals = rows.agg(
        F.sum(F.col("n") % top).alias("tokens"), F.count("*").alias("pieces")
    ).first()
    blocks = int(max(1, -(-(totals["tokens"] or 0) // block_tokens), -(-totals["pieces"] // block_pieces)))

    whole = (F.col("n") / top).cast("long")
    full = (
        rows.where(F.col("n") >= top)
        .select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("piece"))
        .select(
            "doc_id",
            "piece",
            F.lit(top).cast("long").alias("length"),
            (-1 - F.monotonically_increasing_id()).alias("bin_id"),
            F.lit(0).cast("long").alias("bin_offset"),
            F.lit(top).cast("long").alias("capacity"),
            F.lit(top).cast("long").alias("used"),
        )
    )
    rest = (
        rows.where((F.col("n") % top != 0) | (F.col("n") == 0))
        .select("doc_id", whole.alias("piece"), (F.col("n") % top).alias("length"))
        .withColumn("block", F.pmod(F.xxhash64("doc_id", "length", "piece", F.spark_partition_id()), F.lit(blocks)).cast("int"))
    )

    def place(part: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]
        part = part.take(pc.sort_indices(part, sort_keys=order, null_placement="at_start"))
        bins, offsets, capacity, used = pack_block(part.column("length").to_numpy(), caps, cost)
        block = part.column("block")[0].as_py()
        numbers = {"bin_id": bins + (block << 32), "bin_offset": offsets, "capacity": capacity[bins], "used": used[bins]}
        return pa.table({c: part.column(c) for c in ("doc_id", "piece", "length")} | {k: pa.array(v) for k, v in numbers.items()})

    return rest.groupBy("block").applyInArrow(place, _SCHEMA).unionByName(full)
