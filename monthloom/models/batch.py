"""Running a numpy kernel over many packed series at once.

A pandas UDF receives a batch of arrays.  Series of equal length are stacked into one
matrix, so a time loop advances thousands of series per numpy call; the batch size
bounds the memory.  As scalar UDFs the kernels are narrow: no shuffle, and the
partitioning by product survives.
"""

import numpy as np
import pandas as pd
import pyarrow as pa


def by_length(arrays: pd.Series, chunk: int = 1024):
    """Yield (positions, matrix) for series of equal length, at most ``chunk`` at a time."""
    lengths = arrays.map(lambda a: -1 if a is None else len(a)).to_numpy()
    for n in np.unique(lengths):
        if n < 0:
            continue
        at = np.flatnonzero(lengths == n)
        for k in range(0, len(at), chunk):
            part = at[k : k + chunk]
            yield part, np.array([arrays.iloc[j] for j in part], dtype=float).reshape(len(part), n)


def list_bounds(lists):
    """Begin and length of every list of an Arrow array; a missing one is empty."""
    off = lists.offsets.to_numpy()
    return off[:-1], np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, np.diff(off))


def numbers(values):
    """An Arrow array as doubles; what is missing is not a number."""
    return values.to_numpy(zero_copy_only=False).astype(float)


def picked(lists, at, width: int):
    """Of lists of lists of numbers: those at the places ``at`` (rows, m) of all inner lists, as (rows, m, width), and which are there."""
    first, widths = list_bounds(lists.values)
    flat = lists.values.values
    column, inner = np.arange(width), np.maximum(at, 0)
    if not len(first) or not len(flat):
        return np.zeros((*at.shape, width)), np.zeros((*at.shape, width), bool)
    there = (column < widths[inner][..., None]) & (at >= 0)[..., None]
    place = np.where(there, first[inner][..., None] + column, 0)
    there &= flat.is_valid().to_numpy(zero_copy_only=False)[place]
    return numbers(flat)[place], there


def as_lists(values, lengths, valid=None, missing=None):
    """An Arrow array of lists of the given lengths from all their numbers; null where not ``valid``, null numbers where ``missing``."""
    off = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    mask = None if valid is None else pa.array(~valid)
    return pa.ListArray.from_arrays(off, pa.array(values, pa.float64(), mask=missing), mask=mask)
