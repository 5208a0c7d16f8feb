"""Boosted trees per product, grown level by level for many products at a time.

A product has at most as many rows as its window has months, so its trees are grown where its
packed row lies, without any shuffle of their own.  In a task the products of a slice advance
together: rows know their node, a level is one aggregate of the residuals by (product, node,
feature, bin) and one choice of split per node, whatever the number of products.  The trees come
back as data: arrays of nodes, or rows of a table, which column expressions score, sum up and explain.
"""

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from monthloom.functions.expressions import array_sum
from monthloom.models.batch import as_lists, list_bounds, numbers, picked
from monthloom.operators.calendar import pack
from monthloom.settings import LAGS, ROLLING_WINDOWS

#: A split sends rows up to ``at`` to node ``left``, others to the one after it; leaves have no ``left``.
NODE = "struct<feature:int,at:double,left:int,value:double,cover:double,gain:double>"
TREES = f"struct<base:double,trees:array<array<{NODE}>>>"
#: What grows trees differently per row of the table.
OPTIONS = "struct<rounds:int,depth:int,rate:double,min_child_weight:double,subsample:double,colsample:double>"
#: Values (rows by features, of all fits) of the products that grow together.
SLICE_CELLS = 200_000
#: Of them, those whose cuts are compared together: few enough to stay in a core's cache.
BLOCK_CELLS = 20_000
BINS = 64
#: Products whose trees are scored together, and nodes by rows that are attributed together.
SCORED = 32
ATTRIBUTED = 400_000
SHRINK = 1.0


def _uniform(*keys):
    """A number in [0, 1) for each combination of integers, the same wherever it is drawn."""
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for k in keys:
            h = (h ^ np.asarray(k).astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
    return (h >> np.uint64(11)) / float(1 << 53)


def _binned(x, real):
    """Bin of every value among its product's values of the feature, the value between each bin and the next, and the rows by value."""
    S, n, K = x.shape
    ordered = np.where(real[:, :, None], x, np.inf)
    order = np.argsort(ordered, axis=1, kind="stable")
    values = np.take_along_axis(ordered, order, axis=1)
    there = np.broadcast_to((np.arange(n) < real.sum(axis=1)[:, None])[:, :, None], values.shape)
    fresh = np.concatenate([np.zeros((S, 1, K), bool), (values[:, 1:] != values[:, :-1]) & there[:, 1:]], axis=1)
    rank = np.cumsum(fresh, axis=1)
    distinct = rank[:, -1:, :] + 1
    bins = np.where(distinct > BINS, rank * BINS // distinct, rank)
    codes = np.zeros((S, n, K), np.int64)
    np.put_along_axis(codes, order, np.where(there, bins, 0), axis=1)
    B = int(bins[there].max(initial=0)) + 1
    s, i, k = np.nonzero(there)
    top, low = np.full((S, K, B), np.nan), np.full((S, K, B), np.nan)
    top[s, k, bins[s, i, k]] = values[s, i, k]  # ascending, so the last one stays
    s, i, k = s[::-1], i[::-1], k[::-1]
    low[s, k, bins[s, i, k]] = values[s, i, k]
    return codes, (top[:, :, :-1] + low[:, :, 1:]) / 2, order


def _fixed_point(rest, seen):
    """Residuals as integers, whose sums are exact in any order; their scale, which is a power of two, by product."""
    bits = min(52, 62 - int(rest.shape[1]).bit_length())
    largest = np.where(seen, np.abs(rest), 0.0).max(axis=1)
    exponent = np.frexp(np.where(np.isfinite(largest), largest, 0.0))[1]
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.rint(np.ldexp(np.where(np.isfinite(largest)[:, None], rest, 0.0), (bits - exponent)[:, None])).astype(np.int64)
        return whole.ravel(), np.ldexp(1.0, exponent) ** 2 * 4.0**-bits, np.isfinite(largest)


def _best_cuts(rows, cods, count, owner, whole, factor, low, open_cols, sums):
    """The best cut of every open node: won, feature, bin and rows to its left, scaled gain.

    ``rows`` and ``cods`` (K, P) hold the rows of the nodes, one after the other, by ascending bin of each feature:
    the sums to the left of every cut are one running sum.  With c of a node's rows to the left, the gain of a cut grows
    with the distance of its sum from the node's sum * (c + SHRINK) / (rows + 2 * SHRINK), whatever the feature.  So
    only the largest and the smallest sum are kept of all features, and gains, to their nine digits, are worked out only for
    the cuts that come within two units of the node's best.  ``sums`` is room for K * P numbers.
    """
    (K, P), N = rows.shape, len(count)
    last = np.cumsum(count)
    start = last - count
    of = np.repeat(np.arange(N), count)
    # sums are exact, so those of whole nodes are the same by every feature
    ends = np.cumsum(whole.take(rows[0])).take(last - 1)
    total = np.diff(ends, prepend=0)
    # of every node what its rows need
    unit = factor.take(owner)
    fewest = np.ceil(np.minimum(low, P)).astype(np.int64)
    each = np.stack([start, count, fewest, ends - total]).take(of, axis=1)
    c = np.arange(1, P + 1) - each[0]
    rest = each[1] - c
    more = c + SHRINK
    slope = total / (count + 2 * SHRINK)
    middle = each[3] + np.rint(slope.take(of) * more).astype(np.int64)
    sums = sums[: K * P].reshape(K, P)
    ties = cods[:, 1:] == cods[:, :-1]
    all_open = open_cols.all()
    most, least = np.full(P, np.iinfo(np.int64).min), np.full(P, np.iinfo(np.int64).max)
    step = max(BLOCK_CELLS // P, 1)
    for k in range(0, K, step):
        left = sums[k : k + step]
        np.cumsum(whole.take(rows[k : k + step]), axis=1, out=left)
        # a cut between equal values, or by a feature that is not drawn, is none
        np.copyto(left[:, :-1], middle[:-1], where=ties[k : k + step])
        if not all_open:
            np.copyto(left, middle, where=~open_cols[owner].T[k : k + step, of])
        np.maximum(most, left.max(axis=0), out=most)
        np.minimum(least, left.min(axis=0), out=least)
    far = np.maximum(most - middle, middle - least).astype(float)
    near = (1 / more + 1 / (rest + SHRINK)) * far
    near *= far
    near *= unit.take(of)
    near += (unit * total.astype(float) ** 2 * (1 / (count + 2 * SHRINK) - 1 / (count + SHRINK))).take(of)
    near[(c < each[2]) | (rest < each[2])] = 0.0
    best = np.maximum(np.maximum.reduceat(near, start) - 2, 0.25)
    here = np.flatnonzero(near > best.take(of))
    at_node, c, rest = of.take(here), c.take(here), rest.take(here)
    f, many, total = unit.take(at_node), count.take(at_node), total.take(at_node)
    left = sums.take(here, axis=1) - each[3].take(here)
    gain = left.astype(float) ** 2 * (f / (c + SHRINK)) + (total - left).astype(float) ** 2 * (f / (rest + SHRINK))
    gain = np.rint(gain - f * total.astype(float) ** 2 / (many + SHRINK))
    gain[ties.take(here, axis=1)] = 0.0
    if not all_open:
        gain[~open_cols[owner[at_node]].T] = 0.0
    best, top = gain.max(axis=0), np.zeros(N)
    np.maximum.at(top, at_node, best)
    won = top > 0
    k, at = gain.argmax(axis=0), np.flatnonzero((best == top[at_node]) & won[at_node])
    # the first feature and the lowest value of equal ones
    at = at[np.lexsort((at, k[at], at_node[at]))]
    at = at[np.flatnonzero(np.diff(at_node[at], prepend=-1))]
    return won, k[at], cods[k[at], here[at]], c[at], top[won]


def grow(x, y, real, options, seed=None):
    """Trees of S products: ``x`` (S, n, K), ``y`` and ``real`` (S, n), ``options`` a dict of arrays (S,).

    Gains are compared to nine digits of the product's own variance; of equal ones the first feature and
    the lowest value win.  Returns the means and, per round, node arrays (S, M) with the node counts.

    A level works on the rows of the nodes that are still open, once per feature, however many nodes and values there are.
    """
    S, n, K = x.shape
    rounds, depth, rate, least, rows_share, cols_share = (options[o] for o in OPTION_NAMES)
    seed = np.zeros(S, np.int64) if seed is None else seed
    codes, between, order = _binned(np.round(x, 9), real)  # values that agree to nine decimals are one value
    held = real.sum(axis=1)
    count = np.maximum(held, 1)
    base = np.where(real, y, 0).sum(axis=1) / count
    rest = np.where(real, y - base[:, None], 0.0)
    spread = np.maximum((rest**2).sum(axis=1), 1e-300)
    M = min(2 ** (int(depth.max(initial=0)) + 1), 2 * n + 1)
    there = np.arange(n) < held[:, None]
    all_rows = (order.transpose(2, 0, 1) + (np.arange(S) * n)[:, None])[:, there]
    all_cods = np.take_along_axis(codes.reshape(S * n, K).T.astype(np.int16), all_rows, axis=1)
    room, flat_codes, flat_real = np.empty(all_rows.size, np.int64), codes.astype(np.int16).ravel(), real.ravel()
    first_node = np.arange(S) * M
    root = np.repeat(first_node, n)  # nodes of all products are numbered through
    grown = []
    for t in range(int(rounds.max(initial=0))):
        alive = (rounds > t) & (held > 0)
        seen = real & alive[:, None]
        if (rows_share < 1).any():
            seen &= _uniform(seed[:, None], t, np.arange(n)) < rows_share[:, None]
        open_cols = np.ones((S, K), bool)
        if (cols_share < 1).any():
            draw = _uniform(seed[:, None], t, np.arange(K) + (1 << 20))
            wanted = np.maximum(np.ceil(cols_share * K), 1)
            open_cols = np.argsort(np.argsort(draw, axis=1), axis=1) < wanted[:, None]
        feature, left, limit = (np.full(S * M, -1) for _ in range(3))
        at, gains = np.full(S * M, np.nan), np.zeros(S * M)
        node, last, levels = root.copy(), np.ones(S, np.int64), []
        whole, unit, usable = _fixed_point(rest, seen)
        factor = 1e9 * unit / spread
        size = seen.sum(axis=1)
        owner = np.flatnonzero((size >= 2 * least) & (size > 1) & (depth > 0) & usable)
        where, count = first_node[owner], size[owner]
        chosen = np.zeros(S, bool)
        chosen[owner] = True
        chosen = (seen & chosen[:, None]).ravel()
        rows, cods = all_rows, all_cods
        if count.sum() < rows.shape[1]:
            kept = np.flatnonzero(chosen.take(rows)).reshape(K, -1)
            rows, cods = rows.take(kept), cods.take(kept)
        level = 0
        while rows.size:
            level += 1
            won, k, b, lower, top = _best_cuts(rows, cods, count, owner, whole, factor, np.maximum(least, 1)[owner], open_cols, room)
            owner, where, count = owner[won], where[won], count[won]
            if not len(owner):
                break
            # nodes are numbered level by level, from left to right
            by = np.argsort(where)
            nth = np.empty(len(by), np.int64)
            nth[by] = np.arange(len(by)) - np.searchsorted(owner[by], owner[by])
            child = last[owner] + 2 * nth
            feature[where], at[where], gains[where], left[where], limit[where] = k, between[owner, k, b], top / 1e9, child, b
            child = child + first_node[owner]
            last = last + 2 * np.bincount(owner, minlength=S)
            levels.append((where, child))
            # all rows move on, also those that were not drawn
            moving = np.flatnonzero((left.take(node) >= 0) & flat_real)
            old = node[moving]
            now = flat_codes.take(moving * K + feature.take(old)) > limit.take(old)
            node[moving] = old - old % M + left.take(old) + now
            # a node goes on if it may be cut again; its rows stay in the order of every feature
            parts = []
            goes = np.zeros(S * M, np.int8)
            for side, held_rows in ((0, lower), (1, count - lower)):
                on = (held_rows >= 2 * least[owner]) & (held_rows > 1) & (level < depth[owner])
                goes[child[on] + side] = side + 1
                parts.append((owner[on], child[on] + side, held_rows[on]))
            owner, where, count = (np.concatenate(p) for p in zip(*parts, strict=True))
            if not len(owner):
                break
            mark = goes.take(node).take(rows)
            kept = np.concatenate([np.flatnonzero(mark == side).reshape(K, -1) for side in (1, 2)], axis=1)
            rows, cods = rows.take(kept), cods.take(kept)
        cover, value = _node_sums(seen.ravel(), node, rest.ravel(), levels, S * M)
        value = np.repeat(rate, M) * value / (cover + SHRINK)
        rest = rest - np.where(real & alive[:, None], value.take(node).reshape(S, n), 0.0)
        grown.append((np.where(alive, last, 0), *(v.reshape(S, M) for v in (feature, at, left, value, cover, gains))))
    return base, grown


def _node_sums(seen, node, rest, levels, nodes):
    """Rows and sum of residuals of every node: those of the leaves, then added up towards the root."""
    key, rest = (node, rest) if seen.all() else (node[seen], rest[seen])
    cover = np.bincount(key, minlength=nodes).astype(float)
    total = np.bincount(key, rest, minlength=nodes)
    for where, child in reversed(levels):
        for add in (cover, total):
            add[where] = add[child] + add[child + 1]
    return cover, total


OPTION_NAMES = ("rounds", "depth", "rate", "min_child_weight", "subsample", "colsample")


def _as_arrow(base, grown, ok):
    """The struct ``TREES`` of each product."""
    S = len(base)
    counts = np.stack([g[0] for g in grown], axis=1) if grown else np.zeros((S, 0), np.int64)
    parts = [np.stack([g[c] for g in grown], axis=1) if grown else np.zeros((S, 0, 1)) for c in range(1, 7)]
    keep = np.flatnonzero(np.arange(parts[0].shape[2]) < counts[:, :, None])
    feature, at, left, value, cover, gain = (p.take(keep) for p in parts)
    leaf = left < 0
    fields = [
        pa.array(feature, pa.int32(), mask=leaf), pa.array(at, pa.float64(), mask=leaf), pa.array(left, pa.int32(), mask=leaf),
        pa.array(value), pa.array(cover), pa.array(gain),
    ]
    nodes = pa.StructArray.from_arrays(fields, ["feature", "at", "left", "value", "cover", "gain"])
    some = counts[counts > 0]
    per_tree = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(some))).astype(np.int32), nodes)
    per_row = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum((counts > 0).sum(axis=1)))).astype(np.int32), per_tree)
    return pa.StructArray.from_arrays([pa.array(base), per_row], ["base", "trees"], mask=pa.array(~ok))


def _padded(lists: pa.ListArray, width: int, depth: int):
    """Lists (of lists) of numbers as a dense array, and the length of each."""
    off = lists.offsets.to_numpy()
    n = np.diff(off)
    inner = lists.values.slice(off[0], off[-1] - off[0])
    if depth == 2:
        flat = inner.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
        out = np.zeros((len(n), max(int(n.max(initial=0)), 1), width))
    else:
        flat = inner.to_numpy(zero_copy_only=False).astype(float)
        out = np.zeros((len(n), max(int(n.max(initial=0)), 1)))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(off[:-1] - off[0], n)] = flat
    return out, n


class Reading:
    """What the trees of a row are read for: a kernel, its result type and the columns that it takes besides the trees.

    ``over`` reads a column of trees.  Given to :func:`grow_trees`, a reading happens where the trees grow, which then never
    leave their task: a product's trees are a thousand times as large as what they are read for.
    """

    def __init__(self, result: str, kernel, *inputs: Column, then=None):
        self.result, self.kernel, self.inputs, self.then = result, kernel, inputs, then or (lambda found: found)

    def over(self, trees: Column) -> Column:
        kernel = self.kernel

        @F.arrow_udf(self.result)
        def read(*columns: pa.Array) -> pa.Array:
            return kernel(Forest(columns[0]), *columns[1:])

        return self.then(read.asNondeterministic()(trees, *self.inputs))


def grow_trees(
    df: DataFrame, features: int, fits: dict[str, Column], x: str = "x", y: str = "target", options: Column | None = None,
    reads: dict[str, tuple[str, Reading]] | None = None, **given,
) -> DataFrame:
    """Adds a column of trees (``TREES``) for each of ``fits``: name -> number of leading rows to fit on.

    ``x ARRAY<ARRAY<DOUBLE>>`` has ``features`` values for each row, ``y ARRAY<DOUBLE>`` its target; null
    values count as 0, a fit on no rows is null.  Parameters are those of ``OPTION_NAMES`` by name, or a
    struct column of them per row of the table.  Nothing is shuffled.

    With ``reads``, name -> (fit, :class:`Reading`), the columns added are what the trees are read for, instead of the trees.
    """
    defaults = {"rounds": 100, "depth": 6, "rate": 0.1, "min_child_weight": 1.0, "subsample": 1.0, "colsample": 1.0} | given
    if options is None:
        options = F.struct(*[F.lit(defaults[o]).alias(o) for o in OPTION_NAMES])
    names, counts = list(fits), F.array(*[F.coalesce(c, F.lit(0)).cast("int") for c in fits.values()])
    who = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c in ("product", "trial")]), F.lit(1 << 30))
    zero = lambda v: F.coalesce(v.cast("double"), F.lit(0.0))
    rows = F.transform(F.slice(x, 1, F.size(y)), lambda r: F.transform(F.slice(r, 1, features), zero))
    ready = df.withColumns(
        {"_x": F.coalesce(rows, F.array()), "_y": F.coalesce(F.transform(y, zero), F.array()), "_m": counts, "_o": options.cast(OPTIONS), "_s": who}
    )
    reads = reads or {}
    taken = {name: [f"_{name}_{k}" for k in range(len(r.inputs))] for name, (_, r) in reads.items()}
    ready = ready.withColumns({c: v for name, (_, r) in reads.items() for c, v in zip(taken[name], r.inputs, strict=True)})
    kernels = {name: (fit, r.kernel) for name, (fit, r) in reads.items()}

    def fit(batches):
        for whole in batches:
            longest = max(pc.max(pc.list_value_length(whole.column("_y"))).as_py() or 1, 1) if whole.num_rows else 1
            step = max(SLICE_CELLS // (longest * max(features, 1) * max(len(names), 1)), 1)
            slices = -(-whole.num_rows // step)
            for a, b in pairwise(whole.num_rows * k // slices for k in range(slices + 1) if slices):
                yield grown_batch(whole.take(pa.array(np.arange(a, b))))  # only its own values, not a view of all

    def grown_batch(batch):
        xs, n = _padded(batch.column("_x"), features, 2)
        ys, _ = _padded(batch.column("_y"), 1, 1)
        chosen = batch.column("_o").flatten()
        p = {o: c.to_numpy(zero_copy_only=False) for o, c in zip(OPTION_NAMES, chosen, strict=True)}
        upto, _ = _padded(batch.column("_m"), 1, 1)
        seed = batch.column("_s").to_numpy()
        columns, S = [batch.column(c) for c in df_names], len(n)
        # the fits grow side by side, like further products
        use = np.minimum(upto[:, : len(names)], n[:, None]).T.ravel()
        xs, ys, seed = (np.concatenate([v] * len(names)) for v in (xs, ys, seed))
        p = {o: np.concatenate([v] * len(names)) for o, v in p.items()}
        base, grown = grow(xs, ys, np.arange(ys.shape[1]) < use[:, None], p, seed)
        owns = [slice(f * S, (f + 1) * S) for f in range(len(names))]
        trees = {name: _as_arrow(base[own], [[v[own] for v in g] for g in grown], use[own] > 0) for name, own in zip(names, owns, strict=True)}
        if kernels:
            forests = {name: Forest(t) for name, t in trees.items()}
            found = [kernel(forests[name], *[batch.column(c) for c in taken[out]]) for out, (name, kernel) in kernels.items()]
            return pa.RecordBatch.from_arrays([*columns, *found], names=[*df_names, *kernels])
        return pa.RecordBatch.from_arrays([*columns, *trees.values()], names=[*df_names, *names])

    df_names = df.columns
    added = {name: r.result for name, (_, r) in reads.items()} or dict.fromkeys(names, TREES)
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.DataType.fromDDL(t)) for c, t in added.items()]])
    grown = ready.mapInArrow(fit, schema)
    return grown.withColumns({name: r.then(F.col(name)) for name, (_, r) in reads.items()}) if reads else grown


def tree_score(trees: Column, x: Column) -> Column:
    """The prediction for one array of feature values: every tree is walked down to its leaf."""

    def leaf(tree):
        def down(at, _):
            node = F.get(tree, at)
            right = (F.get(x, node["feature"]) > node["at"]).cast("int")
            return F.when(node["left"].isNull(), at).otherwise(node["left"] + right)

        # a tree of m nodes is less than m / 2 levels deep
        steps = F.sequence(F.lit(1), F.greatest(F.floor(F.size(tree) / 2), F.lit(1)))
        return F.get(tree, F.aggregate(F.slice(steps, 1, 16), F.lit(0), down))["value"]

    return F.aggregate(trees["trees"], trees["base"], lambda total, tree: total + leaf(tree))


class Forest:
    """The trees of a batch: nodes one after the other, and where each row's trees begin."""

    def __init__(self, trees):
        lists = trees.field("trees")
        self.there = trees.is_valid().to_numpy(zero_copy_only=False)
        self.first, self.many = list_bounds(lists)
        self.many = np.where(self.there, self.many, 0)
        self.begin, self.size = list_bounds(lists.values)
        nodes = lists.values.values
        whole = lambda c: nodes.field(c).fill_null(-1).to_numpy().astype(np.int64)
        self.feature, self.left = whole("feature"), whole("left")
        self.at, self.value, self.cover, self.gain = (numbers(nodes.field(c)) for c in ("at", "value", "cover", "gain"))
        self.base = numbers(trees.field("base"))

    def roots(self, rows):
        """Where the trees of ``rows`` begin, (rows, most trees), and which are there."""
        k = np.arange(self.many[rows].max(initial=0))
        have = k < self.many[rows][:, None]
        if not len(self.begin):
            return np.zeros(have.shape, np.int64), have
        return self.begin[np.where(have, self.first[rows][:, None] + k, 0)], have

    def score(self, rows, x, there):
        """Predictions for ``x`` (rows, m, K), and which need no value that is not ``there``; all trees go down a level at a time."""
        root, have = self.roots(rows)
        (R, m, K), T = x.shape, root.shape[1]
        known = np.ones((R, m), bool)
        if not T or not m:
            return np.repeat(self.base[rows][:, None], m, axis=1), known
        root = np.broadcast_to(root[:, None, :], (R, m, T)).ravel()
        at, flat, flat_there = root.copy(), x.ravel(), None if there.all() else there.ravel()
        row = np.repeat(np.arange(R * m), T)
        going = np.flatnonzero((self.left[at] >= 0) & np.broadcast_to(have[:, None, :], (R, m, T)).ravel())
        while len(going):
            now = at[going]
            place = row[going] * K + self.feature[now]
            if flat_there is not None:
                known.reshape(-1)[row[going][~flat_there[place]]] = False
            now = root[going] + self.left[now] + ~(flat[place] <= self.at[now])
            at[going] = now
            going = going[self.left[now] >= 0]
        parts = np.where(have[:, None, :], self.value[at].reshape(R, m, T), 0.0)
        return self.base[rows][:, None] + parts.sum(axis=2), known


def tree_scores(trees: Column, xs: Column) -> Column:
    """``ARRAY<DOUBLE>``: :func:`tree_score` of every array of feature values in ``xs``."""

    @F.arrow_udf("array<double>")
    def scores(trees: pa.Array, xs: pa.Array) -> pa.Array:
        forest, (begin, n) = Forest(trees), list_bounds(xs)
        width = int(forest.feature.max(initial=-1)) + 1
        found, missing = [np.zeros(0)], [np.zeros(0, bool)]
        for a in range(0, len(n), SCORED):
            rows = np.arange(a, min(a + SCORED, len(n)))
            k = np.arange(n[rows].max(initial=0))
            used = k < n[rows][:, None]
            x, there = picked(xs, np.where(used, begin[rows][:, None] + k, -1), width)
            yhat, known = forest.score(rows, x, there | ~used[:, :, None])
            found.append(yhat[used])
            missing.append(~(known & forest.there[rows][:, None])[used])
        return as_lists(np.concatenate(found), n, xs.is_valid().to_numpy(zero_copy_only=False), np.concatenate(missing))

    return scores.asNondeterministic()(trees, xs.cast("array<array<double>>"))


def tree_rows(df: DataFrame, trees: str, *keys: str) -> DataFrame:
    """The nodes as a table: ``*keys, tree, node, feature, at, left, value, cover, gain``."""
    each = df.select(*keys, F.posexplode(F.col(trees)["trees"]).alias("tree", "_nodes"))
    return each.select(*keys, "tree", F.posexplode("_nodes").alias("node", "_n")).select(*keys, "tree", "node", "_n.*")


def gain_reading(features) -> Reading:
    """``ARRAY<STRUCT<feature, pct>>``: share of each feature in the gains of the trees; 0 without any split."""
    K = len(features)

    def gains(forest) -> pa.Array:
        owner = np.repeat(np.repeat(np.arange(len(forest.many)), forest.many), forest.size)
        split = forest.left >= 0
        sums = np.bincount(owner[split] * K + forest.feature[split], forest.gain[split], minlength=len(forest.many) * K)
        return as_lists(sums, np.full(len(forest.many), K), forest.there)

    return Reading("array<double>", gains, then=lambda sums: _shares(sums, features, 0.0))


def _shares(scores: Column, features, otherwise=None) -> Column:
    """``ARRAY<STRUCT<feature, pct>>`` from one score per feature; where all are 0 they stay, or are ``otherwise``."""
    names = F.array(*[F.lit(f) for f in features])

    def shares(scores):
        total = array_sum(scores)

        def share(v, j):
            pct = F.when(total > 0, F.round(100 * v / total, 2)).otherwise(v if otherwise is None else otherwise)
            return F.struct(F.get(names, j).alias("feature"), pct.alias("pct"))

        return F.transform(scores, share)

    # named once, as the scores may come from a kernel
    return F.get(F.transform(F.array(scores), shares), 0)


def gain_shares(trees: Column, features) -> Column:
    """:func:`gain_reading` of a column of trees."""
    return gain_reading(features).over(trees)


def gain_importance(df: DataFrame, trees: str, features) -> DataFrame:
    """``product, feature, pct`` from ``gain_shares``."""
    return df.select("product", F.inline(gain_shares(F.col(trees), features)))


def pack_rows(table: DataFrame, inputs, known: Column | None = None, *extra: str) -> DataFrame:
    """One row per product: ``start, n, ys``, then ``x``, ``target`` and ``n_known`` of the rows without gaps.

    ``inputs`` are the columns of ``table(product, ds, y, ...)`` that the trees see; ``n_known`` counts the
    rows for which ``known`` holds, which come first.  ``extra`` columns are packed along with ``ys``.
    """
    whole = F.col("y").isNotNull()
    for c in inputs:
        whole = whole & F.col(c).isNotNull()
    row = F.struct(
        F.array(*[F.col(c).cast("double") for c in inputs]).alias("x"), F.col("y"),
        whole.alias("whole"), (F.lit(True) if known is None else known).alias("known"),
    )
    packed = pack(table.select("product", "ds", "y", *extra, row.alias("_row")), *extra, "_row")
    packed = packed.withColumn("_row", F.filter("_row", lambda r: r["whole"]))
    count = F.size(F.filter("_row", lambda r: r["known"]))
    return packed.select(
        "product", "start", "n", "ys", *extra, F.col("_row").getField("x").alias("x"),
        F.col("_row").getField("y").alias("target"), count.alias("n_known"),
    )


def path_reading(ys: Column, start: Column, horizon: Column, ahead: Column | None = None, exog: int = 0, lags=LAGS, windows=ROLLING_WINDOWS) -> Reading:
    """``ARRAY<DOUBLE>``: predict a month, append it, rebuild the features, repeat; null without trees.

    The trees saw the temporal features, then ``exog`` further ones, whose future values are in
    ``ahead`` (one array per month, the last one repeated; missing values count as 0).
    """
    need = max(*lags, *windows)

    def path(forest, ys, month, horizon, ahead) -> pa.Array:
        begin, n = list_bounds(ys)
        valid = forest.there & (n > 0) & horizon.is_valid().to_numpy(zero_copy_only=False)
        steps = np.where(valid, np.maximum(horizon.fill_null(0).to_numpy(), 0), 0)
        values, gaps = numbers(ys.values), ys.values.is_null().to_numpy(zero_copy_only=False)
        dated, date = month.is_valid().to_numpy(zero_copy_only=False), month.fill_null(0).to_numpy().astype(np.int64)
        given, given_many = list_bounds(ahead)
        found = [np.zeros(0)]
        for a in range(0, len(n), SCORED):
            rows = np.arange(a, min(a + SCORED, len(n)))
            back, most = np.arange(need) - need, int(steps[rows].max(initial=0))
            place = n[rows][:, None] + back
            there = place >= 0
            place = np.where(there, begin[rows][:, None] + place, 0)
            hist, there = (values[place], there & ~gaps[place]) if len(values) else (np.zeros(place.shape), there)
            for k in range(most):
                full = np.minimum(n[rows], need) + k
                x = _features_now(hist, there, full, date[rows] + n[rows] + k, dated[rows], lags, windows)
                if exog:
                    last = np.minimum(k, given_many[rows] - 1)
                    own, own_there = picked(ahead, np.where(last >= 0, given[rows] + last, -1)[:, None], exog)
                    x = np.concatenate([x, np.where(own_there, own, 0.0)[:, 0]], axis=1)
                yhat, _ = forest.score(rows, x[:, None, :], np.ones((len(rows), 1, x.shape[1]), bool))
                hist, there = np.concatenate([hist, yhat], axis=1), np.concatenate([there, np.ones_like(yhat, bool)], axis=1)
            found.append(hist[:, need:][np.arange(most) < steps[rows][:, None]])
        return as_lists(np.concatenate(found), steps, valid)

    months = F.year(start) * 12 + F.month(start) - 1
    none = F.array().cast("array<array<double>>")
    future = none if ahead is None else F.coalesce(ahead.cast("array<array<double>>"), none)
    return Reading("array<double>", path, ys.cast("array<double>"), months, horizon.cast("int"), future)


def grown_path(trees: Column, *args, **options) -> Column:
    """:func:`path_reading` of a column of trees."""
    return path_reading(*args, **options).over(trees)


def _features_now(hist, there, full, month, dated, lags, windows):
    """The temporal features of the next month, as in ``boosted._features_at``; ``hist`` ends with the newest value."""
    have = lambda k: (full >= k) & there[:, hist.shape[1] - k :].all(axis=1)
    x = [np.where(there[:, -k], hist[:, -k], 0.0) for k in lags]
    for k in windows:
        mean, squares = np.zeros(len(hist)), np.zeros(len(hist))
        for j in range(k, 0, -1):
            mean = mean + hist[:, -j]
        mean = mean / k
        for j in range(k, 0, -1):
            squares = squares + (hist[:, -j] - mean) * (hist[:, -j] - mean)
        x += [np.where(have(k), mean, 0.0), np.where(have(k), np.sqrt(squares / (k - 1)), 0.0)]
    of_year = month % 12 + 1
    angle = 2 * np.pi * of_year / 12
    x += [np.where(dated, v, 0.0) for v in (of_year, (of_year + 2) // 3, month // 12, np.sin(angle), np.cos(angle))]
    return np.column_stack(x).astype(float)


def _attributed(forest, rows, x, there, points, weights, depth: int):
    """Shares of the features, (rows, K, m), of the values ``x`` (rows, m, K) in the trees of ``rows``; a value that is not there meets every interval.

    A node's edge stands for the feature asked above it: o is whether a row meets all that the path asks of this feature so far,
    r the share of training rows that do, and at a point t its factor is r + (o - r) t.  On the way down the product of the
    factors of the features on the path is carried along, a feature that was asked before giving up its old factor; on the
    way up the values of the leaves times their products are added.  An edge then counts (o - r) / factor times the sum
    below it, less what the edge of the same feature above it counts.  All trees go a level at a time, all values of a row in one line.
    """
    (R, m, K), many = x.shape, forest.many[rows]
    owner = np.repeat(np.arange(R), many)
    tree = np.repeat(forest.first[rows] - (np.cumsum(many) - many), many) + np.arange(len(owner))
    shares = np.zeros((R * K, m))
    if not len(owner):
        return shares.reshape(R, K, m)
    x = np.ascontiguousarray(x.transpose(0, 2, 1)).reshape(R * K, m)
    missing = None if there.all() else ~np.ascontiguousarray(there.transpose(0, 2, 1)).reshape(R * K, m)
    root = forest.begin[tree]
    low, high = int(root.min()), int((root + forest.size[tree]).max())
    feature, at, left, value, cover = (v[low:high] for v in (forest.feature, forest.at, forest.left, forest.value, forest.cover))
    root = root - low
    met, ratio = np.empty((high - low, m), bool), np.ones(high - low)
    asked_at = np.full((high - low, depth), -1)  # of every feature on a node's path, the last node that stands for it
    factor = lambda o, r, t: np.where(o, r + (1 - r) * t, r * (1 - t))
    worth = lambda o, r, t: np.where(o, (1 - r) / (r + (1 - r) * t), -1 / (1 - t))
    stands_for = np.full(high - low, -1)
    now, carried, levels = root, [np.ones((len(root), m)) for _ in points], []
    while True:
        inner = np.flatnonzero(left[now] >= 0)
        if not len(inner):
            levels.append((now, inner, None, None, None, None, carried))
            break
        node, asked = now[inner], feature[now[inner]]
        key = owner[inner] * K + asked
        values = x[key]
        o = np.concatenate([~(values > at[node][:, None]), ~(values <= at[node][:, None])])
        if missing is not None:
            o |= np.concatenate([missing[key]] * 2)
        slots = asked_at[node]
        same = (slots >= 0) & (stands_for[slots] == asked[:, None])
        known = same.any(axis=1)
        slot = np.where(known, same.argmax(axis=1), (slots >= 0).sum(axis=1))
        child = root[inner] + left[node]
        child, parent, two = np.concatenate([child, child + 1]), np.concatenate([node, node]), np.concatenate([inner, inner])
        before = np.concatenate([np.where(known, slots[np.arange(len(node)), slot], -1)] * 2)
        again = np.flatnonzero(before >= 0)
        before = before[again]
        r = cover[child] / cover[parent]
        o[again] &= met[before]
        r[again] *= ratio[before]
        met[child], ratio[child], stands_for[child] = o, r, np.concatenate([asked, asked])
        asked_at[child] = np.concatenate([slots, slots])
        asked_at[child, np.concatenate([slot, slot])] = child
        below = []
        for t, product in zip(points, carried, strict=True):
            product = product[two]
            product *= factor(o, r[:, None], t)
            if len(again):
                product[again] /= factor(met[before], ratio[before][:, None], t)
            below.append(product)
        levels.append((now, inner, child, np.concatenate([key, key]), again, before, carried))
        now, carried, root, owner = child, below, root[two], owner[two]
    below = None
    for now, inner, child, key, again, before, carried in reversed(levels):
        if below is not None:
            o, r = met[child], ratio[child][:, None]
            counts = np.zeros((len(child), m))
            for t, w, total in zip(points, weights, below, strict=True):
                each = worth(o, r, t)
                if len(again):
                    each[again] -= worth(met[before], ratio[before][:, None], t)
                each *= total
                each *= w
                counts += each
            order = np.argsort(key, kind="stable")
            begin = np.flatnonzero(np.diff(key[order], prepend=-1))
            shares[key[order][begin]] += np.add.reduceat(counts[order], begin, axis=0)
        worths = value[now][:, None]
        for k, product in enumerate(carried):
            product *= worths
            if below is not None:
                product[inner] = below[k][: len(inner)] + below[k][len(inner) :]
        below = carried
    return shares.reshape(R, K, m)


def _attributions(forest, xs, depth: int, width: int | None = None):
    """Shares (rows, K, m) of the features in the trees of some rows at a time, and which of the m values are the rows' own."""
    points, weights = np.polynomial.legendre.leggauss(max((depth + 1) // 2, 1))
    points, weights = (points + 1) / 2, weights / 2
    begin, n = list_bounds(xs)
    K = int(forest.feature.max(initial=-1)) + 1 if width is None else width
    nodes = np.concatenate([[0], np.cumsum(forest.size)])
    nodes = np.where(forest.many > 0, nodes[np.minimum(forest.first + forest.many, len(forest.size))] - nodes[np.minimum(forest.first, len(forest.size))], 0)
    n = np.where(forest.many > 0, n, 0)
    part = np.cumsum(nodes * n) // ATTRIBUTED
    for a, b in pairwise([0, *(np.flatnonzero(np.diff(part)) + 1), len(n)]):
        rows = np.arange(a, b)
        k = np.arange(n[rows].max(initial=0))
        own = k < n[rows][:, None]
        v, there = picked(xs, np.where(own, begin[rows][:, None] + k, -1), K)
        yield rows, own, _attributed(forest, rows, v, there | ~own[:, :, None], points, weights, depth)


def shapley_reading(depth: int, x: Column) -> Reading:
    """``ARRAY<STRUCT<row, feature, phi>>``: exact attribution of the trees, see :func:`tree_shapley`."""

    def attributed(forest, xs) -> pa.Array:
        row, feature, phi, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], np.zeros(len(xs), np.int64)
        for rows, own, shares in _attributions(forest, xs, depth):
            for r, there, each in zip(rows, own, shares, strict=True):
                n, first, many = int(there.sum()), forest.first[r], forest.many[r]
                if not many or not n:
                    continue
                ends = slice(forest.begin[first], forest.begin[first + many - 1] + forest.size[first + many - 1])
                names = np.unique(forest.feature[ends][forest.left[ends] >= 0])
                lengths[r] = n * len(names)
                row.append(np.repeat(np.arange(n), len(names)))
                feature.append(np.tile(names, n))
                phi.append(each[names, :n].T.ravel())
        fields = [pa.array(np.concatenate(row), pa.int32()), pa.array(np.concatenate(feature), pa.int32()), pa.array(np.concatenate(phi))]
        off = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.ListArray.from_arrays(off, pa.StructArray.from_arrays(fields, ["row", "feature", "phi"]))

    return Reading("array<struct<row:int,feature:int,phi:double>>", attributed, x.cast("array<array<double>>"))


def tree_shapley(df: DataFrame, trees: str, depth: int, x: str = "x") -> DataFrame:
    """Exact attribution of the trees, per row: ``product, row, feature, phi`` (features by position).

    A feature's absence lets a row go both ways, by the shares of training rows.  A leaf is then a game whose
    players are the features on its path: with o whether the row meets a feature's interval and r the
    share, a set of players is worth the product of its o and the others' r.  Averaging over all
    orderings is the integral over t of the product of r + (o - r) t, a polynomial that few Gauss
    points integrate exactly, so no ordering and no subset is listed.  Shares of a row sum to its
    prediction minus the mean prediction of the trees.

    A product's rows meet its own leaves, both bounded by its window, in the product's row: only the shares leave it.
    """
    shares = shapley_reading(depth, F.col(x)).over(F.col(trees))
    return df.where("product IS NOT NULL").select("product", shares.alias("_phi")).select("product", F.inline("_phi"))


def shapley_shares(depth: int, features, x: str = "x") -> Reading:
    """``ARRAY<STRUCT<feature, pct>>``: share of each feature in the mean absolute attribution; 0 where no tree asks for it."""
    K = len(features)

    def means(forest, xs) -> pa.Array:
        found = np.zeros((len(xs), K))
        for rows, own, shares in _attributions(forest, xs, depth, K):
            found[rows] = (np.abs(shares) * own[:, None, :]).sum(axis=2) / np.maximum(own.sum(axis=1), 1)[:, None]
        return as_lists(found.ravel(), np.full(len(xs), K))

    named = F.col("product").isNotNull()  # rows without a product are attributed nothing
    scores = lambda found: F.transform(found, lambda v: F.when(named, v).otherwise(0.0))
    return Reading("array<double>", means, F.col(x).cast("array<array<double>>"), then=lambda found: _shares(scores(found), features))


def shapley_importance(df: DataFrame, trees: str, depth: int, features, x: str = "x") -> DataFrame:
    """``product, feature, pct`` from ``shapley_shares``."""
    return df.select("product", F.inline(shapley_shares(depth, features, x).over(F.col(trees))))
