"""Seasonal ARIMA by conditional least squares, for many series and many orders.

Orders with the same differencing are fitted together for all series of a batch: the
recursion over months advances every (order, series) pair at once, and a damped
Gauss-Newton step solves one small system per pair.  Candidates live inside the task
rather than in exploded rows, so a series crosses the network once however large the
order grid is.
"""

from itertools import product as cartesian

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.models.batch import by_length
from monthloom.settings import EPS, SEASON

# (p, d, q, P, D, Q): every combination of p, q in 0..2 and the others in 0..1
ORDERS = tuple(cartesian((0, 1, 2), (0, 1), (0, 1, 2), (0, 1), (0, 1), (0, 1)))
CHUNK = 64  # series per stacked fit; times the orders of a family, this fills the caches
FALLBACK = ((1, 0, 0, 0, 0, 0), (0, 1, 1, 0, 0, 0), (1, 1, 0, 0, 0, 0))
# seasonal orders are called sp, sd, sq: column names differ by more than their case
NAMES = ("p", "d", "q", "sp", "sd", "sq")
ORDER = ",".join(f"{c}:int" for c in NAMES)
RESULT = f"struct<{ORDER},aic:double,sse:double,params:array<double>>"


def _difference(Y, d, D, m):
    for _ in range(d):
        Y = Y[:, 1:] - Y[:, :-1]
    for _ in range(D):
        Y = Y[:, m:] - Y[:, :-m]
    return Y


# columns of a parameter row: AR 1, AR 2, MA 1, MA 2, seasonal AR, seasonal MA
def _active(orders):
    """Which of the six parameters each order uses."""
    return np.array([[p > 0, p > 1, q > 0, q > 1, P > 0, Q > 0] for p, _, q, P, _, Q in orders])


def _lags(theta, m):
    """Non-zero lags of the multiplied-out AR and MA parts with their coefficient vectors."""
    a1, a2, b1, b2, A, B = theta
    ar = {1: a1, 2: a2, m: A, m + 1: -a1 * A, m + 2: -a2 * A}
    ma = {1: b1, 2: b2, m: B, m + 1: b1 * B, m + 2: b2 * B}
    return [{k: c for k, c in part.items() if c.any()} for part in (ar, ma)]


def _residuals(W, theta, m, start):
    """One-step errors of rows (time, row); errors before ``start`` are taken as zero.

    The AR part needs no loop, as its inputs are observed; only MA terms feed back.
    """
    ar, ma = _lags(theta, m)
    n = W.shape[0]
    e = np.zeros((n, theta.shape[1]))
    e[start:] = W[start:]
    for k, c in ar.items():
        if k <= start:
            e[start:] -= c * W[start - k : n - k]
    if ma:
        for t in range(start, n):
            for k, c in ma.items():
                if k <= t:
                    e[t] -= c * e[t - k]
    return e


def fit_css(Y, orders, m=SEASON, iterations=12, burn=0):
    """Least squares for all ``orders`` (sharing their differencing) and all series at once.

    A row is one (order, series) pair.  Damped Gauss-Newton: the derivatives of every row
    are one more stacked run of the recursion, and each row solves its own small system.
    Returns (theta (orders, series, 6), sse (orders, series), residuals, differenced series).
    """
    S, O = len(Y), len(orders)
    _, d, _, _, D, _ = orders[0]
    W = _difference(Y, d, D, m)
    n = W.shape[1]
    start = max(p + P * m for p, _, _, P, _, _ in orders)
    mask = np.repeat(_active(orders), S, axis=0).T  # (6, rows)
    use = np.flatnonzero(mask.any(axis=1))
    Wt = np.tile(W.T, (1, O))
    tail = slice(max(0, burn - (Y.shape[1] - n)), None)
    theta = 0.1 * mask

    def run(th, series):
        e = _residuals(series, th, m, start)
        return e, np.einsum("tr,tr->r", e[tail], e[tail])

    e, sse = run(theta, Wt)
    if len(use):
        wide = np.tile(Wt, (1, len(use)))
        damp = np.full(O * S, 1e-2)
        rows = O * S
        for _ in range(iterations):
            moved = np.concatenate([theta + 1e-5 * (np.arange(6) == c)[:, None] * mask for c in use], axis=1)
            shifted, _ = run(moved, wide)
            J = (shifted[tail].reshape(-1, len(use), rows) - e[tail][:, None, :]) / 1e-5
            A = np.einsum("tkr,tlr->rkl", J, J)
            g = np.einsum("tkr,tr->rk", J, e[tail])
            size = np.einsum("rkk->r", A) / len(use)
            ridge = (damp * size + 1e-9)[:, None, None] * np.eye(len(use))
            step = np.linalg.solve(A + ridge, -g[..., None])[..., 0]
            trial = theta.copy()
            trial[use] = np.clip(theta[use] + step.T, -0.98, 0.98)
            trial *= mask
            e2, sse2 = run(trial, Wt)
            better = np.isfinite(sse2) & (sse2 < sse)
            theta = np.where(better, trial, theta)
            e = np.where(better, e2, e)
            gain = np.where(better, sse - sse2, 0.0)
            sse = np.where(better, sse2, sse)
            damp = np.where(better, damp * 0.3, damp * 5)
            if (gain <= 1e-7 * sse).all():
                break
    shape = (O, S)
    return (
        theta.T.reshape(*shape, 6),
        sse.reshape(shape),
        e.T.reshape(*shape, n),
        W,
    )


def forecast_css(Y, theta, e, W, order, h, m=SEASON):
    """Continue the recursion with zero future errors, then undo the differencing."""
    _, d, _, _, D, _ = order
    ar, ma = _lags(theta.T, m)
    n = W.shape[1]
    w = np.concatenate([W.T, np.zeros((h, len(W)))])
    err = np.concatenate([e.T, np.zeros((h, len(W)))])
    for t in range(n, n + h):
        w[t] = sum(c * w[t - k] for k, c in ar.items() if k <= t) + sum(c * err[t - k] for k, c in ma.items() if k <= t)
    path = w[n:].T
    if D:  # seasonal differences were taken last, so they are undone first
        base = _difference(Y, d, 0, m)
        full = np.concatenate([base, np.zeros((len(W), h))], axis=1)
        for t in range(base.shape[1], base.shape[1] + h):
            full[:, t] = path[:, t - base.shape[1]] + full[:, t - m]
        path = full[:, base.shape[1] :]
    if d:
        path = Y[:, -1:] + path.cumsum(axis=1)
    return path


def _span(order, m):
    p, d, q, P, D, Q = order
    return d + D * m + p + P * m


def _aic(sse, n, k):
    with np.errstate(divide="ignore"):
        return n * np.log(np.maximum(sse, 1e-12) / n) + 2 * (k + 1)


def _feasible(orders, n, m):
    """Orders that leave at least as many errors as twice the parameters."""
    return [o for o in orders if n - _span(o, m) >= max(4, 2 * (o[0] + o[2] + o[3] + o[5]) + 2)]


def _families(orders):
    """Orders that can be fitted together: same differencing and same seasonal terms."""
    out = {}
    for o in orders:
        out.setdefault((o[1], *o[3:]), []).append(o)
    return out.values()


def select_orders(Y, orders, m=SEASON):
    """Per series the order of lowest AIC; all orders are scored on the same last months.

    Returns the orders tried, their AIC (orders, series), and for each order the tuple
    (theta, sse, residuals, differenced series) of all series.
    """
    n = Y.shape[1]
    simplest = [(0, 1, 0, 0, 0, 0) if n > 1 else (0, 0, 0, 0, 0, 0)]
    usable = _feasible(orders, n, m) or _feasible(FALLBACK, n, m) or simplest
    burn = max(_span(o, m) for o in usable)
    tried, aics, fits = [], [], []
    with np.errstate(all="ignore"):
        for family in _families(usable):
            theta, sse, e, W = fit_css(Y, family, m, burn=burn)
            for c, o in enumerate(family):
                tried.append(o)
                aics.append(_aic(sse[c], max(n - burn, 1), int(_active([o]).sum())))
                fits.append((theta[c], sse[c], e[c], W))
    aics = np.where(np.isfinite(aics), aics, np.inf)
    return tried, aics, fits


def sarima_fit(packed: DataFrame, orders=ORDERS, m: int = SEASON, ys: Column | str = "ys") -> DataFrame:
    """Adds ``fit`` with the chosen order, its AIC and its parameters (one order: no choice).

    ``params`` lists AR 1, AR 2, MA 1, MA 2, seasonal AR, seasonal MA; unused ones are 0.
    """
    ys = F.col(ys) if isinstance(ys, str) else ys

    @F.pandas_udf(RESULT)
    def fit(y: pd.Series) -> pd.DataFrame:
        rows = [(None,) * 9] * len(y)
        for at, Y in by_length(y, CHUNK):
            if not Y.shape[1]:
                continue
            tried, aics, fits = select_orders(Y, orders, m)
            for r, j in enumerate(at):
                c = aics[:, r].argmin()
                theta, sse, _, _ = fits[c]
                rows[j] = (*tried[c], aics[c, r], sse[r], theta[r].tolist())
        return pd.DataFrame(rows, columns=[*NAMES, "aic", "sse", "params"])

    return packed.withColumn("fit", fit(ys))


def sarima_grid(packed: DataFrame, orders=ORDERS, m: int = SEASON) -> DataFrame:
    """AIC of every candidate order of every series: ``product, p, d, q, sp, sd, sq, aic``."""

    @F.pandas_udf(f"array<struct<{ORDER},aic:double>>")
    def scores(y: pd.Series) -> pd.Series:
        out = [[] for _ in range(len(y))]
        for at, Y in by_length(y, CHUNK):
            if not Y.shape[1]:
                continue
            tried, aics, _ = select_orders(Y, orders, m)
            for r, j in enumerate(at):
                out[j] = [dict(zip(NAMES, o), aic=float(aics[c, r])) for c, o in enumerate(tried)]
        return pd.Series(out)

    return packed.select("product", F.inline(scores("ys")))


def best_order(scored: DataFrame) -> DataFrame:
    key = F.struct("aic", *NAMES)
    return scored.groupBy("product").agg(F.min(key).alias("b")).select("product", *[f"b.{c}" for c in NAMES], "b.aic")


def sarima_path(ys: Column, horizon: Column, orders=ORDERS, m: int = SEASON) -> Column:
    """ARRAY<DOUBLE>: choose, fit and project in one pass over the batch."""

    @F.pandas_udf("array<double>")
    def path(y: pd.Series, h: pd.Series) -> pd.Series:
        out = [None] * len(y)
        steps = int(h.max()) if len(h) else 0
        for at, Y in by_length(y, CHUNK):
            if not Y.shape[1] or not steps:
                continue
            tried, aics, fits = select_orders(Y, orders, m)
            pick = aics.argmin(axis=0)
            for c in np.unique(pick):
                rows = np.flatnonzero(pick == c)
                theta, _, e, W = fits[c]
                with np.errstate(all="ignore"):
                    f = forecast_css(Y[rows], theta[rows], e[rows], W[rows], tried[c], steps, m)
                for r, v in zip(rows, f):
                    good = np.isfinite(v).all()
                    out[at[r]] = (v if good else np.full(steps, Y[r, -1]))[: int(h.iloc[at[r]])].tolist()
        return pd.Series(out)

    return path(ys, horizon)


def holdout_error(Y, order, m=SEASON, ratio=0.2):
    """Share error of one order on the last ``ratio`` of each series; infinity on failure."""
    cut = int(Y.shape[1] * (1 - ratio))
    head, tail = Y[:, :cut], Y[:, cut:]
    if not _feasible([order], cut, m) or not tail.shape[1]:
        return np.full(len(Y), np.inf)
    with np.errstate(all="ignore"):
        theta, _, e, W = fit_css(head, [order], m)
        f = forecast_css(head, theta[0], e[0], W, order, tail.shape[1], m)
        err = np.abs((tail - f) / (tail + EPS)).mean(axis=1)
    return np.where(np.isfinite(err), err, np.inf)


def sarima_trial_scores(ys: Column, trials: Column, ratio: float = 0.2, m: int = SEASON) -> Column:
    """Holdout error of each order in ``trials`` for its own series; infinity where it fails.

    Series of a batch that drew the same order are fitted together.
    """

    @F.pandas_udf("array<double>")
    def score(y: pd.Series, t: pd.Series) -> pd.Series:
        out = [[np.inf] * len(q) for q in t]
        for at, Y in by_length(y, CHUNK):
            wanted = {}
            for r, j in enumerate(at):
                for c, q in enumerate(t.iloc[j]):
                    wanted.setdefault(tuple(int(q[k]) for k in NAMES), []).append((r, j, c))
            for order, places in wanted.items():
                errors = holdout_error(Y[[r for r, _, _ in places]], order, m, ratio)
                for (_, j, c), v in zip(places, errors):
                    out[j][c] = float(v)
        return pd.Series(out)

    return score(ys, trials)
