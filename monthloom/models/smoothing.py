"""Exponential smoothing with trend and season, parameters chosen from a grid.

All candidates of all series in a batch advance together: the state is a
(series x candidates) matrix and the only loop is over months.
"""

from itertools import product as cartesian

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.models.batch import by_length
from monthloom.settings import EPS, SEASON

GRID = tuple(cartesian((0.1, 0.3, 0.5, 0.7, 0.9), repeat=3))
STATE = (
    "kind string, alpha double, beta double, gamma double, sse double,"
    " level double, trend double, season array<double>"
)


def smooth(Y, a, b, g, trend="add", seasonal="add", m=SEASON):
    """Run the recursion; returns (sse, level, trend, season) with candidates on axis 1.

    ``a, b, g`` hold the candidates of all series, or a row of them for each.

    The first season gives the starting level and shape, the second the starting slope.
    """
    S, n = Y.shape
    G = np.shape(a)[-1]
    ones = np.ones((S, G))
    if seasonal:
        first, second = Y[:, :m].mean(axis=1), Y[:, m : 2 * m].mean(axis=1)
        level = first[:, None] * ones
        slope = ((second / first) ** (1.0 / m) if trend == "mul" else (second - first) / m)[:, None] * ones
        shape = Y[:, :m] / first[:, None] if seasonal == "mul" else Y[:, :m] - first[:, None]
        season = [shape[:, k : k + 1] * ones for k in range(m)]
        start = m
    else:
        level, season, start = Y[:, :1] * ones, None, 1
        step = (Y[:, 1] / Y[:, 0] if trend == "mul" else Y[:, 1] - Y[:, 0]) if n > 1 else np.zeros(S)
        slope = step[:, None] * ones
    if not trend:
        slope = ones if trend == "mul" else 0 * ones
    sse = np.zeros((S, G))
    for i in range(start, n):
        y = Y[:, i : i + 1]
        base = level * slope if trend == "mul" else level + slope
        s = season[0] if seasonal else None
        fitted = base if not seasonal else base * s if seasonal == "mul" else base + s
        sse += (y - fitted) ** 2
        plain = y if not seasonal else y / s if seasonal == "mul" else y - s
        new = a * plain + (1 - a) * base
        if trend == "mul":
            slope = b * (new / level) + (1 - b) * slope
        elif trend:
            slope = b * (new - level) + (1 - b) * slope
        if seasonal:
            gain = y / base if seasonal == "mul" else y - base
            season = season[1:] + [g * gain + (1 - g) * s]
        level = new
    return sse, level, slope, (np.stack(season, axis=-1) if seasonal else None)


def project(level, slope, season, h, trend="add", seasonal="add"):
    """h steps ahead from arrays of states (any leading shape)."""
    k = np.arange(1, h + 1)
    lv, sl = level[..., None], slope[..., None]
    path = lv * sl**k if trend == "mul" else lv + sl * k if trend else lv + 0 * k
    if season is None:
        return path
    s = season[..., (k - 1) % season.shape[-1]]
    return path * s if seasonal == "mul" else path + s


def _variant(n, trend, seasonal, m):
    """The model a series of ``n`` points can carry: full, without season, level only."""
    if seasonal and n >= 2 * m:
        return trend, seasonal
    return (trend if n >= 3 else None), None


def _best(Y, grid, trend, seasonal, m):
    """Best state per series, ties to the first candidate; drops to simpler models on failure."""
    n = Y.shape[1]
    ladder = [_variant(n, trend, seasonal, m), ("add" if n >= 3 else None, None), (None, None)]
    done = np.zeros(len(Y), dtype=bool)
    result = [None] * len(Y)
    for tr, se in dict.fromkeys(ladder):
        todo = np.flatnonzero(~done)
        if not len(todo):
            break
        cand = np.array(grid, dtype=float)
        if not se:
            cand[:, 2] = 0.0
        if not tr:
            cand[:, 1] = 0.0
        cand = np.unique(cand, axis=0)
        with np.errstate(all="ignore"):
            sse, lv, sl, ss = smooth(Y[todo], cand[:, 0], cand[:, 1], cand[:, 2], tr, se, m)
        sse = np.where(np.isfinite(sse), sse, np.inf)
        pick = sse.argmin(axis=1)
        for r, j in enumerate(todo):
            c = pick[r]
            if np.isfinite(sse[r, c]):
                kind = f"{tr or 'none'}-{se or 'none'}"
                season = ss[r, c].tolist() if ss is not None else None
                result[j] = (kind, *cand[c].tolist(), sse[r, c], lv[r, c], sl[r, c], season)
                done[j] = True
    return result


def _fit_udf(grid, trend, seasonal, m):
    @F.pandas_udf(STATE)
    def fit(ys: pd.Series) -> pd.DataFrame:
        rows = [None] * len(ys)
        for at, Y in by_length(ys):
            if Y.shape[1]:
                for j, r in zip(at, _best(Y, grid, trend, seasonal, m)):
                    rows[j] = r
        names = ["kind", "alpha", "beta", "gamma", "sse", "level", "trend", "season"]
        return pd.DataFrame([r or (None,) * 8 for r in rows], columns=names)

    return fit


def _given(Y, alpha, beta, gamma, m):
    """State per series under parameters of its own; None where that fails."""
    tr, se = _variant(Y.shape[1], "add", "add", m)
    a, b, g = alpha[:, None], (beta if tr else 0 * beta)[:, None], (gamma if se else 0 * gamma)[:, None]
    with np.errstate(all="ignore"):
        sse, lv, sl, ss = smooth(Y, a, b, g, tr, se, m)
    kind = f"{tr or 'none'}-{se or 'none'}"
    rows = []
    for r in range(len(Y)):
        season = ss[r, 0].tolist() if ss is not None else None
        row = (kind, a[r, 0], b[r, 0], g[r, 0], sse[r, 0], lv[r, 0], sl[r, 0], season)
        rows.append(row if np.isfinite(sse[r, 0]) else None)
    return rows


def hw_resolved_column(ys: Column, given: Column, grid=GRID, m: int = SEASON) -> Column:
    """Like ``hw_column``, but with the parameters of the struct ``given`` (alpha, beta, gamma) where there are any."""

    @F.pandas_udf(STATE)
    def fit(y: pd.Series, p: pd.DataFrame) -> pd.DataFrame:
        rows, known = [None] * len(y), p[["alpha", "beta", "gamma"]].astype(float).to_numpy()
        for at, Y in by_length(y):
            if not Y.shape[1]:
                continue
            has = np.isfinite(known[at]).all(axis=1)
            if has.any():
                for j, r in zip(at[has], _given(Y[has], *known[at[has]].T, m)):
                    rows[j] = r
            rest = np.array([rows[j] is None for j in at])
            if rest.any():
                for j, r in zip(at[rest], _best(Y[rest], grid, "add", "add", m)):
                    rows[j] = r
        names = ["kind", "alpha", "beta", "gamma", "sse", "level", "trend", "season"]
        return pd.DataFrame([r or (None,) * 8 for r in rows], columns=names)

    return fit(ys, given)


def hw_column(ys: Column, grid=GRID, trend="add", seasonal="add", m: int = SEASON) -> Column:
    """STRUCT with the chosen parameters and the final state."""
    return _fit_udf(grid, trend, seasonal, m)(ys)


def hw_fit(packed: DataFrame, grid=GRID, trend="add", seasonal="add", m: int = SEASON, ys: Column | str = "ys"):
    """Adds the struct ``fit`` (chosen parameters and the final state) to a packed table.

    Fewer than two seasons of data drop the season; fewer than three points the trend.
    """
    ys = F.col(ys) if isinstance(ys, str) else ys
    return packed.withColumn("fit", hw_column(ys, grid, trend, seasonal, m))


def hw_forecast_column(horizon, fit: Column | None = None) -> Column:
    """ARRAY<DOUBLE> of forecasts from the struct ``fit``; stays in the JVM."""
    fit = F.col("fit") if fit is None else fit
    horizon = F.lit(horizon) if isinstance(horizon, int) else horizon
    steps = F.sequence(F.lit(1), horizon)

    def value(k):
        kd = k.cast("double")
        base = (
            F.when(fit["kind"].startswith("mul"), fit["level"] * F.pow(fit["trend"], kd))
            .when(fit["kind"].startswith("add"), fit["level"] + fit["trend"] * kd)
            .otherwise(fit["level"])
        )
        s = F.get(fit["season"], (k - 1) % F.size(fit["season"]))
        return F.when(fit["season"].isNull(), base).when(fit["kind"].endswith("-mul"), base * s).otherwise(base + s)

    return F.when((horizon > 0) & fit["level"].isNotNull(), F.transform(steps, value))


def hw_forecast(fitted: DataFrame, horizon: int = 12) -> DataFrame:
    """``product, step, ds, yhat`` after the last month of each packed, fitted series."""
    return fitted.select(
        "product", "start", "n", F.posexplode(hw_forecast_column(horizon)).alias("_k", "yhat")
    ).select(
        "product",
        (F.col("_k") + 1).alias("step"),
        F.add_months("start", F.col("n") + F.col("_k")).alias("ds"),
        "yhat",
    )


def hw_trial_scores(ys: Column, trials: Column, ratio: float = 0.2, m: int = SEASON) -> Column:
    """Holdout error of each (alpha, beta, gamma) in ``trials`` for its own series.

    The last ``ratio`` of the points is predicted from the rest; a trial that fails
    scores infinity.
    """

    @F.pandas_udf("array<double>")
    def score(y: pd.Series, t: pd.Series) -> pd.Series:
        out = [None] * len(y)
        tries = t.map(len).to_numpy()
        for at, Y in by_length(y):  # series of one length advance together, each with its own trials
            n = Y.shape[1]
            cut = int(n * (1 - ratio))
            for k in np.unique(tries[at]):
                rows = np.flatnonzero(tries[at] == k)
                if not cut or cut == n or not k:
                    for r in rows:
                        out[at[r]] = [np.inf] * int(k)
                    continue
                cand = np.array([[[c["alpha"], c["beta"], c["gamma"]] for c in t.iloc[at[r]]] for r in rows], dtype=float)
                head, tail = Y[rows, :cut], Y[rows, cut:]
                tr, se = _variant(cut, "add", "add", m)
                with np.errstate(all="ignore"):
                    _, lv, sl, ss = smooth(head, cand[..., 0], cand[..., 1], cand[..., 2], tr, se, m)
                    path = project(lv, sl, ss, n - cut, tr, se)
                    err = np.abs((tail[:, None, :] - path) / (tail[:, None, :] + EPS)).mean(axis=2)
                for r, e in zip(rows, np.where(np.isfinite(err), err, np.inf)):
                    out[at[r]] = e.tolist()
        return pd.Series(out)

    return score(ys, trials)
