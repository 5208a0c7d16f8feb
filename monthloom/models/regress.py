"""Piecewise-linear trend + yearly Fourier terms + regressors, as a ridge regression.

Prior scales act as shrinkage: a coefficient with prior scale s is penalised by
(noise / s)^2.  A fit reads only its product's row, so it moves no row; the small systems of the rows
of an Arrow batch that have the same shape are set up and solved in one numpy call each.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthloom.functions.expressions import array_sum
from monthloom.functions.linear import ridge
from monthloom.models.batch import list_bounds, picked
from monthloom.settings import EPS

NOISE = 0.1
FOURIER = 5
CHANGEPOINTS = 25
REGRESSOR_SCALE = 10.0
#: Alternations of the multiplicative form, and the change of the scaled fit at which they end.
ROUNDS = 100
TOLERANCE = 1e-6
#: Rows solved together; their designs take some dozens of MB.
CHUNK = 512
FIT = (
    "struct<trend:array<double>,yearly:array<double>,effects:array<array<double>>,yhat:array<double>,"
    "coef:array<double>,trend_coef:array<double>,rounds:int,converged:boolean>"
)


def _trend_columns(n: int, total: int):
    """Intercept, slope and hinges spread over the first 80% of the history: (total, 2 + hinges)."""
    t = np.arange(total) / max(n - 1, 1)
    k = min(CHANGEPOINTS, max(int(np.floor(n * 0.8)) - 1, 0))
    return np.column_stack([np.ones(total), t, *[np.maximum(t - (j + 1) * 0.8 / k, 0.0) for j in range(k)]])


def _season_columns(first_month: int, total: int):
    angle = (np.arange(total) + first_month - 1) % 12 * (2 * np.pi) / 12
    return np.column_stack([f(angle * j) for j in range(1, FOURIER + 1) for f in (np.sin, np.cos)])


def _scaled_regressors(raw, n: int):
    """Less the mean of the history, divided by its deviation: (rows, total, regressors)."""
    mean = raw[:, :n].mean(axis=1, keepdims=True)
    sd = raw[:, :n].std(axis=1, keepdims=True)
    return (raw - mean) / np.where(sd > 1e-9 * np.abs(mean), sd, 1.0)


def _alternated(trend, terms, y, pen_trend, pen_terms):
    """The multiplicative form, trend * (1 + terms): each is linear with the other held, in turn until a row's fit stands still."""
    rows, n = y.shape
    b, c = np.full((rows, trend.shape[1]), np.nan), np.full((rows, terms.shape[2]), np.nan)
    rounds, settled = np.zeros(rows, np.int32), np.zeros(rows, bool)
    factor, fit = np.ones_like(y), np.full_like(y, np.nan)
    for turn in range(ROUNDS):
        (at,) = np.nonzero(~settled)
        if not len(at):
            break
        b[at] = ridge(trend * factor[at][:, :, None], y[at], pen_trend[at])
        line = b[at] @ trend.T
        fitted = line * factor[at]
        rounds[at] += 1
        if turn:
            settled[at] = np.abs(fit[at] - fitted).max(axis=1) <= TOLERANCE
        fit[at] = fitted
        go = ~settled[at]
        at, line = at[go], line[go]
        if len(at):
            c[at] = ridge(terms[at] * line[:, :, None], y[at] - line, pen_terms[at])
            factor[at] = (terms[at] @ c[at][:, :, None])[:, :, 0] + 1.0
    return b, c, rounds, settled


def _solved(ys, raw, month: int, cps, sps, additive: bool):
    """Parts of the fits of rows of one shape: ``ys`` (rows, n), ``raw`` regressors (rows, total, width)."""
    (rows, n), total, waves = ys.shape, raw.shape[1], 2 * FOURIER
    size = np.maximum(np.abs(ys).max(axis=1), 1e-9)[:, None]
    y = ys / size
    trend = _trend_columns(n, total)
    season = np.broadcast_to(_season_columns(month, total), (rows, total, waves))
    terms = np.concatenate([season, _scaled_regressors(raw, n)], axis=2)
    knots, own = trend.shape[1] - 2, (NOISE / REGRESSOR_SCALE) ** 2 + 1e-8
    pen = np.concatenate([np.full((rows, 2), 1e-6), np.repeat((NOISE / cps[:, None]) ** 2, knots, axis=1)], axis=1)
    wave = np.repeat((NOISE / sps[:, None]) ** 2 + 1e-8, waves, axis=1)
    pen_terms = np.concatenate([wave, np.full((rows, raw.shape[2]), own)], axis=1)
    if additive:
        design = np.concatenate([np.broadcast_to(trend[:n], (rows, n, trend.shape[1])), terms[:, :n]], axis=2)
        both = ridge(design, y, np.concatenate([pen, pen_terms], axis=1))
        b, c = both[:, : trend.shape[1]], both[:, trend.shape[1] :]
        rounds, settled = np.ones(rows, np.int32), np.ones(rows, bool)
    else:
        b, c, rounds, settled = _alternated(trend[:n], terms[:, :n], y, pen, pen_terms)
    line = (b @ trend.T) * size
    each = terms * c[:, None, :] * (size[:, :, None] if additive else 1.0)
    total_terms = each.sum(axis=2)
    yhat = line + total_terms if additive else line * (total_terms + 1.0)
    return line, each[:, :, :waves].sum(axis=2), each[:, :, waves:].transpose(0, 2, 1), yhat, c[:, waves:], b, rounds, settled


def _regressor_values(xs, at, total: int, width: int):
    """Regressors of the rows ``at`` over the whole span; the last month repeats, what is not finite counts as 0."""
    if not width:
        return np.zeros((len(at), total, 0))
    begin, months = list_bounds(xs)
    month = begin[at][:, None] + np.minimum(np.arange(total), months[at][:, None] - 1)
    found, there = picked(xs, month, width)
    return np.where(there & np.isfinite(found), found, 0.0)


def _as_lists(values, missing):
    """Rows of a matrix as lists; those that are ``missing`` hold nulls."""
    rows, width = values.shape
    flat = pa.array(np.ascontiguousarray(values).ravel(), mask=np.repeat(missing, width))
    return pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * width, flat)


def _as_fits(parts, missing):
    """The struct ``FIT`` of every row; one with a missing value has no coefficients, and so only nulls."""
    line, yearly, effects, yhat, coef, trend_coef, rounds, settled = parts
    rows, width, total = effects.shape
    nested = pa.ListArray.from_arrays(
        np.arange(rows + 1, dtype=np.int32) * width, _as_lists(effects.reshape(rows * width, total), np.repeat(missing, width))
    )
    plain = [_as_lists(v, missing) for v in (line, yearly, yhat, coef, trend_coef)]
    last = [pa.array(rounds, pa.int32()), pa.array(settled)]
    return pa.StructArray.from_arrays([*plain[:2], nested, *plain[2:], *last], [f.name for f in FIT_TYPE])


_ONE = pa.list_(pa.float64())
FIT_TYPE = pa.struct(
    [("trend", _ONE), ("yearly", _ONE), ("effects", pa.list_(_ONE)), ("yhat", _ONE), ("coef", _ONE), ("trend_coef", _ONE), ("rounds", pa.int32()), ("converged", pa.bool_())]
)


def fitted_batch(ys, month, horizon, xs, cps, sps, additive) -> pa.Array:
    """Fits of the rows of a batch; rows of one length, first month, horizon, width and form are solved together."""
    begin, n = list_bounds(ys)
    holes = np.concatenate([[0], np.cumsum(ys.values.is_null().to_numpy(zero_copy_only=False))])
    values = ys.values.to_numpy(zero_copy_only=False).astype(float)
    first, months = list_bounds(xs)
    _, widths = list_bounds(xs.values)
    width = np.zeros(len(n), np.int64)
    width[months > 0] = widths[first[months > 0]]
    number = lambda a, t: pc.fill_null(a, 0).to_numpy(zero_copy_only=False).astype(t)
    given = [a.is_null().to_numpy(zero_copy_only=False) for a in (month, cps, sps, additive)]
    unknown = np.any(given, axis=0) | (holes[begin + n] > holes[begin])
    cps, sps = (np.where(unknown, 1.0, number(a, float)) for a in (cps, sps))
    keys = np.column_stack([n, number(month, np.int64), number(horizon, np.int64), width, number(additive, np.int64)])
    found, where = [pa.nulls(1, FIT_TYPE)], np.zeros(len(n), np.int64)
    kinds, kind = np.unique(keys, axis=0, return_inverse=True)
    kind, done = kind.reshape(-1), 1
    for g, (length, m, h, w, add) in enumerate(kinds):
        if length < 3:
            continue
        (rows,) = np.nonzero(kind == g)
        for k in range(0, len(rows), CHUNK):
            at = rows[k : k + CHUNK]
            series = values[begin[at][:, None] + np.arange(length)]
            series[unknown[at]] = 0.0
            parts = _solved(series, _regressor_values(xs, at, length + h, w), m, cps[at], sps[at], bool(add))
            found.append(_as_fits(parts, unknown[at]))
            where[at] = done + np.arange(len(at))
            done += len(at)
    return pa.concat_arrays(found).take(pa.array(where))


def _as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def regression_column(ys: Column, start: Column, horizon=0, xs: Column | None = None, cps=0.05, sps=10.0, mode="additive") -> Column:
    """The struct that :func:`with_regression` adds."""

    @F.arrow_udf(FIT)
    def fitted(ys: pa.Array, month: pa.Array, horizon: pa.Array, xs: pa.Array, cps: pa.Array, sps: pa.Array, additive: pa.Array) -> pa.Array:
        return fitted_batch(ys, month, horizon, xs, cps, sps, additive)

    none = F.array().cast("array<array<double>>")
    values = none if xs is None else F.coalesce(xs.cast("array<array<double>>"), none)
    given = (_as_column(cps).cast("double"), _as_column(sps).cast("double"), (_as_column(mode) == "additive").cast("int"))
    # not known to be the same when repeated: a later filter must not sink below the fit and repeat it
    fitted = fitted.asNondeterministic()
    return fitted(ys.cast("array<double>"), F.month(start), _as_column(horizon).cast("int"), values, *given)


def with_regression(df: DataFrame, name: str, ys: Column, start: Column, horizon=0, xs: Column | None = None, cps=0.05, sps=10.0, mode="additive") -> DataFrame:
    """Adds ``name``: STRUCT of component arrays over the history and ``horizon`` further months; null below three months.

    ``xs ARRAY<ARRAY<DOUBLE>>`` holds one array of regressor values per month.  Where it is
    shorter than history plus horizon, its last row is repeated.  Prior scales and mode may be columns.  ``coef`` are the
    coefficients of the scaled regressors, ``trend_coef`` those of intercept, slope and changes; ``converged`` says
    whether the multiplicative form stood still, after ``rounds`` alternations (the additive one is solved at once).
    """
    return df.withColumn(name, regression_column(ys, start, horizon, xs, cps, sps, mode))


def with_trial_scores(df: DataFrame, name: str, ys: Column, start: Column, trials: str, count: int, ratio: float = 0.2, xs: Column | None = None) -> DataFrame:
    """Adds ``name``: holdout error of each of the ``count`` structs ``cps, sps, mode`` in the column ``trials``; infinity on failure.

    Regressor values of the held-out months are known to the forecast, as in a backtest.
    """
    n = F.size(ys)
    cut = F.floor(n * (1 - ratio)).cast("int")
    held = F.slice(ys, cut + 1, n)
    fits, scores = {}, []
    for k in range(count):
        t = F.get(trials, F.lit(k))
        fits[f"_trial_{k}"] = regression_column(F.slice(ys, F.lit(1), cut), start, n - cut, xs, t["cps"], t["sps"], t["mode"])
        errors = F.zip_with(held, F.slice(f"_trial_{k}.yhat", cut + 1, n), lambda y, p: F.abs((y - p) / (y + EPS)))
        error = array_sum(errors) / F.size(held)
        good = (cut >= 3) & (cut < n) & error.isNotNull() & ~F.isnan(error) & (error < float("inf"))
        scores.append(F.when(good, error).otherwise(float("inf")))
    # one pass for all trials: their fits read the same row
    return df.withColumns(fits).withColumn(name, F.array(*scores)).drop(*fits)


def trend_season_regress(packed: DataFrame, horizon: int = 0, xs: str | None = None, **options) -> DataFrame:
    """Adds the struct ``fit``; options: ``cps``, ``sps`` (prior scales) and ``mode``."""
    col = F.col(xs) if xs else None
    return with_regression(packed, "fit", F.col("ys"), F.col("start"), horizon, col, **options)


def regress_forecast(fitted: DataFrame) -> DataFrame:
    """The months after the history: ``product, step, ds, yhat``."""
    flat = fitted.select("product", "start", "n", F.posexplode("fit.yhat").alias("i", "yhat"))
    return flat.filter(F.col("i") >= F.col("n")).select(
        "product", (F.col("i") - F.col("n") + 1).alias("step"), F.add_months("start", F.col("i")).alias("ds"), "yhat"
    )


def components(fitted: DataFrame, regressors=(), mode: str = "additive") -> DataFrame:
    """``product, ds, component, value``: trend, yearly, one per regressor, their sum and yhat.

    With ``mode='additive'`` trend + additive_terms = yhat; otherwise
    trend * (1 + multiplicative_terms) = yhat.
    """
    flat = _component_rows(fitted, regressors)
    total = F.col("yearly")
    for name in regressors:
        total = total + F.col(f"`{name}`")
    label = "additive_terms" if mode == "additive" else "multiplicative_terms"
    flat = flat.withColumn(label, total)
    return flat.unpivot(["product", "ds"], ["trend", "yearly", *regressors, label, "yhat"], "component", "value")


def _component_rows(fitted: DataFrame, regressors) -> DataFrame:
    zipped = F.arrays_zip(
        F.col("fit.trend").alias("trend"),
        F.col("fit.yearly").alias("yearly"),
        *[F.col("fit.effects")[k].alias(name) for k, name in enumerate(regressors)],
        F.col("fit.yhat").alias("yhat"),
    )
    flat = fitted.select("product", "start", F.posexplode(zipped).alias("i", "z"))
    return flat.select("product", F.add_months("start", F.col("i")).alias("ds"), "z.*")


def decompose_classic(demand: DataFrame) -> DataFrame:
    """Linear trend + month-of-year means of the detrended values + remainder, long form.

    ``demand`` carries its position ``i``.  Plain SQL: the regression and the month means
    are window aggregates over the same partitioning.
    """
    w = W.partitionBy("product")
    y, i = F.col("y"), F.col("i").cast("double")
    slope, base = F.regr_slope(y, i).over(w), F.regr_intercept(y, i).over(w)
    flat = demand.withColumn("trend", base + slope * i).withColumn("_d", y - F.col("trend"))
    flat = flat.withColumn("seasonal", F.avg("_d").over(W.partitionBy("product", F.month("ds"))))
    flat = flat.withColumn("remainder", F.col("_d") - F.col("seasonal"))
    return flat.unpivot(["product", "ds"], ["trend", "seasonal", "remainder"], "component", "value")
