"""Parameter search: reproducible trial tables and the choice of the best trial."""

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthloom.functions.expressions import ape_eps, array_sum, uniform
from monthloom.models.boosted import gbt_fit
from monthloom.models.grown import OPTION_NAMES, grow_trees, tree_scores
from monthloom.models.regress import with_trial_scores
from monthloom.models.sarima import sarima_trial_scores
from monthloom.models.smoothing import hw_trial_scores
from monthloom.operators.metrics import mape_eps_of
from monthloom.operators.screening import holdout_split
from monthloom.session import reuse
from monthloom.settings import SEARCH_SPACES


def _draw(spec, u: Column) -> Column:
    """A value of one dimension as text, from a uniform draw."""
    kind = spec[0]
    if kind == "choice":
        options = F.array(*[F.lit(o) for o in spec[1]])
        return F.get(options, F.floor(u * len(spec[1])).cast("int"))
    low, high = spec[1], spec[2]
    if kind == "int":
        return (F.floor(u * (high - low + 1)) + low).cast("int").cast("string")
    value = F.lit(low) * F.pow(F.lit(high / low), u) if kind == "logfloat" else F.lit(low) + u * F.lit(high - low)
    return value.cast("string")


def search_space(products: DataFrame, family: str, trials: int = 50, space=None) -> DataFrame:
    """``product, trial, param, value``: every product draws its own trials.

    Draws come from an md5 of product, parameter and trial number, so they are the same
    however the table is partitioned or recomputed.
    """
    space = space or SEARCH_SPACES[family]
    t = products.select("product", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"))
    drawn = [
        F.struct(F.lit(name).alias("param"), _draw(spec, uniform(F.col("product"), name, F.col("trial"))).alias("value"))
        for name, spec in space.items()
    ]
    return t.select("product", "trial", F.explode(F.array(*drawn)).alias("d")).select("product", "trial", "d.*")


def best_trial(scores: DataFrame, direction: str = "minimize") -> DataFrame:
    """The best trial per product; a failed trial (NULL or NaN) ranks last, ties to the first."""
    worst = float("inf") if direction == "minimize" else float("-inf")
    score = F.when(F.col("score").isNull() | F.isnan("score"), F.lit(worst)).otherwise(F.col("score"))
    row = F.struct(*[c for c in scores.columns if c not in ("product", "score")])
    sign = 1 if direction == "minimize" else -1
    best = F.min(F.struct((score * sign).alias("k"), F.col("trial").alias("t"), row.alias("r"))).alias("b")
    return (
        scores.groupBy("product")
        .agg(best, F.count(F.lit(1)).alias("trials_used"))
        .select("product", "b.r.*", (F.col("b.k") * sign).alias("best_value"), "trials_used")
    )


def smoothing_trials(products: DataFrame, trials: int = 5) -> DataFrame:
    """Adds ``trials ARRAY<STRUCT<trial, alpha, beta, gamma>>`` drawn in (0.05, 0.95)."""

    def value(name, t):
        return F.round(F.lit(0.05) + F.lit(0.9) * uniform(F.col("product"), name, t), 9).alias(name)

    row = F.transform(
        F.sequence(F.lit(1), F.lit(trials)),
        lambda t: F.struct(t.alias("trial"), value("alpha", t), value("beta", t), value("gamma", t)),
    )
    return products.withColumn("trials", row)


def tune_smoothing(packed: DataFrame, trials: int = 5, ratio: float = 0.2, direction: str = "minimize") -> DataFrame:
    """Best smoothing parameters per series by the error on its held-out tail."""
    drawn = smoothing_trials(packed, trials)
    return _choose(drawn.withColumn("_s", hw_trial_scores(F.col("ys"), F.col("trials"), ratio)), direction)


def _draw_trials(products: DataFrame, space: dict, types: dict, trials: int) -> DataFrame:
    """Adds ``trials ARRAY<STRUCT<trial, ...>>``, drawn in the product's own row."""

    def row(t):
        drawn = [_draw(spec, uniform(F.col("product"), name, t)).cast(types[name]).alias(name) for name, spec in space.items()]
        return F.struct(t.alias("trial"), *drawn)

    return products.withColumn("trials", F.transform(F.sequence(F.lit(1), F.lit(trials)), row))


# column names differ from the parameter names where these differ only by case
_SARIMA = {"p": ("p", "int"), "d": ("d", "int"), "q": ("q", "int"), "P": ("sp", "int"), "D": ("sd", "int"), "Q": ("sq", "int")}
_TREND_SEASON = {
    "changepoint_prior_scale": ("cps", "double"),
    "seasonality_prior_scale": ("sps", "double"),
    "seasonality_mode": ("mode", "string"),
}


def _choose(scored: DataFrame, direction: str) -> DataFrame:
    rows = scored.select("product", F.explode(F.arrays_zip("trials", F.col("_s").alias("s"))).alias("z"))
    return best_trial(rows.select("product", "z.trials.*", F.col("z.s").alias("score")), direction)


def tune_sarima(packed: DataFrame, trials: int = 5, ratio: float = 0.2, direction: str = "minimize") -> DataFrame:
    """Best of the drawn orders per series by the error on its held-out tail."""
    space = {name: SEARCH_SPACES["SARIMA"][k] for k, (name, _) in _SARIMA.items()}
    drawn = _draw_trials(packed, space, dict(_SARIMA.values()), trials)
    return _choose(drawn.withColumn("_s", sarima_trial_scores(F.col("ys"), F.col("trials"), ratio)), direction)


def tune_regression(packed: DataFrame, trials: int = 5, ratio: float = 0.2, xs: str | None = None, direction: str = "minimize") -> DataFrame:
    """Best prior scales and mode per series, likewise."""
    space = {name: SEARCH_SPACES["Prophet"][k] for k, (name, _) in _TREND_SEASON.items()}
    drawn = _draw_trials(packed, space, dict(_TREND_SEASON.values()), trials)
    scored = with_trial_scores(drawn, "_s", F.col("ys"), F.col("start"), "trials", trials, ratio, F.col(xs) if xs else None)
    return _choose(scored, direction)


# option of the trees -> name in the search space, and its type
_TREES = {
    "rounds": ("n_estimators", "int"),
    "depth": ("max_depth", "int"),
    "rate": ("learning_rate", "double"),
    "min_child_weight": ("min_child_weight", "double"),
    "subsample": ("subsample", "double"),
    "colsample": ("colsample_bytree", "double"),
}


def tune_trees(
    packed: DataFrame, features: int, trials: int = 8, rungs: int = 3, keep: int = 2, ratio: float = 0.2, space: dict | None = None
) -> DataFrame:
    """Successive halving of the trees' parameters for every product: ``product, rung, trial, <options>, budget, score, rank``.

    All trials of all products grow a part of their rounds in one pass, with the trial as a key, and are scored on
    the last rows (``ratio``) of ``x`` and ``target``; of each product's trials one in ``keep`` goes on with ``keep``
    times the rounds, the last rung has them all.  Ranks are by score, failed trials last, ties to the first trial.  The
    number of passes is the number of rungs, whatever the number of trials and products.
    """
    found = space or SEARCH_SPACES["XGBoost"]
    drawn = _draw_trials(packed.select("product", "x", "target"), {o: found[k] for o, (k, _) in _TREES.items()}, {o: t for o, (_, t) in _TREES.items()}, trials)
    alive = drawn.select("product", "x", "target", F.inline("trials"))
    cut = F.floor(F.size("target") * (1 - ratio)).cast("int")
    rows, best = [], W.partitionBy("product")
    for rung in range(1, rungs + 1):
        budget = F.greatest(F.ceil(F.col("rounds") / keep ** (rungs - rung)), F.lit(1)).cast("int")
        alive = alive.withColumn("budget", budget)
        options = F.struct(F.col("budget").alias("rounds"), *[F.col(o) for o in OPTION_NAMES if o != "rounds"])
        grown = grow_trees(alive, features, {"_trees": cut}, options=options)
        grown = grown.withColumn("_yhat", tree_scores(F.col("_trees"), F.slice("x", cut + 1, F.size("target"))))
        held = F.arrays_zip(F.slice("target", cut + 1, F.size("target")).alias("y"), F.col("_yhat").alias("yhat"))
        errors = F.transform(held, lambda h: ape_eps(h["y"], h["yhat"]))
        mean = array_sum(errors) / F.size(errors)
        score = F.when(mean.isNotNull() & ~F.isnan(mean), mean).otherwise(float("inf"))
        ranked = grown.withColumn("score", score).drop("_trees", "_yhat")
        ranked = ranked.withColumn("rank", F.row_number().over(best.orderBy("score", "trial"))).withColumn("_n", F.count(F.lit(1)).over(best))
        ranked = reuse(ranked)
        rows.append(ranked.select("product", F.lit(rung).alias("rung"), "trial", *OPTION_NAMES, "budget", "score", "rank"))
        alive = ranked.filter(F.col("rank") <= F.ceil(F.col("_n") / keep)).drop("budget", "score", "rank", "_n")
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def best_of_rungs(scored: DataFrame) -> DataFrame:
    """The winner of the last rung: ``product, trial, <options>, best_value``."""
    last = scored.groupBy("product").agg(
        F.min_by(F.struct("trial", *OPTION_NAMES, F.col("score").alias("best_value")), F.struct(-F.col("rung"), F.col("rank"))).alias("b")
    )
    return last.select("product", "b.*")


def tune_boosted(table: DataFrame, features, trials: int = 5, ratio: float = 0.2, direction: str = "minimize") -> dict:
    """Best boosting parameters for the one model all products share.

    Every trial is a distributed fit on the leading rows of each product, scored on the
    rest; the loop runs over the handful of trials, the work in it over all rows.  A trial
    that fails scores infinity.
    """
    spark = table.sparkSession
    one = spark.range(1).select(F.lit("all").alias("product"))
    drawn: dict = {}
    for r in search_space(one, "XGBoost", trials).collect():
        drawn.setdefault(r["trial"], {})[r["param"]] = float(r["value"])
    parts = reuse(holdout_split(table, ratio))
    fit, held = parts.filter("part = 'fit'"), parts.filter("part = 'holdout'")
    results = []
    for trial, p in sorted(drawn.items()):
        options = {
            "rounds": int(p["n_estimators"]),
            "depth": int(p["max_depth"]),
            "rate": p["learning_rate"],
            "min_child_weight": int(p["min_child_weight"]),
            "subsample": p["subsample"],
            "colsample": p["colsample_bytree"],
        }
        try:
            scored = gbt_fit(fit, features, **options).transform(held).withColumnRenamed("prediction", "yhat")
            error = scored.agg(mape_eps_of().alias("e")).first()["e"]
        except Py4JJavaError:
            error = None
        worst = float("inf") if direction == "minimize" else float("-inf")
        results.append((worst if error is None or error != error else error, trial, options))
    best = (min if direction == "minimize" else max)(results, key=lambda r: r[0])
    return {"best_value": best[0], "trial": best[1], "params": best[2], "trials_used": len(results)}
