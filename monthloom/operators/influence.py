"""How much each feature matters: permutation, attribution, coefficients, and blends.

The permutation measures hold one product's rows as arrays (a series is bounded by its
window).  A shuffle is the array sorted by an md5 of position, column and repeat, so it is
reproducible, and all repeats of all features are scored without moving a row.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthloom.functions.expressions import ape_eps, array_sum
from monthloom.settings import IMPORTANCE_ORDER


def _draw(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def permuted(values: Column, product: Column, name, rep) -> Column:
    """The array in the order of ``md5(product|position|name|rep)``."""
    keyed = F.transform(values, lambda v, i: F.struct(_draw(product, i, name, rep).alias("h"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda s: s["v"])


def permuted_blocks(values: Column, product: Column, name, rep, size: int = 3) -> Column:
    """Whole blocks of ``size`` consecutive values change places; a tail shorter than a block
    stays.  With fewer than two blocks the values themselves are shuffled."""
    n = F.size(values)
    blocks = F.floor(n / size).cast("int")
    order = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.greatest(blocks - 1, F.lit(0))),
            lambda b: F.struct(_draw(product, b, name, rep).alias("h"), b.alias("b")),
        )
    )
    moved = F.flatten(F.transform(order, lambda s: F.slice(values, s["b"] * size + 1, size)))
    tail = F.slice(values, blocks * size + 1, size)
    return F.when(blocks < 2, permuted(values, product, name, rep)).otherwise(F.concat(moved, tail))


def pack_features(rows: DataFrame, features, target: str = "y", order: str = "ds", keep=()) -> DataFrame:
    """``product, y ARRAY, <feature> ARRAY...`` in date order, plus constant columns ``keep``."""
    entry = F.struct(order, *[c for c in (target, *features) if c != order])
    packed = rows.groupBy("product", *keep).agg(F.array_sort(F.collect_list(entry)).alias("_r"))
    return packed.select(
        "product", *keep, *[F.col("_r").getField(c).alias(c) for c in (target, *features)]
    )


def permute_column(rows: DataFrame, column: str, rep: int = 1, blocks: int | None = None, order: str = "ds") -> DataFrame:
    """``product, i, original, permuted`` for one column of each product's table."""
    p = pack_features(rows, [], target=column, order=order)
    values = F.col(column)
    new = (
        permuted(values, F.col("product"), column, rep)
        if blocks is None
        else permuted_blocks(values, F.col("product"), column, rep, blocks)
    )
    z = F.arrays_zip(values.alias("original"), new.alias("permuted"))
    return p.select("product", F.posexplode(z).alias("i", "z")).select("product", "i", "z.*")


def permute_blocks(rows: DataFrame, column: str, rep: int = 1, size: int = 3, order: str = "ds") -> DataFrame:
    return permute_column(rows, column, rep, size, order)


def _mean_error(arrays: dict, target: Column, score) -> Column:
    """Mean share error of ``score`` over zipped arrays."""
    z = F.arrays_zip(target.alias("t"), *[a.alias(f) for f, a in arrays.items()])
    errs = F.transform(z, lambda r: ape_eps(r["t"], score({f: r[f] for f in arrays})))
    return array_sum(errs) / F.size(target)


def permutation_errors(packed: DataFrame, features, score, target="y", repeats=10, blocks=None) -> DataFrame:
    """``product, feature, baseline, mean_error``.  ``score`` maps feature columns to a prediction.

    One row per product, feature and repeat, derived in place: nothing is shuffled until the
    small average over repeats, and that one keeps the partitioning by product.
    """
    plain = {f: F.col(f) for f in features}
    base = packed.withColumn("baseline", _mean_error(plain, F.col(target), score))
    reps = F.explode(F.sequence(F.lit(1), F.lit(repeats)))
    jobs = base.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features]))).withColumn("rep", reps)

    def shuffle(f):
        args = (F.col(f), F.col("product"), F.lit(f), F.col("rep"))
        return permuted(*args) if blocks is None else permuted_blocks(*args, blocks)

    for f in features:
        jobs = jobs.withColumn(f"_{f}", F.when(F.col("feature") == f, shuffle(f)).otherwise(F.col(f)))
    err = _mean_error({f: F.col(f"_{f}") for f in features}, F.col(target), score)
    return (
        jobs.select("product", "feature", "baseline", err.alias("err"))
        .groupBy("product", "feature", "baseline")
        .agg(F.avg("err").alias("mean_error"))
    )


def pct_normalize(scores: DataFrame, value: str = "score", keys=("product",), out: str = "pct") -> DataFrame:
    """Scores to percent of their total, two decimals; left alone where the total is 0."""
    total = F.sum(value).over(W.partitionBy(*keys))
    return scores.withColumn(out, F.when(total > 0, F.round(100 * F.col(value) / total, 2)).otherwise(F.col(value)))


def permutation_importance(packed: DataFrame, features, score, repeats: int = 10, target: str = "y") -> DataFrame:
    e = permutation_errors(packed, features, score, target, repeats)
    rise = F.greatest(F.lit(0.0), F.col("mean_error") - F.col("baseline"))
    return pct_normalize(e.select("product", "feature", rise.alias("score"))).select("product", "feature", "pct")


def block_importance(packed: DataFrame, features, score, repeats=10, size=3, target="y") -> DataFrame:
    """Mean rise of the error relative to the baseline; signed, not a percentage."""
    e = permutation_errors(packed, features, score, target, repeats, size)
    rise = F.col("mean_error") - F.col("baseline")
    rel = F.when(F.col("baseline") != 0, rise / F.col("baseline")).otherwise(rise)
    return e.select("product", "feature", rel.alias("importance"))


def shapley_linear(rows: DataFrame, coefficients: dict) -> DataFrame:
    """Exact attribution of a linear model: mean of abs(b * (x - mean x)), in percent.

    ``coefficients`` maps a feature to its coefficient column; keyed by product.
    """
    w = W.partitionBy("product")
    parts = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.abs(b * (F.col(f) - F.avg(f).over(w))).alias("v"))
            for f, b in coefficients.items()
        ]
    )
    long = rows.select("product", parts.alias("_p")).select("product", F.inline("_p"))
    return pct_normalize(long.groupBy("product", "feature").agg(F.avg("v").alias("score"))).select(
        "product", "feature", "pct"
    )


def coef_importance(fitted: DataFrame, regressors) -> DataFrame:
    """Share of each regressor's absolute coefficient, by name."""
    pairs = F.arrays_zip(F.array(*[F.lit(r) for r in regressors]).alias("feature"), F.col("fit.coef").alias("c"))
    long = fitted.select("product", F.inline(pairs)).select("product", "feature", F.abs("c").alias("score"))
    return pct_normalize(long).select("product", "feature", "pct")


def effect_importance(fitted: DataFrame, regressors, repeats: int = 5) -> DataFrame:
    """Permutation importance of regressors from their fitted effects: ``product, feature, pct``.

    ``fitted`` has the actual values ``ys`` and the struct ``fit`` with ``yhat`` and ``effects`` (one array per regressor, what it
    adds to ``yhat``).  Moving a regressor's values moves its effects along, so no model is fitted or scored again: the
    prediction changes by the permuted effect minus the effect.  The score is the mean rise of the share error over the
    repeats; everything happens in the product's row, whose arrays are not copied.
    """
    n = F.size("ys")

    def error(yhat):
        z = F.arrays_zip(F.col("ys").alias("t"), yhat.alias("p"))
        return array_sum(F.transform(z, lambda r: ape_eps(r["t"], r["p"]))) / n

    base = F.slice("fit.yhat", F.lit(1), n)

    def rise(k, name):
        effect = F.slice(F.get("fit.effects", F.lit(k)), F.lit(1), n)

        def moved(rep):
            z = F.arrays_zip(base.alias("p"), effect.alias("e"), permuted(effect, F.col("product"), F.lit(name), rep).alias("q"))
            return error(F.transform(z, lambda r: r["p"] - r["e"] + r["q"]))

        mean = array_sum(F.transform(F.sequence(F.lit(1), F.lit(repeats)), moved)) / repeats
        return F.struct(F.lit(name).alias("feature"), F.greatest(F.lit(0.0), mean - error(base)).alias("score"))

    scores = [rise(k, name) for k, name in enumerate(regressors)]
    long = fitted.filter(F.col("fit").isNotNull()).select("product", F.inline(F.array(*scores)))
    return pct_normalize(long).select("product", "feature", "pct")


def equal_importance(names: DataFrame) -> DataFrame:
    """The same share for every supplied covariate."""
    k = F.count(F.lit(1)).over(W.partitionBy("product"))
    return names.select("product", "feature", F.round(F.lit(100.0) / k, 2).alias("pct"))


def top_features(scores: DataFrame, n: int = 10, value: str = "pct") -> DataFrame:
    w = W.partitionBy("product").orderBy(F.col(value).desc(), "feature")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


# Which measures a model offers, by a part of its name.
METHODS = {
    "xgboost": ("builtin", "shap"),
    "prophet": ("regressor_coefficients", "permutation"),
    "chronos": ("covariates_used",),
}


def importance_router(model: str, enabled: bool = False, permutation: bool = False, shap: bool = False) -> tuple:
    """The measures to compute for a model, honouring its switches."""
    if not enabled:
        return ()
    for part, methods in METHODS.items():
        if part in model.lower():
            off = set() if shap else {"shap"}
            if not permutation:
                off |= {"permutation", "covariates_used"}
            return tuple(m for m in methods if m not in off)
    return ("permutation",)


def importance_router_generic(enabled: bool = True, permutation: bool = True, shap: bool = True) -> tuple:
    """The older variant: any model, any of the two general measures."""
    on = (("permutation", permutation), ("shap", shap))
    return tuple(m for m, wanted in on if wanted) if enabled else ()


def importance_priority(importances: DataFrame, order=IMPORTANCE_ORDER) -> DataFrame:
    """Keep, per product and model, the rows of the most preferred importance type present."""
    rank = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("imp_type"))
    ranked = importances.withColumn("_rank", rank).filter(F.col("_rank") > 0)
    best = F.min("_rank").over(W.partitionBy("product", "model"))
    return ranked.withColumn("_best", best).filter(F.col("_rank") == F.col("_best")).drop("_rank", "_best")


def feature_union(importances: DataFrame) -> DataFrame:
    """Every feature named by any of a product's models, for each of these models; 0 if unnamed."""
    models = importances.select("product", "model").distinct()
    names = importances.select("product", "feature").distinct()
    known = importances.groupBy("product", "model", "feature").agg(F.max("pct").alias("pct"))
    every = models.join(names, "product").join(known, ["product", "model", "feature"], "left")
    return every.select("product", "model", "feature", F.coalesce("pct", F.lit(0.0)).alias("pct"))


def ensemble_importance(importances: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean over the models that have both; a missing feature counts 0; in percent."""
    models = importances.select("product", "model").distinct().join(weights, ["product", "model"])
    total = models.groupBy("product").agg(F.sum("weight").alias("_total"))
    part = importances.join(weights, ["product", "model"]).groupBy("product", "feature").agg(
        F.sum(F.col("weight") * F.col("pct")).alias("_s")
    )
    # features named only by models without a weight still appear, with 0
    names = importances.select("product", "feature").distinct()
    j = names.join(total, "product").join(part, ["product", "feature"], "left").filter(F.col("_total") > 0)
    score = F.coalesce(F.col("_s"), F.lit(0.0)) / F.col("_total")
    return pct_normalize(j.select("product", "feature", score.alias("score"))).select("product", "feature", "pct")


def importance_report(importances: DataFrame, weights: DataFrame, order=IMPORTANCE_ORDER) -> DataFrame:
    """One nested row per product: models with weight (%) and measures, and the blend."""
    blend = ensemble_importance(importance_priority(importances, order), weights)
    by_type = importances.groupBy("product", "model", "imp_type").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "pct")))).alias("values")
    )
    by_model = by_type.groupBy("product", "model").agg(
        F.map_from_entries(F.collect_list(F.struct("imp_type", "values"))).alias("measures")
    )
    pct = F.round(100 * F.coalesce("weight", F.lit(0.0)), 2)
    entry = F.struct("model", F.struct(pct.alias("weight"), F.col("measures")).alias("entry"))
    models = by_model.join(weights.select("product", "model", "weight"), ["product", "model"], "left")
    models = models.groupBy("product").agg(F.map_from_entries(F.collect_list(entry)).alias("models"))
    blended = blend.groupBy("product").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "pct")))).alias("importance")
    )
    ensemble = F.struct("importance", F.lit("inverse_mape_weighted").alias("method")).alias("ensemble")
    return models.join(blended, "product", "left").select("product", "models", ensemble)


def combine_importances(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
