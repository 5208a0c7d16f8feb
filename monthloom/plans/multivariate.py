"""Runs with features: the product's own, or also the demand of other products."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.models.boosted import TEMPORAL, gbt_fit, training_table, tree_gains, tree_path
from monthloom.models.grown import OPTION_NAMES, gain_reading, grow_trees, pack_rows, path_reading, shapley_shares
from monthloom.models.regress import with_regression
from monthloom.operators.calendar import pack, reindex_calendar
from monthloom.operators.encoding import encode_and_scale
from monthloom.operators.influence import (
    coef_importance,
    combine_importances,
    effect_importance,
    ensemble_importance,
    importance_priority,
    importance_router,
)
from monthloom.operators.joins import cross_product, split_with_features
from monthloom.operators.temporal import temporal_features
from monthloom.operators.tuning import best_of_rungs, tune_trees
from monthloom.operators.screening import require_inputs, require_nonempty
from monthloom.plans.common import (
    Outlook,
    blend,
    cleaned_long,
    cleaned_report,
    fit_packed,
    model_rows,
    prepare,
    split_arrays,
)
from monthloom.session import reuse
from monthloom.settings import IMPORTANCE_ORDER, IMPORTANCE_ORDER_DEFAULT_RUN, SEARCH_SPACES, Settings

UNIVARIATE = ("SARIMA", "HoltWinters")
MULTIVARIATE = ("XGBoost", "Prophet")
ALL_KINDS = (*UNIVARIATE, *MULTIVARIATE)


def encoded_table(cleaned: DataFrame, features: DataFrame, categorical, numeric, s: Settings) -> DataFrame:
    """``product, ds, y, i, n, split, <feature>...`` with codes and scaled values fitted on train.

    What is missing stays missing: training leaves such rows out, scoring counts it as 0.
    """
    labelled = split_with_features(cleaned, features, s.val_months, s.test_months, s.window_months)
    ready = encode_and_scale(labelled, categorical, numeric, s.scaler)
    return ready.select("product", "ds", "y", "i", "n", "split", *categorical, *numeric)


def _packed_rows(table: DataFrame, names, inputs) -> DataFrame:
    """Packed rows: ``exog`` (a struct of feature values per month), and ``x``, ``target``, ``n_known`` as trees read them."""
    shaped = temporal_features(table.select("product", "ds", "y", "split", *names)).withColumn("exog", F.struct(*names))
    return pack_rows(shaped, inputs, F.col("split") != "test", "exog")


def _matrix(exog, names):
    return F.transform(exog, lambda e: F.array(*[F.coalesce(e[c].cast("double"), F.lit(0.0)) for c in names]))


def _ahead(names, s: Settings):
    """Feature values of the test months, and of the future, which repeats the last month."""
    xs = _matrix(F.col("exog"), names)
    return F.slice(xs, F.size("head") + 1, F.greatest(F.col("n_test"), F.lit(1))), F.slice(xs, F.col("n"), 1)


def _grown(packed, names, inputs, s: Settings, tree_options, attributed: int = 0):
    """Adds ``bt_XGBoost``, ``fc_XGBoost`` and ``gain_XGBoost``: trees of the product's own, grown and read in its row.

    The backtest's trees and the final ones are grown in one pass, and nothing is shuffled.  With the depth
    ``attributed`` the same pass adds ``shap_XGBoost``, from the final trees.
    """
    test_months, last_month = _ahead(names, s)
    fits = {"_first": F.col("n_known"), "_final": F.size("target")}
    chosen = F.col("_options") if "_options" in packed.columns else None
    start, width = F.col("start"), len(names)
    reads = {
        "bt_XGBoost": ("_first", path_reading(F.col("head"), start, F.col("n_test"), test_months, width)),
        "fc_XGBoost": ("_final", path_reading(F.col("ys"), start, F.lit(s.horizon), last_month, width)),
        "gain_XGBoost": ("_final", gain_reading(inputs)),
    }
    if attributed:
        reads["shap_XGBoost"] = ("_final", shapley_shares(attributed, inputs))
    return grow_trees(packed, len(inputs), fits, options=chosen, reads=reads, **tree_options)


def _tuned(packed, inputs, trials: int, space):
    """Adds ``_options``: the parameters that win on the months before the test; and the table of the winners."""
    known = packed.select("product", F.slice("x", F.lit(1), F.col("n_known")).alias("x"), F.slice("target", F.lit(1), F.col("n_known")).alias("target"))
    best = reuse(best_of_rungs(tune_trees(known, len(inputs), trials, space=space)))
    own = best.select("product", F.struct(*OPTION_NAMES).alias("_options"))
    params = best.select(
        "product", F.lit("XGBoost").alias("model"), F.lit("tune").alias("origin"), F.to_json(F.struct(*OPTION_NAMES)).alias("params_json"),
        F.lit(True).alias("retrained"), F.lit(trials).alias("trials"),
    )
    return packed.join(own, "product", "left"), params


def _boosted(table, packed, names, inputs, s: Settings, tree_options):
    """The same columns from one model for all products: two distributed fits.

    Scoring is narrow: both paths are computed in the product's own row.
    """
    known = table.filter("split <> 'test'").select("product", "ds", "y", *names)
    everything = table.select("product", "ds", "y", *names)
    first = gbt_fit(reuse(training_table(known)), inputs, **tree_options)
    final = gbt_fit(reuse(training_table(everything)), inputs, **tree_options)
    test_months, last_month = _ahead(names, s)
    start, width = F.col("start"), len(names)
    packed = tree_path(packed, first, "bt_XGBoost", F.col("head"), start, F.col("n_test"), s.test_months, test_months, width)
    packed = tree_path(packed, final, "fc_XGBoost", F.col("ys"), start, F.lit(s.horizon), s.horizon, last_month, width)
    return packed.withColumn("gain_XGBoost", tree_gains(final, inputs))


def _regression(packed, names, s: Settings, **options):
    """Adds ``bt_Prophet``, ``fc_Prophet`` and the struct ``fit``, all in the product's row."""
    df = packed.withColumn("xs", _matrix(F.col("exog"), names))
    df = with_regression(df, "_bt", F.col("head"), F.col("start"), s.test_months, F.col("xs"), **options)
    df = with_regression(df, "fit", F.col("ys"), F.col("start"), s.horizon, F.col("xs"), **options)
    df = df.withColumn("bt_Prophet", F.slice("_bt.yhat", F.size("head") + 1, F.col("n_test")))
    return df.withColumn("fc_Prophet", F.slice("fit.yhat", F.col("n") + 1, s.horizon)).drop("_bt", "xs")


def run_features(
    demand: DataFrame,
    features: DataFrame,
    categorical=(),
    numeric=(),
    settings: Settings = Settings(models=MULTIVARIATE),
    bounds: DataFrame | None = None,
    tree_options: dict | None = None,
    extra=None,
    product_mode: str = "per_product",
    importance_order=IMPORTANCE_ORDER,
    tree_trials: int = 0,
    tree_space: dict | None = None,
) -> Outlook:
    """Feature run: boosted trees and regression with each product's own features.

    With ``product_mode='multi_product'`` one model of trees serves all products.  With ``tree_trials`` each
    product's trees have the parameters that win a search (``tune_trees``) before the test months; ``Outlook.params``
    holds them.
    ``extra(cleaned) -> (frame, names)`` may add further numeric feature columns.  The switches of
    ``settings`` say which importances are computed; one that is switched off is not in any plan.
    """
    if product_mode not in ("per_product", "multi_product"):
        raise ValueError(f"product_mode is per_product or multi_product, not {product_mode!r}")
    require_inputs(demand, features, needs_features=True)
    s = settings
    prepared = reuse(prepare(reindex_calendar(demand, bounds), s))
    require_nonempty(prepared)
    cleaned = cleaned_long(prepared).select("product", "ds", "y")
    numeric = list(numeric)
    if extra is not None:
        more, names = extra(cleaned)
        features = more.drop("y").join(features, ["product", "ds"], "left")
        numeric += names
    table = reuse(encoded_table(cleaned, features, list(categorical), numeric, s))
    names = [*categorical, *numeric]
    own = product_mode == "per_product"
    inputs = (*TEMPORAL, *names) if own else (*TEMPORAL, "level", *names)
    packed = split_arrays(_packed_rows(table, names, (*TEMPORAL, *names)), s)
    params, options = None, tree_options or {}
    if tree_trials and own and "XGBoost" in s.models:
        packed, params = _tuned(packed, inputs, tree_trials, tree_space)
    univariate = [m for m in s.models if m in UNIVARIATE]

    def fitted_rows(attributed=0):
        df = packed
        if "XGBoost" in s.models:
            df = _grown(df, names, inputs, s, options, attributed) if own else _boosted(table, df, names, inputs, s, options)
        if "Prophet" in s.models:
            df = _regression(df, names, s)
        return reuse(fit_packed(df.drop("x", "target", "n_known", "_options"), s, univariate))

    def blended(fitted):
        return blend(cleaned_report(prepared), model_rows(fitted, s.models), s, s.models, table=table, fitted=fitted)

    out = blended(fitted_rows())
    wanted = [(m, kind) for m in s.models for kind in importance_router(m, s.importance, s.permutation, s.shap)]
    if own and ("XGBoost", "shap") in wanted and names:
        # the trees are not kept with the results: attribution comes from the pass that grows them, of rows that are
        # fitted only where it is asked for, and then hold all that the importances and their blend need
        deepest = (tree_space or SEARCH_SPACES["XGBoost"])["max_depth"][2] if params is not None else options.get("depth", 6)
        out.extras["explained"] = lambda: fitted_rows(deepest)
    else:
        out.extras["explained"] = out.extras["fitted"]
    measures = {
        ("XGBoost", "builtin"): lambda rows: rows.select("product", F.inline("gain_XGBoost")),
        ("Prophet", "regressor_coefficients"): lambda rows: coef_importance(rows, names),
        ("Prophet", "permutation"): lambda rows: effect_importance(rows, names),
    }
    if own:
        measures["XGBoost", "shap"] = lambda rows: rows.select("product", F.inline("shap_XGBoost"))

    def importances():
        """``product, model, imp_type, feature, pct`` of the measures that the switches allow."""
        found = []
        for model, kind in wanted:
            if (model, kind) in measures and names:
                shares = measures[model, kind](out.extras["explained"])
                label = [F.lit(model).alias("model"), F.lit(kind).alias("imp_type")]
                found.append(shares.select("product", *label, "feature", "pct"))
        if not found:
            return table.sparkSession.createDataFrame([], "product string, model string, imp_type string, feature string, pct double")
        return reuse(combine_importances(*found))  # the blend reads them several times

    out.params = params
    out.extras["importances"] = importances
    out.extras["ensemble_importance"] = lambda: ensemble_importance(
        importance_priority(out.extras["importances"], importance_order), blended(out.extras["explained"]).weights
    )
    return out


def run_cross(
    demand, features, partners, slots, categorical=(), numeric=(), settings=Settings(models=MULTIVARIATE), lag: int = 0, **options
) -> Outlook:
    """The feature run with the demand of each product's partners added as ``other_<slot>`` (see ``cross_product``)."""

    def others(cleaned):
        return cross_product(cleaned, partners, slots, lag), [f"other_{k}" for k in slots]

    return run_features(demand, features, categorical, numeric, settings, extra=others, **options)


def run_default(demand, features, categorical=(), numeric=(), settings=Settings(models=ALL_KINDS), **options) -> Outlook:
    """All model kinds side by side, blended together; attribution is preferred to the other importances."""
    options = {"importance_order": IMPORTANCE_ORDER_DEFAULT_RUN} | options
    return run_features(demand, features, categorical, numeric, settings, **options)
