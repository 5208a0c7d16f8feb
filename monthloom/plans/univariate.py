"""The run without features: screen, window, clean, backtest, refit, blend."""

from pyspark.sql import DataFrame

from monthloom.operators.calendar import reindex_calendar
from monthloom.operators.screening import require_inputs
from monthloom.plans.common import (
    Outlook,
    blend,
    cleaned_report,
    fit_packed,
    model_rows,
    params_used,
    prepare,
    split_arrays,
    with_params,
)
from monthloom.settings import Settings


def run_univariate(
    demand: DataFrame,
    settings: Settings = Settings(),
    bounds: DataFrame | None = None,
    screen: DataFrame | None = None,
    fit_on: str = "train+val",
    cache: bool = False,
    params: DataFrame | None = None,
    config: DataFrame | None = None,
    trials: int = 5,
) -> Outlook:
    """From a long demand table to the blended outlook of every product.

    With ``fit_on='train'`` the validation months are kept from the models as well, and the
    k-th forecast is compared with the k-th test month.

    Raw facts are reduced by month first; then one shuffle by product feeds the month
    grid, the screening, the cleaning and all model fits.  ``cache`` keeps the fitted rows
    when several of the resulting tables will be written.

    With ``config(model, optimize, defaults_json)`` the parameters of models that take some are
    searched in ``trials`` draws, taken from ``params(product, model, params_json)`` as an earlier
    run saved them, or from the defaults; ``Outlook.params`` holds what was used and
    ``record_run`` stores it.
    """
    require_inputs(demand)
    s = settings
    packed = prepare(reindex_calendar(demand, bounds), s, screen)
    ready = split_arrays(packed, s, fit_on)
    if config is not None:
        ready = with_params(ready, s.models, params, config, trials)
    fitted = fit_packed(ready, s, s.models)
    if cache:
        fitted = fitted.persist()
    out = blend(cleaned_report(packed), model_rows(fitted, s.models), s, s.models, packed=packed, fitted=fitted)
    if config is not None:
        out.params = params_used(fitted, s.models, trials)
    return out
