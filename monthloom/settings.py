"""Default settings; every plan function takes a ``Settings`` to override them."""

from dataclasses import dataclass, field

# Defaults that results depend on.
LAGS = (1, 2, 3, 6, 12)
ROLLING_WINDOWS = (3, 6, 12)
SEASON = 12
EPS = 1e-8

# Search spaces as (kind, low, high) or (kind, choices).
SEARCH_SPACES = {
    "SARIMA": {
        "p": ("int", 0, 2),
        "d": ("int", 0, 1),
        "q": ("int", 0, 2),
        "P": ("int", 0, 1),
        "D": ("int", 0, 1),
        "Q": ("int", 0, 1),
    },
    "XGBoost": {
        "n_estimators": ("int", 50, 500),
        "max_depth": ("int", 3, 10),
        "learning_rate": ("logfloat", 0.01, 0.3),
        "min_child_weight": ("int", 1, 10),
        "subsample": ("float", 0.6, 1.0),
        "colsample_bytree": ("float", 0.6, 1.0),
    },
    "Prophet": {
        "changepoint_prior_scale": ("logfloat", 0.001, 0.5),
        "seasonality_prior_scale": ("logfloat", 0.1, 50.0),
        "seasonality_mode": ("choice", ("additive", "multiplicative")),
    },
}

# Order in which one importance type is preferred over another.
IMPORTANCE_ORDER = ("builtin", "shap", "permutation", "regressor_coefficients")
IMPORTANCE_ORDER_DEFAULT_RUN = ("shap", "permutation")


@dataclass(frozen=True)
class Settings:
    lookback_months: int = 24
    min_nonzero_share: float = 0.5
    window_months: int = 60
    outlier_multiplier: float = 3.0
    val_months: int = 12
    test_months: int = 12
    horizon: int = 12
    mape_threshold: float = 0.5
    max_models: int | None = 3
    scaler: str | None = None
    categorical_prefixes: tuple = ("promo",)
    models: tuple = field(default=("HoltWinters", "SARIMA"))
    importance: bool = True
    permutation: bool = True
    shap: bool = True
