"""Which models exist, what they can do, and which of them a run should use."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "model string, position int, multivariate boolean, multi_product boolean, available boolean"

# name, uses other features, can be trained over several products, ships with this package
MODELS = (
    ("SARIMA", False, False, True),
    ("HoltWinters", False, False, True),
    ("Chronos", True, True, False),  # pretrained weights: bring them through plug_forecaster
    ("XGBoost", True, True, True),  # as boosted trees of Spark ML
    ("Prophet", True, True, True),  # as trend + season + regressors
)


def model_table(spark: SparkSession) -> DataFrame:
    rows = [(name, k + 1, *flags) for k, (name, *flags) in enumerate(MODELS)]
    return spark.createDataFrame(rows, SCHEMA)


def model_select(models: DataFrame, enabled, family: str | None = None) -> DataFrame:
    """Enabled and available models, of one family (``univariate``/``multivariate``) or both."""
    out = models.filter(F.col("available") & F.col("model").isin(list(enabled)))
    if family is not None:
        out = out.filter(F.col("multivariate") == F.lit(family == "multivariate"))
    return out
