"""Bring your own model: one call per product, in a Spark task."""

from pyspark.sql import DataFrame

FORECAST_SCHEMA = "product string, step int, ds date, yhat double"


def plug_forecaster(demand: DataFrame, forecaster, schema: str = FORECAST_SCHEMA) -> DataFrame:
    """Apply ``forecaster(pandas_frame) -> pandas_frame`` to each product's months.

    The frame holds one product's rows in date order; what is returned must match
    ``schema``.  Fitting, predicting and reporting parameters are the callable's business.
    """

    def ordered(pdf):
        return forecaster(pdf.sort_values("ds"))

    return demand.groupBy("product").applyInPandas(ordered, schema)
