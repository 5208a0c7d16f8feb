"""Saved parameters and run records as append-only tables in a shared folder."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

PARAMS_SCHEMA = "product string, model string, params_json string, run_ts string"


def param_store_save(params: DataFrame, path: str, run_ts: str) -> None:
    """Save ``product, model, params_json`` (or a struct ``params``) under ``run_ts``, as a whole or not at all.

    The rows are staged under a name of this attempt; one record that names it makes them count.  An
    attempt that dies before leaves rows that nobody reads; one that is repeated for the same run
    replaces the former.
    """
    if "params_json" not in params.columns:
        params = params.withColumn("params_json", F.to_json("params"))
    attempt = uuid.uuid4().hex
    rows = params.select("product", "model", "params_json", F.lit(run_ts).alias("run_ts"), F.lit(attempt).alias("attempt"))
    rows.write.mode("append").partitionBy("run_ts", "attempt").parquet(f"{path}/rows")
    _commit(params.sparkSession, path, run_ts, attempt)


def _commit(spark: SparkSession, path: str, run_ts: str, attempt: str) -> None:
    record = spark.range(1).select(F.lit(run_ts).alias("run_ts"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("at"))
    record.write.mode("append").parquet(f"{path}/commits")


def param_store_commits(spark: SparkSession, path: str) -> DataFrame:
    """``run_ts, attempt`` of the runs that count: for each the attempt committed last."""
    try:
        found = spark.read.schema("run_ts string, attempt string, at timestamp").parquet(f"{path}/commits")
    except AnalysisException:
        return spark.createDataFrame([], "run_ts string, attempt string")
    return found.groupBy("run_ts").agg(F.max_by("attempt", F.struct("at", "attempt")).alias("attempt"))


def param_store_read(spark: SparkSession, path: str) -> DataFrame:
    """All parameters of the runs that count; an empty table where nothing was saved yet."""
    try:
        rows = spark.read.schema(f"{PARAMS_SCHEMA}, attempt string").parquet(f"{path}/rows")
    except AnalysisException:
        return spark.createDataFrame([], PARAMS_SCHEMA)
    names = [c.split()[0] for c in PARAMS_SCHEMA.split(", ")]
    return rows.join(param_store_commits(spark, path), ["run_ts", "attempt"]).select(*names)


def param_store_latest(saved: DataFrame) -> DataFrame:
    """Newest readable parameters per product and model; unreadable text is skipped."""
    readable = saved.filter(F.expr("try_parse_json(params_json)").isNotNull())
    return readable.groupBy("product", "model").agg(
        F.max_by("params_json", "run_ts").alias("params_json"), F.max("run_ts").alias("run_ts")
    )


def params_exist(saved: DataFrame, wanted: DataFrame) -> DataFrame:
    found = param_store_latest(saved).select("product", "model", F.lit(True).alias("found"))
    j = wanted.join(found, ["product", "model"], "left")
    return j.select("product", "model", F.coalesce("found", F.lit(False)).alias("exists"))


def run_list(saved: DataFrame) -> DataFrame:
    """Runs, newest first."""
    return saved.select("run_ts").distinct().orderBy(F.col("run_ts").desc())


def run_summary(
    metrics: DataFrame, project: str, run_ts: str, run_date: str, config: dict | None = None,
    params: DataFrame | None = None, importances: DataFrame | None = None, validation: DataFrame | None = None,
) -> DataFrame:
    """One row per product with the record of each of its models.

    ``params(product, model, params_json, retrained, trials)``,
    ``importances(product, model, feature, pct)`` and ``validation`` (like ``metrics``) are
    optional; a part that is absent is left out of the JSON.
    """
    keys = ["product", "model"]
    m = metrics.select(*keys, F.struct("rmse", "mape", "mae").alias("backtest"))
    none = F.lit(None)
    if validation is not None:
        m = m.join(validation.select(*keys, F.struct("rmse", "mape", "mae").alias("validation")), keys, "left")
    else:
        m = m.withColumn("validation", none.cast("struct<rmse:double,mape:double,mae:double>"))
    if params is not None:
        m = m.join(params.select(*keys, "params_json", "retrained", "trials"), keys, "left")
    else:
        m = m.withColumn("params_json", none.cast("string")).withColumn("retrained", F.lit(False)).withColumn("trials", F.lit(0))
    if importances is not None:
        per = importances.groupBy(*keys).agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "pct")))).alias("importance")
        )
        m = m.join(per, keys, "left")
    else:
        m = m.withColumn("importance", none.cast("map<string,double>"))
    record = F.struct(
        F.struct("backtest", "validation").alias("metrics"),
        F.from_json("params_json", "map<string,string>").alias("params"),
        "retrained",
        F.col("trials").alias("optuna_trials_used"),
        F.col("importance").alias("feature_importance"),
    )
    models = m.groupBy("product").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", F.to_json(record).alias("record"))))).alias("models")
    )
    info = F.struct(
        F.lit(project).alias("project_name"), F.lit(run_ts).alias("timestamp"), F.lit(run_date).alias("run_date")
    )
    settings = F.create_map(*[F.lit(str(x)) for kv in sorted((config or {}).items()) for x in kv]).cast("map<string,string>")
    return models.select(info.alias("run_info"), settings.alias("config"), "product", "models")


SUMMARY_SCHEMA = (
    "run_info struct<project_name:string,timestamp:string,run_date:string>,"
    " config map<string,string>, product string, models map<string,string>"
)


def run_summary_json(summary: DataFrame, path: str) -> None:
    """JSON lines, one product per line, so that no task ever holds all products."""
    summary.write.mode("overwrite").json(path)


def run_summary_read(spark: SparkSession, path: str) -> DataFrame | None:
    """The record back, or None where there is none."""
    try:
        return spark.read.schema(SUMMARY_SCHEMA).json(path)
    except AnalysisException:
        return None


def write_report(df: DataFrame, path: str, fmt: str = "parquet", partition: str | None = None) -> None:
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    (w.partitionBy(partition) if partition else w).save(path)
