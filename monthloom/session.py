"""Session helpers."""

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "monthloom", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on and a UTC clock.

    The number of shuffle partitions is left to the cluster; adaptive execution
    coalesces it for small inputs and splits skewed joins for large ones.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Tables placed by product are joined on (product, month) where they are: a product
        # has one row per month, so placing by product alone cannot pile rows up.
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        # A packed series is a few hundred bytes; this bounds an Arrow batch to a few MB.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where the cluster names one, else one in the warehouse.

    A warehouse on the driver's own disk is no such folder for the executors of a cluster.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        own_disk = warehouse.startswith("file:") or "://" not in warehouse
        if own_disk and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = warehouse.rstrip("/") + "/_monthloom"
    return path.rstrip("/")


def reuse(df: DataFrame) -> DataFrame:
    """Rows that several steps read; a part lost with its executor is computed again from its lineage."""
    return df.persist(StorageLevel.DISK_ONLY)


def partitions_for_work(spark: SparkSession) -> int:
    """How many partitions to give to work that is heavy per row.

    ``spark.sql.shuffle.partitions`` where somebody set it; otherwise twice the cores,
    but never below Spark's own 200 on a cluster, whose cores may not all be there yet.
    """
    name, context = "spark.sql.shuffle.partitions", spark.sparkContext
    asked = int(spark.conf.get(name))
    if context.getConf().contains(name) or asked != 200:
        return asked
    cores = 2 * context.defaultParallelism
    return cores if context.master.startswith("local") else max(asked, cores)


def spread(df: DataFrame, key: str = "product") -> DataFrame:
    """Place rows by ``key`` in a fixed number of partitions.

    Stands in for the shuffle the first window by product would plan anyway.  That one
    would be coalesced by its size in bytes - a few hundred bytes per series - although
    cleaning and fitting cost milliseconds per series; a fixed number keeps all cores busy.
    """
    return df.repartition(partitions_for_work(df.sparkSession), key)
