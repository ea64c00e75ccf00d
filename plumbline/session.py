"""Session helpers shared by the CLI, the bench and the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of files for each core between which a table of few splits is dealt out; above, Spark's own splits are enough.
LEAST_DEALT, MOST_DEALT = 512 << 10, 4 << 20


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("plumbline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def dealt(df: DataFrame) -> DataFrame:
    """The rows over all cores, where the files give fewer splits than there are cores.

    A file of one row group is one task, however many cores wait. Only tables of less than ``MOST_DEALT``
    bytes a core are shuffled for that, so that the shuffle never grows with a large table.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    size = plan.optimizedPlan().stats().sizeInBytes()
    if not LEAST_DEALT * cores <= size < MOST_DEALT * cores or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
