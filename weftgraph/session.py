"""Sessions for tests, tools and the benchmark. On a cluster, use the cluster's own session."""

from pyspark.sql import SparkSession


def session(name: str = "weftgraph", cores: int | str = 8, memory: str = "12g") -> SparkSession:
    """A local session: adaptive plans, UTC, as many shuffle partitions as cores."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(cores if isinstance(cores, int) else 8))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
