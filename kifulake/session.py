"""Session defaults and table access shared by every query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", shuffle: int = 8, app: str = "kifulake") -> SparkSession:
    """A single-JVM session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables; the path may live in any store Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
