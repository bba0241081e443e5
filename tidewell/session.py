"""Session builder and the settings that every plan relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """UTC session with adaptive execution; ``conf`` adds or overrides settings."""
    builder = (
        SparkSession.builder.master(master)
        .appName("tidewell")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; Spark's reader resolves the path, so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
