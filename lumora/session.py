"""Session factory: UTC, adaptive execution, ANSI semantics (Spark's default)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session for local runs; on a cluster pass nothing and let spark-submit decide."""
    b = SparkSession.builder.appName("lumora").config("spark.sql.session.timeZone", "UTC")
    b = b.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # checkpoints go with the frames that need them
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the catalogue's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
