"""The driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """Tables of one folder as attributes, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str) -> None:
    """All tables as temporary views, for ``spark.sql``."""
    tables = Tables(spark, sf_dir)
    for name in TABLES:
        getattr(tables, name).createOrReplaceTempView(name)
