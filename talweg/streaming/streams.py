"""Streaming forms of the batch operators that have one.

Each takes a streaming DataFrame and says by its watermark how late data may be.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_per_window(events: DataFrame, ts: str, keys: Sequence[str], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows of each tumbling window and key, emitted once the watermark has passed."""
    out = events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n) of each run of events without a longer pause."""
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def first_requests(events: DataFrame, ts: str, key: Sequence[str], late: str = "1 day") -> DataFrame:
    """Rows whose key hasn't come before within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(key))


def keyed_overwrite(df: DataFrame, path: str, keys: Sequence[str], checkpoint: str):  # noqa: ANN201  a stream writer
    """A writer that folds each micro-batch into a Parquet table by key: later batches replace earlier rows.

    Tables alternate between two folders named by the batch, so that a batch that runs again gives the same result.
    """
    from talweg.operators.relational import upsert

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(list(keys))
        old = f"{path}/batch={number - 1}"
        merged = new if number == 0 else upsert(spark.read.schema(batch.schema).parquet(old), new, keys)
        merged.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
