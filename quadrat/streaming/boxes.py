"""An extension: box records as a stream. The batch operators are the same; these add event time and state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def records(spark: SparkSession, path: str, schema, kind: str = "parquet", **options) -> DataFrame:
    """Files that arrive under path, as an unbounded table."""
    return spark.readStream.format(kind).schema(schema).options(**options).load(path)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], value: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window start, keys, n, total): counts per event-time window; rows later than the watermark are left out."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(keys, start, end, n): runs of records no further apart than gap."""
    s = F.session_window(time, gap)
    return stream.withWatermark(time, late).groupBy(*keys, s.alias("s")).agg(F.count("*").alias("n")).select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def first_seen(stream: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Records without repeats of the keys within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def by_batch(stream: DataFrame, checkpoint: str, function: Callable[[DataFrame], DataFrame], path: str):
    """Runs a batch operator on every micro-batch and writes its rows in a folder of the batch, once."""

    def put(batch: DataFrame, number: int) -> None:
        function(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
