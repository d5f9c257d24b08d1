"""A growing response cache as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.schemas import RESPONSE


def records(spark: SparkSession, path: str, late: str = "1 day", files_per_trigger: int = 100) -> DataFrame:
    """Records as their files arrive, one for each key: a key that comes again within ``late`` is dropped, and state older than that is let go."""
    raw = spark.readStream.schema(RESPONSE).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_trigger).json(path)
    timed = raw.where("cache_key is not null").withColumn("at", F.timestamp_seconds("ts"))
    return timed.withWatermark("at", late).dropDuplicatesWithinWatermark(["cache_key"])


def progress(stream: DataFrame, window: str = "10 minutes") -> DataFrame:
    """Calls, failures and tokens by time window and model."""
    return stream.groupBy(F.window("at", window), "model_label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status") != "success").alias("n_failed"),
        F.sum(F.coalesce("usage.completion_tokens", F.lit(0))).alias("completion_tokens"),
    )
