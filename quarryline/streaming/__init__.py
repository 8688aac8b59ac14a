"""Commits as a stream: late and redelivered records, churn by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def commit_stream(spark: SparkSession, directory: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream of commit records from parquet files that arrive in a directory."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(directory)


def distinct_commits(stream: DataFrame, lateness: str = "60 days") -> DataFrame:
    """Each commit once; a redelivery within the lateness is dropped, and state older than it is forgotten."""
    timed = stream.withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))
    return timed.withWatermark("ingested_at", lateness).dropDuplicatesWithinWatermark(["repo_id", "hash"])


def windowed_churn(stream: DataFrame, window: str = "7 days") -> DataFrame:
    """(repo_id, window, commits, files, added, deleted) by time of arrival; a window is final once the watermark has passed it."""
    files = F.coalesce("files", F.array().cast(stream.schema["files"].dataType))
    total = lambda name: F.aggregate(files, F.lit(0).cast("long"), lambda s, f: s + F.coalesce(f[name], F.lit(0)))
    return stream.groupBy("repo_id", F.window("ingested_at", window)).agg(F.count("*").alias("commits"), F.sum(F.size(files)).alias("files"), F.sum(total("added")).alias("added"), F.sum(total("deleted")).alias("deleted"))
