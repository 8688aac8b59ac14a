"""Centroids, coherence and similarity of vectors in groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import cosine, norm


def valid(vectors: DataFrame, size: int = 64) -> DataFrame:
    """Distinct keys with a full vector (array<double>) of finite numbers and a norm above 0."""
    v = F.col("vector").cast("array<double>")
    whole = (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))
    return vectors.filter(F.coalesce(whole, F.lit(False))).withColumn("vector", v).filter(norm(F.col("vector")) > 0).dropDuplicates(["vector_key"])


def centroids(vectors: DataFrame, *group: str) -> DataFrame:
    """(group, size, centroid, coherence): the mean vector, and the mean cosine of all pairs (1 for a single vector).

    With unit vectors u the sum over pairs follows from the norm of their sum, (|sum u|^2 - n) / (n (n - 1)), so no
    pairs are made, and sums by position are added up before the shuffle.
    """
    n = norm(F.col("vector"))
    parts = vectors.select(*group, F.posexplode(F.transform("vector", lambda x: F.struct(x.alias("x"), (x / n).alias("u")))).alias("at", "v"))
    sums = parts.groupBy(*group, "at").agg(F.count("*").alias("n"), F.avg("v.x").alias("mean"), F.sum("v.u").alias("u"))
    whole = sums.groupBy(*group).agg(F.max("n").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("at", "mean"))), lambda s: s["mean"]).alias("centroid"), F.sum(F.col("u") * F.col("u")).alias("square"))
    k = F.col("size")
    return whole.select(*group, "size", "centroid", F.when(k < 2, 1.0).otherwise((F.col("square") - k) / (k * (k - 1))).alias("coherence"))


def nearest_to_centroid(vectors: DataFrame, centres: DataFrame, *group: str) -> DataFrame:
    """Each vector with its cosine to the centroid of its group."""
    return vectors.join(centres.select(*group, "centroid"), list(group)).withColumn("similarity", cosine(F.col("vector"), F.col("centroid"))).drop("centroid")
